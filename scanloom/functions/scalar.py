"""Column expressions of the page-scan requests: names, numbers, urls, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of a file's name, taken off in this order, each once (fixed values).
NAME_PREFIXES = ("File:", "파일:")
SCAN_WIDTH = 1920
DEFAULT_RATIO = 1.0
#: Width to which an edge is scaled, and its limits of zoom and height (fixed values).
EDGE = 96.0
EDGE_ZOOM = 4
EDGE_HEIGHT = 8192
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes blanks only)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def file_name(c: Column) -> Column:
    """Normalised file name: underscores are blanks, prefixes go."""
    out = F.replace(strip(c), F.lit("_"), F.lit(" "))
    for prefix in NAME_PREFIXES:
        out = F.regexp_replace(out, "^" + prefix, "")
    return strip(out)


def page_number(c: Column) -> Column:
    """A page of 1 or more given as text, else null."""
    n = c.try_cast("int")
    return F.when(n >= 1, n)


def page_file(page: Column) -> Column:
    """Four digits at least; lpad() would cut longer numbers."""
    return F.format_string("%04d.jpg", page)


def tiers(n: Column) -> Column:
    """Inner boundaries k/n of n equal tiers; none for one tier."""
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: k.cast("double") / n)).otherwise(F.array().cast("array<double>"))


def first_nonzero(*values: Column, default: float = DEFAULT_RATIO) -> Column:
    """The first value that is neither null nor zero (coalesce keeps zeros)."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(default))


def finite_in(x: Column, low: float, high: float) -> Column:
    """Whether x is a number in low..high; NaN sorts above all numbers in Spark."""
    return F.coalesce(~F.isnan(x) & (x >= low) & (x <= high), F.lit(False))


def fingerprint(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary") if not isinstance(c, str) else F.col(c).cast("binary"), 256), 1, digits)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_offset(text: Column, at: Column) -> Column:
    """UTF-16 offset of a place given in code points."""
    return utf16_length(F.substring(text, F.lit(1), at))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_template(url: Column, width: int = SCAN_WIDTH) -> Column:
    """A page's thumbnail url with the page number left open; the first place only."""
    mark = "/page1-500px-"
    at = F.instr(url, mark)
    return F.when(at > 0, F.concat(F.substring(url, F.lit(1), at - 1), F.lit(f"/page{{N}}-{width}px-"), F.substring(url, at + len(mark), F.length(url))))


def query_value(url: Column, key: str) -> Column:
    """First value of a key in a query string that isn't blank, decoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(key + "=")) & (F.length(p) > len(key) + 1))
    return F.try_url_decode(F.substring(F.get(pairs, F.lit(0)), len(key) + 2, 1 << 20))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))


def _host_and_port(netloc: Column) -> tuple[Column, Column]:
    """Lower-case host (in brackets or before the first colon) and what follows its colon."""
    bracket = netloc.startswith("[")
    name = F.when(bracket, F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(netloc, ":", 1))
    port = F.when(bracket, F.regexp_extract(netloc, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.regexp_extract(netloc, r"^[^:]*:(.*)$", 1))
    return F.lower(name), port


def valid_address(address: Column) -> Column:
    """Whether an address is http(s)://host[:port][/path] of allowed characters, its host a
    name of labels or ::1 and its port 1 to 65535."""
    netloc = F.regexp_extract(address, r"^[A-Za-z]+://([^/]*)", 1)
    name, port = _host_and_port(netloc)
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    brackets = netloc.rlike(r"\A\[::1\](:[0-9]+)?\z") | ~netloc.rlike(r"[\[\]]")
    number = port.try_cast("int")
    fine_port = ~netloc.endswith(":") & ((port == "") | (port.rlike(r"\A[0-9]+\z") & F.coalesce(number.between(1, 65535), F.lit(False))))
    ok = address.rlike(r"\A[A-Za-z0-9._~:/%\[\]-]+\z") & F.lower(address).rlike(r"\Ahttps?://") & brackets & fine_port
    return F.coalesce(ok & ((name == "::1") | name.rlike(rf"\A{label}(?:\.{label})*\z")), F.lit(False))


def base_address(proto: Column, netloc: Column, public: str) -> Column:
    """The service's own address by a request's protocol and host, null if they are not
    allowed: local hosts, and the public host, which is always https on its usual port."""
    name, port = _host_and_port(netloc)
    number = port.try_cast("int")
    ok = proto.isin("http", "https") & valid_address(F.concat(proto, F.lit("://"), netloc)) & ~netloc.contains("/")
    ok = ok & (name.isin(*LOCAL_HOSTS) | ((name == public) & ((port == "") | (number == 443))))
    return F.when(ok, F.concat(F.when(name == public, "https").otherwise(proto), F.lit("://"), F.lower(netloc), F.lit("/")))


def own_address(base: Column, forwarded_host: Column, host_: Column, forwarded_proto: Column, scheme: Column, public: str) -> Column:
    """struct(address, code): a configured base wins (500 if it is bad), then forwarded
    headers, then the plain ones (400 if they are not allowed); empty counts as absent."""
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    found = base_address(F.coalesce(first(forwarded_proto, scheme), F.lit("http")), F.coalesce(first(forwarded_host, host_), F.lit("localhost")), public)
    set_ = F.coalesce(base != "", F.lit(False))
    fixed = F.when(valid_address(base), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")))
    address = F.when(set_, fixed).otherwise(found)
    return F.struct(address.alias("address"), F.when(address.isNotNull(), 200).when(set_, 500).otherwise(400).alias("code"))


def host_allowed(url: Column, public: str) -> Column:
    """Whether a url's protocol and host are allowed as the service's own."""
    return base_address(F.lower(F.substring_index(url, "://", 1)), F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1), public).isNotNull()


def decoded_path(path: Column) -> Column:
    """A path whose UTF-8 bytes were read as Latin-1, put right, with percent escapes decoded
    (bad ones stay, + too)."""
    utf8 = F.when(path.rlike(r"\A[\x00-\xFF]*\z"), F.encode(path, "ISO-8859-1").cast("string"))
    fixed = F.when(F.coalesce(F.is_valid_utf8(utf8), F.lit(False)), utf8).otherwise(path)
    return F.try_url_decode(F.replace(F.regexp_replace(fixed, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def json_string(c: Column) -> Column:
    """A JSON string: quotes, backslashes, \\n, \\r, \\t, \\b and \\f escaped, all else as it is."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escape))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_list(items: Column) -> Column:
    """A JSON list of ready items, with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def canonical(v: Column) -> Column:
    """A VARIANT as JSON, the keys of all its objects in order, so that equal values are equal texts."""
    return F.to_json(v)


def progress_text(done: Column, total: Column) -> Column:
    return F.concat(F.least(done, total), F.lit("/"), total, F.lit("쪽"))


def is_scan(path: Column) -> Column:
    return path.rlike(r"\.(jpg|png)\z")


def edge_verdict(x0: Column, x1: Column, width: Column, height: Column, edge: float = EDGE) -> Column:
    """The first rule that a requested edge breaks, in their order; 'ok' if none."""
    scale = F.lit(edge) / (x1 - x0)
    return (
        F.when((x0 < 0) | (x0 >= x1), "order").when(scale > EDGE_ZOOM, "zoom").when(x1 > width, "width")
        .when(F.greatest(F.lit(8.0), F.bround(height * scale)) > EDGE_HEIGHT, "height").otherwise("ok")
    )

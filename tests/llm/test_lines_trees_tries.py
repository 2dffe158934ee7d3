"""Line dedup, the Merkle manifest and the prefix trie against plain Python models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import lines, merkle, prefixes

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def key_of(line):
    out = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), out)


def deduplicated(rows, least=3, chars=20):
    """(doc_id, n_lines, n_dropped, hash) of each row; rows without an id are one document."""
    low = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= chars:
                holders[key_of(line)].add(low(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(holders[key_of(x)]) < least or max(holders[key_of(x)]) == low(i)]
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    """Lines of 19 to 21 characters, in one, two, three and most documents, in any case and
    with blanks; null and shared ids, repeated rows, null, empty and long texts."""
    rng = random.Random(4)
    pool = ["é" * 19, "é" * 20, "é" * 10 + "x" * 10, "short", "a line of twenty chars", "Another line that is common to all", "漢" * 7, "漢" * 20, "tail " * 8]
    rows = []
    for i in range(120):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + [f"only in document {i} and nowhere else"] * rng.randint(0, 2)
        own = [rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r", x]) for x in own] + ["common to every one of them"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(None, "common to every one of them\nanother line that is common to all"), (None, "two ids share this very line"), (None, None), (None, None)]
    rows += [(200, "two ids share this very line\nfour rows and two documents"), (200, "four rows and two documents"), (200, "four rows and two documents"), (201, "four rows and two documents\n")]
    rows += [(300, ""), (301, None), (302, "\n\n"), (303, "x" * 5_000_000 + "\ncommon to every one of them"), (304, "common to every one of them\n" * 30_000)]
    return rows


@pytest.mark.parametrize(("shard_bytes", "probes"), [(lines.SHARD_BYTES, lines.PROBES), (200_000, 5)])
def test_lines(spark, texts, shard_bytes, probes):
    docs = spark.createDataFrame([(*t, "clash", "x", 1) for t in texts], "doc_id long, text string, kid string, digests string, n_lines int").repartition(5)
    got = sorted((tuple(r) for r in lines.dedup(docs, shard_bytes=shard_bytes, probes=probes).collect()), key=repr)
    assert got == deduplicated(texts)
    assert lines.dedup(docs.limit(0)).count() == 0
    cut = lines.dedup_text(docs, shard_bytes=shard_bytes, probes=probes)
    assert cut.schema == docs.schema
    rows = cut.collect()
    assert sorted(((r["doc_id"], sha(r["text"] or "")) for r in rows), key=repr) == [(r[0], r[3]) for r in got] or Counter((r["doc_id"], sha(r["text"] or "")) for r in rows) == Counter((r[0], r[3]) for r in got)
    assert sum(r["text"] is None for r in rows) == 3 and {r["kid"] for r in rows} == {"clash"}


def test_other_thresholds(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for least, chars in ((1, 1), (2, 0), (50, 20)):
        got = sorted((tuple(r) for r in lines.dedup(docs, least_docs=least, least_chars=chars).collect()), key=repr)
        assert got == deduplicated(texts, least, chars)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_numbers_without_gaps(n):
    digests = np.frombuffer(b"".join(hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(2 * n)), "<u8").reshape(-1, 2)
    bits, sizes = lines.perfect_hash(digests[:n])
    assert sorted(lines.numbers(digests[:n], bits, sizes).tolist()) == list(range(n)) and bits.sum() == n
    assert lines.numbers(digests[n:], bits, sizes).max(initial=-1) < max(n, 1)


def test_probe_knows_strangers():
    digests = np.frombuffer(b"".join(hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)), "<u8").reshape(-1, 2)
    ids = np.arange(3000)
    own = np.concatenate([digests[:1000]] * 3)
    shard = lines.arrays(own, ids, 3)
    assert not lines.probe(digests[1000:], ids[1000:], shard, 3).any()
    assert lines.probe(own, ids, shard, 3).sum() == 2000 and not lines.probe(own[2000:], ids[2000:], shard, 3).any()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def level_up(nodes, fanout):
    return [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def climbed(nodes, at, fanout):
    """Levels' siblings of a node, before and after it, and the top."""
    out = []
    while len(nodes) > 1:
        low = at // fanout * fanout
        out.append((nodes[low:at], nodes[at + 1 : low + fanout]))
        nodes, at = level_up(nodes, fanout), at // fanout
    return out, nodes[0]


def manifest(rows, fanout=3):
    leaf = lambda r: sha("".join(map(value, r)))
    half = lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0
    told = lambda r: leaf((*r[:4], r[4].replace("\n", "") if half(r[0]) and r[4] is not None else r[4]))
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), told(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in names:
        trees[t].sort(key=lambda x: x[:4])
    subroots = [climbed([x[2] for x in trees[t]], 0, fanout)[1] for t in names]
    out = []
    for k, t in enumerate(names):
        over, root = climbed(subroots, k, fanout)
        for i, (_, _, own, altered, r) in enumerate(trees[t]):
            within, sub = climbed([x[2] for x in trees[t]], i, fanout)
            proof, now = "", altered
            for a, b in within + over:
                proof += "".join(a + b)
                now = sha("".join([*a, now, *b]))
            out.append((r[0], own, sub, root, sha(proof), now, now == root))
    return sorted(out, key=repr)


def merkle_query(docs, **more):
    halved = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(docs, altered={"text": F.when(halved, F.replace("text", F.lit("\n"), F.lit("")))}, **more)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")


@pytest.mark.parametrize(("levels", "fanout"), [(7, 3), (1, 3), (2, 3), (2, 2)])
def test_manifest(spark, levels, fanout):
    """A group of 400 of 530 rows, groups of one to ten, a null one, null and repeated rows."""
    rng = random.Random(8)
    rows = [(i, "big", "en", 5, f"text {i}\nof two lines") for i in rng.sample(range(10_000), 400)]
    rows += [(i, f"g{i % 17}é", None, None, rng.choice(["", None, "\n", "ü 漢"])) for i in range(100)]
    rows += [(None, None, None, None, None)] * 2 + [(7, None, "x", 2**40, "same")] * 3 + [(1 << 60, "", "y", -3, "z")] + [((1 << 60) + i, "lone" + "+" * i, "y", -3, "a\nb") for i in range(2)]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(4)
    got = sorted((tuple(r) for r in merkle_query(docs, levels=levels, fanout=fanout).collect()), key=repr)
    assert got == manifest(rows, fanout)
    if levels == 7:
        assert merkle_query(docs.limit(0)).count() == 0
        lone = merkle_query(docs.filter("doc_id = 1152921504606846976 and source = ''")).collect()
        assert len(lone) == 1 and lone[0][1] == lone[0][2] == lone[0][3] == lone[0][5] and lone[0][4] == sha("")
        plain = merkle.manifest(docs).filter("verified").collect()
        assert len(plain) == len(rows) and all(merkle.fold(r["leaf"], r["proof"], r["places"]) == r["root"] for r in plain)


def nodes_by_force(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(donor, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: sha(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("shard_turns", [prefixes.TURNS, 40, 7])
def test_trie(spark, shard_turns):
    """A first turn and a conversation that a third share, a long one, null fields and turns,
    no own turns left, absent donors, ids below zero, repeated rows."""
    rng = random.Random(6)
    first, same = ("user", "hello é"), [("user", "q"), ("assistant", "a"), ("user", "漢字")]
    rows = []
    for c in [*range(0, 300, 3), *range(-9, 0), *range(301, 330)]:
        kind = rng.random()
        talk = same if kind < 0.35 else [first, *[(rng.choice(["user", None]), rng.choice(["x", "y", None, ""])) for _ in range(rng.randint(0, 14))]] if kind < 0.8 else [("u", f"t{rng.randint(0, 3)}")] * rng.randint(1, 12)
        rows += [(c, t if t else rng.choice([0, None]), *x) for t, x in enumerate(talk)]
    rows += [(1000, t, "u", f"turn {t % 7}") for t in range(300)] + [(None, 1, "u", "lost"), (1005, 1, "u", "twice"), (1005, 1, "u", "twice"), (1005, 1, "a", "twice")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)

    def query(t):
        convs, conv = prefixes.turns(t), F.col("conv_id")
        return prefixes.trie(prefixes.rebuilt(convs, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8), shard_turns)

    assert sorted((tuple(r) for r in query(table).collect()), key=repr) == sorted(nodes_by_force(rows), key=repr)
    if shard_turns == prefixes.TURNS:
        assert query(table.limit(0)).count() == 0
        bare = prefixes.trie(spark.createDataFrame([(4, [], []), (2, [], [])], "conv_id long, d array<string>, s array<long>")).collect()
        assert [tuple(r) for r in bare] == [(2, 0, None, 2, 0, 1, 0, sha("2,4"))]


def test_find_close():
    rng = random.Random(1)
    for n in (1, 2, 31, 40, 1000, 20_000):
        depth, bits = 0, []
        while len(bits) < n or depth:
            up = depth == 0 or (len(bits) < n and rng.random() < rng.choice([0.3, 0.5, 0.9]))
            bits.append(up)
            depth += 1 if up else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert prefixes.find_close(np.array(bits), opens).tolist() == [want[i] for i in opens.tolist()]


def test_urls_of_odd_tables(spark):
    """Null and empty urls, ones without a host, repeated rows, an empty table."""
    from scanloom.llm import urls

    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.example.NET/en/x?y"), (4, "http://A.example.NET/en/x?y"), (None, "x://b.net"), (5, "x://b.net#/"), (6, "http://sub.org/fr/"), (7, "http://org.example/fr/")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, rule string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect())
    empty = ("", "", None, "allow")
    assert got == Counter([(1, *empty), (2, *empty), (3, *empty), *[(4, "a.example.net", "/en/x", "example.net/en/", "allow")] * 2, (None, "b.net", "", None, "allow"), (5, "b.net", "", None, "allow"), (6, "sub.org", "/fr/", "org/fr/", "allow"), (7, "org.example", "/fr/", None, "allow")])
    assert urls.filter_urls(df.limit(0)).count() == 0

"""Queries over whole tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, chunks, ctw, decontaminate, lines, merkle, minhash, neighbours, prefixes, sharding, toxicity, urls

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def remainder(m: int):
    """crc32 of the decimal doc_id, modulo m; null for a null id, which is neither held out
    nor learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    held = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import bwt

    return bwt.dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(halved, F.replace("text", F.lit("\n"), F.lit("")))
    proved = merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": tampered})
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, conv = prefixes.turns(table(spark, sf_dir, "conversations")), F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefixes.trie(prefixes.rebuilt(convs, conv - conv % 5, head, 8))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_substring_dedup, op4_neighbours, op5_decontaminate, op6_ctw, op7_bpe, op8_urls, op9_suffix_dedup, op10_sharding, op11_line_dedup, op12_merkle_manifest, op13_prefix_trie, pipeline)}



def merkle_sql(levels: int = 12, above: int = 6) -> str:
    """DuckDB SQL for op12, one step a level: enough for 3 ** levels rows of a source and
    3 ** above sources.  n is a tree's count of nodes, h a node, w its place."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    start = " || ".join(map(part, ("doc_id", "source", "lang", "n_chars")))
    tampered = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    steps = [f"""
d AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS t, sha256({start} || {part("text")}) AS leaf, sha256({start} || {part(f"({tampered})")}) AS told FROM (SELECT *, 0 AS none FROM documents) JOIN (SELECT doc_id AS i, {CRC32} AS crc FROM (SELECT DISTINCT doc_id FROM documents)) ON i IS NOT DISTINCT FROM doc_id),
l0 AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, told) - 1 AS w, count(*) OVER (PARTITION BY t) AS n, leaf AS h, doc_id, told FROM d),
p0 AS MATERIALIZED (SELECT doc_id, t, h AS leaf, w, n, told AS f, '' AS proof FROM l0)"""]

    def up(k: int, of: str, path: str) -> None:
        steps.append(f"{of}{k + 1} AS MATERIALIZED (SELECT t, w // 3 AS w, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY w)) END AS h, (max(n) + 2) // 3 AS n FROM {of}{k} GROUP BY t, w // 3)")
        steps.append(f"""{path}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.w // 3 AS w, (p.n + 2) // 3 AS n, CASE WHEN p.n = 1 THEN f ELSE sha256(coalesce(a, '') || f || coalesce(z, '')) END AS f, proof || coalesce(a, '') || coalesce(z, '') AS proof)
FROM {path}{k} p JOIN (SELECT x.t, x.w, string_agg(y.h, '' ORDER BY y.w) FILTER (y.w < x.w) AS a, string_agg(y.h, '' ORDER BY y.w) FILTER (y.w > x.w) AS z FROM {of}{k} x JOIN {of}{k} y ON x.t = y.t AND x.w // 3 = y.w // 3 GROUP BY 1, 2) s ON s.t = p.t AND s.w = p.w)""")

    for k in range(levels):
        up(k, "l", "p")
    steps.append(f"r0 AS MATERIALIZED (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS w, count(*) OVER () AS n, h, t AS name FROM l{levels})")
    steps.append(f"q0 AS MATERIALIZED (SELECT doc_id, '' AS t, leaf, r0.w, r0.n, f, proof, r0.h AS subroot FROM p{levels} p JOIN r0 ON r0.name = p.t)")
    for k in range(above):
        up(k, "r", "q")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM q{above} CROSS JOIN r{above} r"


#: Unsigned crc32 of the decimal column i, bit by bit.
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(i::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))"""
CRC32 = f"xor({CRC32}, 4294967295)"

ORACLE_SQL = {
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1
""",
    "op12_merkle_manifest": merkle_sql(),
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS d, strlen(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS i FROM t),
c AS (SELECT i AS conv_id, {CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id AS i FROM o)),
b AS (SELECT c.conv_id, d, s, i FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
      UNION ALL SELECT c.conv_id, d, s, i + 100 FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
q AS (SELECT conv_id, list(d ORDER BY i) AS d, list(s ORDER BY i) AS s FROM b GROUP BY 1),
a AS (SELECT c.conv_id, coalesce(d, []) AS d, coalesce(s, []) AS s FROM c LEFT JOIN q USING (conv_id)),
x AS (SELECT conv_id, d, s, unnest(range(0, len(d) + 1)) AS depth FROM a),
n AS (SELECT depth, d[:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(s[depth]), 0) AS size,
      sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(d) = depth), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
k AS (SELECT c.depth - 1 AS depth, c.p[:c.depth - 1] AS p, count(*) AS n_children FROM n c WHERE c.depth > 0 GROUP BY 1, 2),
e AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.p = n.p),
u AS (SELECT *, unnest(range(0, depth + 1)) AS g FROM e),
w AS (SELECT g AS depth, p[:g] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM u GROUP BY 1, 2)
SELECT e.conv_id, e.depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, w.n_leaves, w.saved_tokens, e.ends_sha256
FROM e JOIN w ON w.depth = e.depth AND w.p = e.p LEFT JOIN e up ON up.depth = e.depth - 1 AND up.p = e.p[:e.depth - 1]
""",
    "op8_urls": r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT s.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM s JOIN r ON (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p)
  GROUP BY s.page_id
)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM s LEFT JOIN m USING (page_id)
""",
}

"""A training-corpus pipeline of five stages over whole documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
``run`` writes each result to the shared folder and reads it again.  The four filtering
stages return the columns of documents; the last returns one row of digests a document.

In every stage an empty table gives no rows, null and empty texts stay (they are encoded as
no ids), texts are taken whole however long, and columns besides doc_id and text go through
untouched under whatever names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, bwt, decontaminate, minhash, registry, toxicity
from scanloom.llm.lineage import cut, drop

#: No stage is expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all else as one column, so that no name meets an operator's own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("n"), *(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest))).alias("_rest"))


def _unpacked(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.c{rest.index(c)}").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text: repeated rows and
    rows with null or shared ids too.  It learns from the labels of ids that docs has."""
    labels = registry.table(spark, sf_dir, "labels").filter(registry.remainder(5) != 0)
    rows = _packed(docs)
    scored = toxicity.score(rows, toxicity.fit(rows, labels))
    return _unpacked(scored.filter("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id.

    Rows with a null doc_id and rows that share one count as documents of their own, known by
    a hash of doc_id and text instead; of those equal in both one stays, if it has words.
    """
    rows = _packed(docs)
    odd = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd_id"), F.lit(True).alias("_odd")), "odd-ids")
    if odd.isEmpty():
        extra = minhash.near_duplicates(rows).filter("not kept").select("doc_id")
        return _unpacked(rows.join(extra, "doc_id", "left_anti"), docs)
    known = rows.join(odd, rows["doc_id"].eqNullSafe(F.col("_odd_id")), "left")
    # Above all usual ids, so that those are kept rather.
    by_text = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1) + (1 << 62)
    known = cut(known.withColumn("_id", F.when(F.col("_odd"), by_text).otherwise(F.col("doc_id"))), "known")
    extra = minhash.near_duplicates(known.select(F.col("_id").alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
    rest = known.join(extra, "_id", "left_anti")
    repeated = F.coalesce(F.col("_odd") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = rest.filter(repeated).dropDuplicates(["_id"])
    return _unpacked(rest.filter(~repeated).unionByName(one), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out of the texts, of repeated rows too;
    n_chars, if it is there, follows (null for a null text)."""
    cut_docs = _unpacked(bwt.dedup_text(_packed(docs)), docs)
    return cut_docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut_docs


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; a text is known by its hash, so
    that rows with null or shared ids are judged by their own texts."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(texts, registry.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_text_hash")).distinct()
    return _unpacked(_packed(docs).withColumn("_text_hash", F.xxhash64("text")).join(leaks, "_text_hash", "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row, with null, shared and
    repeated ids as they are."""
    return bpe.encode_decode(docs, registry.tokenizer_path(), digest=True)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("suffix_array", cut_repeats), ("decontamination", drop_leaks), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

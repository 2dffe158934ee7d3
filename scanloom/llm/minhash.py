"""MinHash near-duplicates by a signature-coordinate inverted join.

Each document's set of five-word shingles gets a signature of ``COORDS`` minima.  Each
(coordinate, value) pair is posted with the documents that have it; pairs seen once
are dropped.  Two documents of similarity 0.75 collide in fewer than ``MATCHES``
coordinates with probability below 3e-6.  Postings are merged in the order of their
frequency: a document posts only its prefix, its rarest pairs but for MATCHES - 1 of
them, of which two matching documents must share one, and skips those of the long
lists.

No list is expanded into its pairs.  Equal sets stand as one representative.  In each
list the documents are held against one pivot, picked by a hash; collisions are counted
on whole signatures, and pairs above the match threshold ``RETAIN`` (well below MATCHES,
as a pivot may be less like either of two documents than they are like each other) tie
documents into families.  A list whose documents are then in several families is still
open (documents put together from passages that others share): those outside its largest
family are held against all the others, in blocks of ``BLOCK_DOCS``, and pairs of at
least MATCHES collisions join their families.  So every pair of MATCHES collisions is in
one family.  A family's full sets are dealt to tasks in blocks of ``BLOCK_SHINGLES``, each
with the family's ``PIVOTS`` pivots; a task counts common shingles by inverted lists and
returns the links that its documents need to hang together.  In a family of several blocks,
documents outside its largest component are then held against all of the family, in pairs
of blocks.  So each pair is either compared or in one component by other links, and many
copies of one text cost a comparison within blocks alone.  Components over the links are
the result.

Cases: null or empty texts and texts without words have an empty set and link with
nothing; fewer than five words make one shingle; rows that share a doc_id count as one
document; a null doc_id links with nothing and has a null component; extra columns
stay unread; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textbuf as tb
from scanloom.llm.components import components
from scanloom.llm.lineage import cut

COORDS = 40
MATCHES = 17
RETAIN = 10
BLOCK_SHINGLES = 1 << 20
BLOCK_DOCS = 1024
PIVOTS = 8
#: A pair is linked from this Jaccard similarity on, in hundredths.
PERCENT = 75
WIDTH = 5
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>"


def _keys(n: int) -> np.ndarray:
    return tb.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def signatures(docs: DataFrame, coords: int = COORDS) -> DataFrame:
    """doc_id, size of the shingle set, a 128-bit digest of the set and the signature
    (each coordinate's minimum, hashed with its number into one 64-bit pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _keys(coords)
        for batch in batches:
            buf, offs = tb.buffer(batch.column(1))
            for lo, hi in tb.groups(offs, 1 << 20):
                h, at = tb.shingles(*tb.words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), WIDTH)
                text = np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.lexsort((h, text))
                h = h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, text = h[first], text[first]
                n = np.bincount(text, minlength=hi - lo)
                full = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[full]
                sig = np.zeros((hi - lo, coords), np.uint64)
                digest = np.zeros((2, hi - lo), np.uint64)
                if len(full):
                    for j in range(coords):
                        sig[full, j] = tb.mix(np.minimum.reduceat((h ^ keys[j]) * np.uint64(0xE7037ED1A0B428DB) ^ (h >> np.uint64(29)), start) + keys[j])
                    digest[0, full] = np.add.reduceat(tb.mix(h ^ np.uint64(0x1234567)), start)
                    digest[1, full] = np.add.reduceat(tb.mix(h + np.uint64(0x89ABCDE)), start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * coords, pa.int32()), pa.array(sig.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def placed_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (doc_id, family, is, js, role, known) with the distinct shingle hashes of the
    documents' texts, a row for each pair of ``is`` and ``js``."""
    names = ["doc_id", "family", "is", "js", "role", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffer(batch.column(0))
            for lo, hi in tb.groups(offs, 1 << 20):
                h, at = tb.shingles(*tb.words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), WIDTH)
                sets = [np.unique(h[at[i] : at[i + 1]]).view(np.int64) for i in range(hi - lo)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), lists], [*names, "shingles"])

    # Hashed on placed at every size, as it grows with the documents; texts need no sort.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed.hint("shuffle_hash"), "doc_id").select("text", *names)
    sets = texts.mapInArrow(run, "doc_id long, family long, is array<int>, js array<int>, role int, known long, shingles array<long>")
    each = sets.select("family", F.explode("is").alias("i"), "js", "doc_id", "role", "known", "shingles")
    return each.select("family", "i", F.explode("js").alias("j"), "doc_id", "role", "known", "shingles")


def linked(ids: np.ndarray, role: np.ndarray, known: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that hang together what is similar among some documents, each given by its
    id, role, known component, set size and (one after another) shingles.  Documents of
    role 1 are held against those of role 2, those of role 0 against each other."""
    n = len(ids)
    doc = np.repeat(np.arange(n), sizes)
    _, code, often = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = often[code] > 1
    doc, code = doc[shared], code[shared]
    by = np.argsort(code, kind="stable")
    start = np.searchsorted(code[by], np.arange(len(often) + 1))
    lists = doc[by]
    cuts = np.searchsorted(doc, np.arange(n + 1))
    parts, part = np.unique(known, return_inverse=True)
    parent = list(range(len(parts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in np.flatnonzero(role < 2):
        mine = code[cuts[i] : cuts[i + 1]]
        if 100 * len(mine) < percent * sizes[i]:
            continue
        length = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(lists[at], minlength=n)
        near = (100 * common >= percent * (sizes[i] + sizes - common)) & (part != part[i])
        if role[i]:
            near &= role == 2
        else:
            near[:i] = False
        for j in np.flatnonzero(near):
            a, b = root(int(part[i])), root(int(part[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def links(sets: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) found in each group (family, i, j) of placed sets."""

    def judged(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        doc, role, known = (table.column(c).to_numpy() for c in ("doc_id", "role", "known"))
        lists = table.column("shingles").combine_chunks()
        offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        out = []
        for lo, hi in zip(group[:-1], group[1:], strict=True):
            if hi - lo > 1:
                out += linked(doc[lo:hi], role[lo:hi], known[lo:hi], np.diff(offs[lo : hi + 1]), values[offs[lo] : offs[hi]], percent)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (*batches, None):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += len(batch.column(batch.num_columns - 1).flatten())
            if held and (batch is None or size > block_shingles):
                table = pa.Table.from_batches(held).combine_chunks()
                family, i, j = (table.column(c).to_numpy() for c in ("family", "i", "j"))
                new = np.ones(len(i), bool)
                new[1:] = (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
                group = np.flatnonzero(new)
                # The last group may go on in the next batch.
                done = len(i) if batch is None else int(group[-1])
                if done:
                    yield judged(table.slice(0, done).combine_chunks(), np.append(group[group < done], done))
                held = table.slice(done).to_batches()
                size = sum(len(b.column(b.num_columns - 1).flatten()) for b in held)

    keys = ("family", "i", "j")
    return sets.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, "a long, b long")


def similar(families: DataFrame, docs: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, component) over the links of documents in families (doc_id, family, size).

    Each block of a family is looked at by itself, together with the family's ``PIVOTS``
    pivots, through which the blocks of many near copies hang together.  What is then
    outside a family's largest component is held against all of the family."""
    number = lambda n: F.ceil(n / block_shingles).cast("int")
    block = lambda m: F.pmod(F.xxhash64("doc_id"), m).cast("int")
    every = lambda m: F.sequence(F.lit(0), m - 1)
    # Few families are that large; written, so that a join by family has rows alone on
    # either side and Spark can split it.
    total = cut(families.groupBy("family").agg(F.sum("size").alias("total")).filter(F.col("total") > block_shingles), "family-sizes")
    dealt = families.join(total, "family", "left").withColumn("blocks", F.coalesce(number(F.col("total")), F.lit(1)))
    large = dealt.filter("blocks > 1")
    pivots = large.groupBy("family", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PIVOTS)).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("pivot"))
    own = F.when(F.col("pivot"), every(F.col("blocks"))).otherwise(F.array(block(F.col("blocks"))))
    zero = F.array(F.lit(0))
    placed = dealt.join(pivots, "doc_id", "left").select("doc_id", "family", own.alias("is"), zero.alias("js"), F.lit(0).alias("role"), F.col("doc_id").alias("known"))
    found = cut(links(placed_sets(docs, cut(placed, "placed")), percent, block_shingles), "similar")
    first = components(found)

    members = large.select("doc_id", "family", "size").join(first, F.col("doc_id") == first["node"], "left").select("doc_id", "family", "size", F.coalesce("component", "doc_id").alias("known"))
    per = members.groupBy("family", "known").agg(F.sum("size").alias("size"))
    most = per.groupBy("family").agg(F.sum("size").alias("total"), F.max("size").alias("most"), F.max_by("known", F.struct("size", "known")).alias("main")).filter("most < total")
    still = members.drop("size").join(most, "family")
    few, many = number(F.col("total") - F.col("most")), number(F.col("total"))
    asks = still.filter("known <> main").select("doc_id", "family", F.array(block(few)).alias("is"), every(many).alias("js"), F.lit(1).alias("role"), "known")
    asked = still.select("doc_id", "family", every(few).alias("is"), F.array(block(many)).alias("js"), F.lit(2).alias("role"), "known")
    again = cut(asks.union(asked), "placed")
    if again.isEmpty():
        return first
    return components(found.union(links(placed_sets(docs, again), percent, block_shingles)))


def joined_families(members: DataFrame, reps: DataFrame, matches: int = MATCHES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pairs (a, b) of families that hold two documents of one posting list (rows pair,
    rep, family) with at least that many collisions; as many as tie them together."""
    per = members.groupBy("pair", "family").agg(F.count("*").alias("n"))
    lists = per.groupBy("pair").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("family", F.struct("n", "family")).alias("main"))
    # A list of two was settled by its pivot.
    still = cut(members.join(lists.filter("n > 2 and most < n"), "pair"), "open-lists")
    number = lambda n: F.ceil(n / block_docs).cast("int")
    block = lambda m: F.pmod(F.xxhash64("rep"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    few, many = number(F.col("n") - F.col("most")), number(F.col("n"))
    left = still.filter("family <> main").select("pair", block(few).alias("i"), every(many).alias("j"), "rep", "family", F.lit(True).alias("asks"))
    right = still.select("pair", every(few).alias("i"), block(many).alias("j"), "rep", "family", F.lit(False).alias("asks"))
    rows = left.union(right).join(reps.select("rep", "signature"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        asks, family = (table.column(c).to_numpy() for c in ("asks", "family"))
        signature = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
        others, whose = signature[~asks], family[~asks]
        a, b = [], []
        for mine, own in zip(signature[asks], family[asks].tolist(), strict=True):
            near = (whose != own) & ((others == mine).sum(1) >= matches)
            for other in np.unique(whose[near]).tolist():
                a.append(own)
                b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = rows.groupBy("pair", "i", "j").applyInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, coords: int = COORDS, matches: int = MATCHES, percent: int = PERCENT, retain: int = RETAIN, block_shingles: int = BLOCK_SHINGLES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept
    (whether doc_id is that) for each row."""
    signed = cut(signatures(docs, coords), "signatures")
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = cut(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")), "representatives")

    posted = reps.select("rep", F.explode("signature").alias("pair"))
    # Written, as pivots below, so that Spark can split a pair that very many documents post.
    often = cut(posted.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    lists = posted.join(often, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("pairs")).filter(F.size("pairs") >= matches)
    prefix = F.slice("pairs", F.lit(1), F.size("pairs") - (matches - 1))
    postings = cut(lists.select("rep", F.explode(prefix).alias("p")).select("rep", F.col("p.pair").alias("pair")), "postings")

    sa, sb = (reps.select(F.col("rep").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    pivots = postings.groupBy("pair").agg(F.min_by("rep", F.xxhash64("pair", "rep")).alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    pivots = cut(pivots, "pivots")
    tried = postings.join(pivots, "pair").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    kept = tried.join(sa, "a").join(sb, "b").filter(F.size(F.array_intersect("sig_a", "sig_b")) >= retain).select("a", "b")
    first = components(kept)
    tied = cut(reps.select("rep", "size").join(first, F.col("rep") == first["node"], "left").select("rep", "size", F.coalesce("component", "rep").alias("family")), "tied")
    more = components(joined_families(postings.join(tied.select("rep", "family"), "rep"), reps, matches, block_docs))
    families = tied.join(more, F.col("family") == more["node"], "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "family").alias("family"), "size")
    families = cut(families, "families")
    several = cut(families.groupBy("family").agg(F.count("*").alias("n")).filter("n > 1").select("family"), "several")
    final = similar(cut(families.join(several, "family"), "members"), docs, percent, block_shingles)

    named = reps.select("d1", "d2", "rep").join(final, F.col("rep") == final["node"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("group_id"))
    out = signed.join(named, ["d1", "d2"], "left")
    group = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("group_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

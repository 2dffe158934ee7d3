"""A trie of conversations by their turns, as balanced parentheses per shard.

Each conversation is a path: 16 bytes of digest a turn.  Paths are range-partitioned in
order, so that a shard holds consecutive paths and its trie is written down as one sequence
of parentheses.  ``findclose`` on a tree of block minima of the excess delimits each
subtree; the rank of leaf pairs and cumulative arrays in preorder give its leaves, members
and savings.  Nodes on a shard's first and last path, its spines, may go on in the shards
beside it: each spine becomes a path with the sums of what hangs at its nodes, and the
spines of all shards are again sorted, sharded and merged by the same step, until one shard
is left.  Ids that end at spine nodes go on as pieces, hashed in order at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.lineage import cut

#: Turns of a shard, and parentheses of a block.
TURNS = 1 << 18
BLOCK = 64
WIDTH = 16
NONE = np.iinfo(np.int64).max
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("members", "lowest", "children", "leaves", "saved")
OUT = (
    "kind string, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "path binary, sizes array<long>, shard int, side int, members array<long>, lowest array<long>, children array<long>, leaves array<long>, saved array<long>, ids string"
)
ARRAYS = pa.list_(pa.int64())
TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "array<long>": ARRAYS}
FIELDS = {x.split()[0]: TYPES[x.split()[1]] for x in OUT.split(", ")}


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, ``d`` (hex digests of its turns in order) and ``s`` (bytes of their texts).
    null turns first, equal ones by digest; null role or text is empty; no id, no conversation."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    told = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    cells = rows.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("t"), F.md5(told.cast("binary")).alias("d"), F.octet_length(said).cast("long").alias("s")).alias("cell"))
    ordered = cells.groupBy("conv_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return ordered.select("conv_id", F.transform("cells", lambda c: c["d"]).alias("d"), F.transform("cells", lambda c: c["s"]).alias("s"))


def rebuilt(convs: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """convs whose first ``head`` turns (``most`` at most) are those of the conversation ``donor``."""
    given = convs.select(F.col("conv_id").alias("_donor"), F.slice("d", 1, most).alias("_d"), F.slice("s", 1, most).alias("_s"))
    asked = convs.withColumn("_h", head.cast("int")).withColumn("_donor", donor)
    rows = asked.join(given, "_donor", "left")
    empty = F.array()

    def joined(own: str, other: str, kind: str) -> Column:
        first = F.coalesce(F.slice(other, F.lit(1), F.col("_h")), empty.cast(kind))
        return F.concat(first, F.slice(own, F.col("_h") + 1, F.size(own)))

    return rows.select("conv_id", joined("d", "_d", "array<string>").alias("d"), joined("s", "_s", "array<long>").alias("s"))


def find_close(bits: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Place of the parenthesis that closes each opening one: in its block, or else in the
    first later block whose least excess is low enough, found on a tree of minima."""
    excess = np.cumsum(np.where(bits, 1, -1))
    blocks = -(-len(bits) // BLOCK)
    padded = np.full(blocks * BLOCK, NONE)
    padded[: len(bits)] = excess
    table = padded.reshape(blocks, BLOCK)
    levels = [table.min(1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.r_[low, NONE] if len(low) % 2 else low
        levels.append(low.reshape(-1, 2).min(1))
    out, goal = np.empty(len(opens), np.int64), excess[opens] - 1

    def within(which: np.ndarray, block: np.ndarray, after: np.ndarray) -> np.ndarray:
        hit = (table[block] <= goal[which, None]) & (np.arange(BLOCK) > after[:, None])
        out[which] = block * BLOCK + hit.argmax(1)
        return hit.any(1)

    for lo in range(0, len(opens), 1 << 14):
        which = np.arange(lo, min(lo + (1 << 14), len(opens)))
        block = opens[which] // BLOCK
        far = which[~within(which, block, opens[which] % BLOCK)]
        if not len(far):
            continue
        node, level, found = opens[far] // BLOCK, np.zeros(len(far), np.int64), np.zeros(len(far), bool)
        for k in range(len(levels)):  # up, to the first right neighbour that goes low enough
            up = np.flatnonzero(~found)
            beside = node[up] + 1
            right = (node[up] % 2 == 0) & (beside < len(levels[k]))
            right[right] = levels[k][beside[right]] <= goal[far[up[right]]]
            node[up], level[up], found[up] = np.where(right, beside, node[up] // 2), np.where(right, k, k + 1), right
        while (down := np.flatnonzero(level > 0)).size:
            left = node[down] * 2
            rows = np.array([levels[k - 1][x] for k, x in zip(level[down], left, strict=True)])
            node[down], level[down] = np.where(rows <= goal[far[down]], left, left + 1), level[down] - 1
        within(far, node, np.full(len(far), -1))
    return out


class Shard:
    """The trie of sorted paths: ``depth``, ``parent`` and subtree ``size`` of each node in
    preorder, the leaf pairs' rank, and each path's ``end`` node and length shared with the one before."""

    def __init__(self, digests: np.ndarray, sizes: np.ndarray, offs: np.ndarray):
        lens = np.diff(offs)
        m = len(lens)
        shared = np.zeros(m, np.int64)
        both = np.minimum(lens[:-1], lens[1:])
        pair = np.repeat(np.arange(m - 1), both)
        j = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
        differ = (digests[offs[:-2][pair] + j] != digests[offs[1:-1][pair] + j]).any(1) if len(pair) else np.zeros(0, bool)
        shared[1:] = both
        np.minimum.at(shared, pair[differ] + 1, j[differ])
        new = lens - shared
        closing = np.r_[0, lens[:-1] - shared[1:]]
        runs = np.stack([closing, new], 1).reshape(-1)
        self.bits = np.r_[True, np.repeat(np.tile([False, True], m), runs), np.zeros(lens[-1] + 1, bool)]
        opens = np.flatnonzero(self.bits)
        n = len(opens)
        self.first = 1 + np.cumsum(new) - new
        k = np.arange(n)
        at = np.arange(new.sum()) - np.repeat(self.first - 1, new)
        self.depth = np.r_[0, np.repeat(shared, new) + at + 1]
        self.weight = np.r_[0, sizes[np.repeat(offs[:-1] + shared, new) + at]]
        self.digest = digests[np.repeat(offs[:-1] + shared, new) + at]
        self.size = (find_close(self.bits, opens) - opens + 1) // 2
        order = np.sort(self.depth * n + k)
        self.parent = order[np.searchsorted(order, (self.depth - 1) * n + k) - 1] % n
        self.parent[0] = 0
        self.leaf = ~self.bits[opens + 1]  # a pair ()
        # A path without new nodes is equal to the one before, or empty.
        self.end = np.maximum.accumulate(np.where(new > 0, self.first + new - 1, 0))
        self.shared, self.lens, self.n = shared, lens, n

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        sums = np.r_[0, np.cumsum(values)]
        k = np.arange(self.n)
        return sums[k + self.size] - sums[k]

    def least(self, values: np.ndarray) -> np.ndarray:
        """Minimum over each node's subtree, from minima of runs of powers of two."""
        out, table, k, step = np.empty(self.n, np.int64), values, np.arange(self.n), 1
        while step <= self.n:
            here = np.flatnonzero((self.size >= step) & (self.size < 2 * step))
            out[here] = np.minimum(table[k[here]], table[k[here] + self.size[here] - step])
            table = np.minimum(table[:-step], table[step:]) if len(table) > step else table[:0]
            step *= 2
        return out

    def path(self, i: int, before: np.ndarray) -> np.ndarray:
        """Nodes of the i-th path, root first, from those of the one before."""
        return np.r_[before[: self.shared[i] + 1], self.first[i] + np.arange(self.lens[i] - self.shared[i])]


def chained(start: bytes, digests: np.ndarray) -> list[bytes]:
    """Keys of the nodes on a path: each hashes the one above and its own digest."""
    out = [start]
    for d in digests:
        out.append(hashlib.blake2b(out[-1] + d.tobytes(), digest_size=16).digest())
    return out


def ids_hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else NOTHING


def table(columns: dict, n: int, **fixed) -> pa.Table:
    """A table of the step's result; columns that are not given are null."""
    given = columns | {c: [fixed.get(c)] * n for c in FIELDS if c not in columns}
    arrays = [given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], kind) for c, kind in FIELDS.items()]
    return pa.Table.from_arrays(arrays, names=list(FIELDS))


def step(rows: pa.Table, shard: int, ground: bool, final: bool) -> Iterator[pa.Table]:
    """One shard: finished nodes, spines with the sums that hang at them, and pieces of ids.

    ``ground``: rows are conversations, else spines.  ``final``: there are no other shards.
    """
    m = len(rows)
    lists = rows["sizes"].combine_chunks()
    sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    digests = np.frombuffer(b"".join(rows["path"].to_pylist()), "<u8").reshape(-1, 2)
    t = Shard(digests, sizes, offs)
    own = {c: np.zeros(t.n, np.int64) for c in SUMS} | {"lowest": np.full(t.n, NONE)}
    keys = None
    if ground:
        convs = rows["conv_id"].to_numpy()
        own["members"] = np.bincount(t.end, minlength=t.n)
        np.minimum.at(own["lowest"], t.end, convs)
    else:
        given = {c: rows[c].combine_chunks() for c in SUMS}
        keys, nodes = [b""] * t.n, np.zeros(1, np.int64)
        keys[0] = bytes(16)
        for i in range(m):
            nodes = t.path(i, nodes)
            for c in SUMS:
                (np.minimum if c == "lowest" else np.add).at(own[c], nodes, given[c][i].values.to_numpy())
            fresh = nodes[t.shared[i] + 1 :]
            for node, key in zip(fresh, chained(keys[nodes[t.shared[i]]], t.digest[fresh - 1])[1:], strict=True):
                keys[node] = key

    members, lowest = t.total(own["members"]), t.least(own["lowest"])
    children = own["children"] + np.bincount(t.parent[1:], minlength=t.n)
    leaves_here = (t.leaf & (own["children"] == 0)).astype(np.int64)
    saved_here = (members - 1) * t.weight
    leaves, saved = t.total(own["leaves"] + leaves_here), t.total(own["saved"] + saved_here)
    k = np.arange(t.n)
    spine = np.zeros(t.n, bool) if final else (k <= t.lens[0]) | (k + t.size == t.n)

    at = np.flatnonzero(~spine)
    above = t.parent[at]
    inner = ~spine[above] & (at > 0)
    left_nodes = np.arange(t.lens[0] + 1)
    right_nodes = np.flatnonzero(k + t.size == t.n)
    spine_keys = {}
    if not final:
        for nodes in (left_nodes, right_nodes):
            spine_keys |= dict(zip(nodes.tolist(), chained(bytes(16), t.digest[nodes[1:] - 1]), strict=True))
    parents = lowest[above]
    columns = {
        "conv_id": lowest[at], "depth": t.depth[at], "parent_conv_id": pa.array(parents, pa.int64(), mask=~inner), "key": [keys[x] for x in at] if keys else [None] * len(at),
        "parent_key": [None if i or x == 0 else spine_keys[p] for i, x, p in zip(inner.tolist(), at.tolist(), above.tolist(), strict=True)],
        "n_convs": members[at], "n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at],
    }
    if ground:
        starts, stops = np.searchsorted(t.end, at, "left"), np.searchsorted(t.end, at, "right")
        columns["ends_sha256"] = [ids_hash(convs[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    yield table(columns, len(at), kind="node")
    if final:
        return

    hanging = at[spine[above]]
    to = t.parent[hanging]
    for c, values in (("members", members), ("leaves", leaves), ("saved", saved), ("children", np.ones(t.n, np.int64))):
        np.add.at(own[c], to, values[hanging])
    np.minimum.at(own["lowest"], to, lowest[hanging])
    for side, nodes in enumerate((left_nodes, right_nodes)):
        mine = k[nodes] > t.lens[0] if side else np.ones(len(nodes), bool)
        if mine.any():
            sums = {c: pa.array([np.where(mine, own[c][nodes], NONE if c == "lowest" else 0)], ARRAYS) for c in SUMS}
            along = {"path": [t.digest[nodes[1:] - 1].tobytes()], "sizes": pa.array([t.weight[nodes[1:]]], ARRAYS), "shard": [shard], "side": [side]}
            yield table(along | sums, 1, kind="spine")
    if ground:
        ended = [(node, a, b) for node in spine_keys if (a := np.searchsorted(t.end, node, "left")) < (b := np.searchsorted(t.end, node, "right"))]
        pieces = {"key": [spine_keys[x] for x, _, _ in ended], "ids": [",".join(map(str, convs[a:b].tolist())) for _, a, b in ended]}
        yield table(pieces, len(ended), kind="piece", shard=shard)


def _steps(paths: DataFrame, parts: int, order: list[str], ground: bool) -> DataFrame:
    """step() for each of ``parts`` runs of sorted paths."""
    final = parts == 1 and not ground

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for out in step(pa.Table.from_batches(held), TaskContext.get().partitionId(), ground, final):
                yield from out.to_batches()

    dealt = paths.repartition(1) if final else paths.repartitionByRange(parts, *order)
    return cut(dealt.sortWithinPartitions(*order).mapInArrow(run, OUT), "trie-step")


def _ends(pieces: DataFrame) -> DataFrame:
    """The SHA-256 of each key's pieces in order, comma-joined, read as a stream."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(done)
        if state is not None:
            yield told([(last, state.hexdigest())])

    def told(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "sha"])

    ordered = pieces.select("key", "shard", "ids").repartition("key").sortWithinPartitions("key", "shard")
    return ordered.select("key", "ids").mapInArrow(fold, "key binary, sha string")


def trie(convs: DataFrame, shard_turns: int = TURNS) -> DataFrame:
    """The nodes of the trie of convs (conv_id, d, s as turns() gives them): conv_id (the
    least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    Rows of one conv_id are one member each; conversations without turns are members of the
    root alone.  Without conversations there is no node.  A conversation's turns are held in
    one row, 16 bytes and a size each.
    """
    paths = cut(convs.select("conv_id", F.unhex(F.array_join("d", "")).alias("path"), F.col("s").alias("sizes")), "paths")
    count = F.sum(F.size("sizes") + 1)
    spark = convs.sparkSession
    total = paths.agg(count).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // shard_turns))
    ground = _steps(paths, parts, ["path", "conv_id"], True)
    done, spines, last = [], ground.filter("kind = 'spine'"), 0
    while total := spines.agg(count).first()[0] or 0:
        parts = -(-total // shard_turns)
        if last and parts >= last:  # long spines of two paths may fill a shard each
            parts = 1
        done.append(out := _steps(spines, parts, ["path", "shard", "side"], False))
        spines, last = out.filter("kind = 'spine'"), parts
        if parts == 1:
            break

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = ground.filter("kind = 'node'")
    if not done:
        return nodes.select(*columns)
    keyed = done[0]
    for out in done[1:]:
        keyed = keyed.union(out)
    keyed = keyed.filter("kind = 'node'")
    ends = _ends(ground.filter("kind = 'piece'"))
    keyed = keyed.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING)))
    keyed = cut(keyed.select(*columns, "key", "parent_key"), "trie-keyed")
    above = keyed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    open_ = nodes.select(*columns, "parent_key").union(keyed.select(*columns, "parent_key"))
    found = open_.filter("parent_key is not null").join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("_above"))
    return open_.filter("parent_key is null").select(*columns).union(found.select(*columns))

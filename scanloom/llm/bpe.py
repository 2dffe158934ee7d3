"""Byte-level BPE encoding and decoding of whole texts, with tree concatenation.

The vocabulary is a ``tokenizers`` JSON file (its path is a parameter; every task
opens it on its own machine).  Texts up to ``long_chars`` characters are encoded in
one go.  A longer text is cut into segments that become rows of their own, so that
tasks encode them in parallel; the segments' ids are then joined pairwise, as a tree:
around each join a window of ids is decoded, encoded again and grown until its first
ids equal those of the left part and its last ids those of the right part.  Two runs
of BPE ids may be joined wherever each neighbouring pair is what BPE itself yields,
so agreement on both sides makes the joined ids equal to one encoding of the text.

Cases: null and empty texts have no ids and decode to an empty text; a special token's
string in a text becomes its id, as in the library; repeated rows give repeated rows;
an empty table gives an empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CHARS = 1 << 16
SEGMENT_CHARS = 1 << 15
WINDOW = 8
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        split = spec["pre_tokenizer"] or {}
        if made != sorted(made) or spec.get("normalizer") or split.get("add_prefix_space"):
            raise ValueError(f"{path}: ids don't follow the order of merges, or text is changed before it is split")
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError(f"{path}: text is not split by the pattern of byte-level BPE")
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.decimal = [str(i) for i in range(self.core.n_vocab)]
        self.longest_special = max(map(len, self.special), default=0)

    def encode(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        return self.core.decode(ids)

    def cuts(self, text: str, size: int) -> list[int]:
        """Places to cut a long text: before a space after a word, else within a run."""
        out, at = [0], size
        while at < len(text) - size // 2:
            back = next((i for i in range(at, max(at - size // 4, out[-1] + 1), -1) if text[i].isspace() and not text[i - 1].isspace()), 0)
            cut = back or self._inside(text, at, out[-1] + 1)
            if cut:
                out.append(cut)
            at = (cut or at) + size
        return [*out, len(text)]

    def _inside(self, text: str, at: int, least: int) -> int:
        """The nearest place from ``at`` backwards where an unsplit run may be cut:
        amid four letters or digits, or marks other than quotes, not in a special."""
        for i in range(at, max(least + 3, at - 4096), -1):
            a, b = text[i - 3 : i], text[i]
            same = (a + b).isalpha() or (a + b).isdecimal() or not any(c.isalnum() or c.isspace() or c == "'" for c in a + b)
            near = text[max(0, i - self.longest_special) : i + self.longest_special]
            if same and not any(s in near for s in self.special):
                return i
        return 0

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined texts: windows around the join grow until both sides agree."""
        if not left or not right:
            return left + right
        w = WINDOW
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            raw = self.core.decode_bytes(left[a:] + right[:b])
            try:
                ids = self.encode(raw.decode("utf-8"))
            except UnicodeDecodeError:
                if a == 0 and b == len(right):
                    raise
                w += 1
                continue
            if (a == 0 or ids[:2] == left[a : a + 2]) and (b == len(right) or ids[-2:] == right[b - 2 : b]):
                return left[:a] + ids + right[b:]
            w *= 2

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """Join neighbouring parts pairwise until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def result(self, ids: list[int], digest: bool) -> tuple:
        text = self.decode(ids)
        if not digest:
            return len(ids), ids, text
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), sha(",".join(map(self.decimal.__getitem__, ids)).encode()), sha(text.encode())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    doc, n, a, b = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])],
        ["doc_id", "n_tokens", *names],
    )


def encode_decode(docs: DataFrame, path: str, digest: bool = False, long_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per row of docs: its ids and the text decoded from them, or with
    ``digest`` the SHA-256 of the ids (decimal, joined by commas) and of that text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = DIGEST_SCHEMA if digest else IDS_SCHEMA

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows([(d, *c.result(c.encode(t), digest)) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], digest)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cuts = c.cuts(text, segment_chars)
                for i in range(len(cuts) - 1):
                    yield pa.RecordBatch.from_pydict({"key": [key], "at": pa.array([i], pa.int32()), "part": [text[cuts[i] : cuts[i + 1]]]})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, at, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"key": [key], "at": pa.array([at], pa.int32()), "ids": [np.array(c.encode(part), np.int32).tobytes()]})

    def joined(table: pa.Table) -> pa.Table:
        c = codec(path)
        table = table.sort_by("at")
        ids = c.concatenate([np.frombuffer(x, np.int32).tolist() for x in table.column("ids").to_pylist()])
        out = pa.Table.from_batches([_rows([(None, *c.result(ids, digest))], digest)])
        return out.set_column(0, "key", table.column("key").slice(0, 1))

    is_long = F.length("text") > long_chars
    brief = docs.filter(~is_long).mapInArrow(short, schema)
    # A repeated long text is encoded once; its rows come back by the digest of the text.
    lengthy = docs.filter(is_long).withColumn("key", F.sha2("text", 256))
    parts = lengthy.groupBy("key").agg(F.max("text").alias("text")).mapInArrow(segments, "key string, at int, part string")
    ids = parts.repartition("key", "at").mapInArrow(encoded, "key string, at int, ids binary")
    whole = ids.groupBy("key").applyInArrow(joined, schema.replace("doc_id long", "key string"))
    rest = [x.split(" ")[0] for x in schema.split(", ")[1:]]
    return brief.unionByName(lengthy.select("doc_id", "key").join(whole, "key").select("doc_id", *rest))

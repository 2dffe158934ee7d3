"""URL filter: a trie over reversed host labels, then path segments, broadcast.

Rules are few and bounded (``MAX_RULES``, checked), so each task gets the whole trie.
A rule fits its host and all its subdomains if the url's path starts with the rule's
path; of all that fit the longest wins (host labels first, then path), and of equal
ones the block entry.  Urls that no rule fits get the method's default, allow.

Cases: a null url or one without ``://`` has an empty host and path, which no rule
fits; an empty table gives an empty one; repeated rows give repeated rows; columns
other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_RULES = 100_000
DEFAULT = "allow"
#: What the registered query applies: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_AFTER = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _AFTER.match(rest).groups()
    return host.translate(_UPPER), path


class Node:
    __slots__ = ("next", "paths")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.paths: PathNode | None = None


class PathNode:
    """After some whole segments: rules ending in a piece of the next one, by length."""

    __slots__ = ("next", "ends")

    def __init__(self):
        self.next: dict[str, PathNode] = {}
        self.ends: dict[str, tuple[str, str]] = {}


def build(rules: list[tuple[str, str, str]]) -> Node:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast and holds {MAX_RULES} at most")
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.next.setdefault(label, Node())
        node.paths = at = node.paths or PathNode()
        *whole, last = path.split("/")
        for segment in whole:
            at = at.next.setdefault(segment, PathNode())
        if at.ends.get(last, ("", ""))[1] != "block":
            at.ends[last] = (host + path, verdict)
    return root


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    node, found = root, None
    segments = path.split("/")
    for label in reversed(host.split(".")) if host else ():
        node = node.next.get(label)
        if node is None:
            break
        at = node.paths
        for segment in segments:  # deeper and longer ends are found later and win
            if at is None:
                break
            ends = [e for e in at.ends if segment.startswith(e)]
            if ends:
                found = at.ends[max(ends, key=len)]
            at = at.next.get(segment)
    return found


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule that decided (null: none) and verdict of each row."""
    build(rules)  # refuses too many before they are sent
    trie = pages.sparkSession.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = build(trie.value)
        for batch in batches:
            cut = [split_url(u) for u in batch.column(1).to_pylist()]
            got = [match(root, h, p) or (None, DEFAULT) for h, p in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array([x[i] for x in rows], pa.string()) for rows in (cut, got) for i in (0, 1))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(judge, SCHEMA)

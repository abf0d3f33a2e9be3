"""Operator 4: URL filter. A trie over reversed host labels and then path segments; the longest fitting rule wins.

Rules are few and curated; the trie is sent to the executors only while its text stays within ``max_rule_bytes`` (else
ValueError: split the list by host and call the operator for each part). Pages are judged in one narrow pass, without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the default verdict. An empty
table gives an empty table. Repeated rows are judged one by one. Of two rules with one (host, path) the later in the list wins.
Only the id and url columns are read; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_or_null, trimmed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host: between the first :// and / ? # or the end, A-Z lower-cased. Path: from there to ? # or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


@dataclass
class Node:
    """A trie node. ``stubs``: what a rule asks of the text after this node ('' : nothing), with its name and verdict."""

    hosts: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    stubs: dict[str, tuple[str, str]] = field(default_factory=dict)


def build_trie(rules: list[tuple[str, str, str]]) -> Node:
    """rules: (verdict, host, path)."""
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(LOWER).split(".")):
            node = node.hosts.setdefault(label, Node())
        *whole, stub = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.stubs[stub] = (host + path, verdict)
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels, then the longest path, that fits. Deeper host nodes are tried later and so win."""
    best, node = None, root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.hosts.get(label)
        if node is None:
            break
        at, rest = node, path
        for segment in [*segments, None]:
            fits = [s for s in at.stubs if rest.startswith(s)]
            if fits:
                best = at.stubs[max(fits, key=len)]
            at = None if segment is None else at.segments.get(segment)
            if at is None or len(rest) <= len(segment):  # the last segment has no slash after it
                break
            rest = rest[len(segment) + 1 :]
    return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_column: str = "page_id", url_column: str = "url", max_rule_bytes: int = 64 << 20) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict."""
    if sum(len(x) for r in rules for x in r) > max_rule_bytes:
        raise ValueError("the rules exceed max_rule_bytes; split them by host")
    sc = pages.sparkSession.sparkContext
    trie = sc.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [longest_match(trie.value, h, p) if h else None for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                names=[id_column, "host", "path", "rule", "verdict"],
            )

    return columns_or_null(pages, **{id_column: "long", url_column: "string"}).mapInArrow(trimmed(judge), f"`{id_column}` long, host string, path string, rule string, verdict string")

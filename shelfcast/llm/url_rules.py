"""URL filter: a trie over reversed host labels and path segments, sent to every task.

The rule list is the caller's own configuration and is bounded by ``most_rules``; the URLs are
judged in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULES = [  # fixed values: verdict, host, path prefix
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for i, c in enumerate(rest):
        if c in "?#":
            return _lower(rest[:i]), ""
        if c == "/":
            tail = rest[i:]
            cuts = [k for k in (tail.find("?"), tail.find("#")) if k >= 0]
            return _lower(rest[:i]), tail[:min(cuts)] if cuts else tail
    return _lower(rest), ""


def _lower(host: str) -> str:
    return host if host.islower() and host.isascii() else "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


class Trie:
    """Nodes are ``[children by host label, path node or None]``; a path node is
    ``[children by whole segment, entries that end inside a segment]``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            at = node[1]
            *whole, last = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            # of two entries for the same place the block entry holds
            if at[1].get(last, ("allow",))[0] != "block":
                at[1][last] = (verdict, host + path)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The fitting entry with the longest rule; of equally long ones that with the longer
        host."""
        best, node = None, self.root
        segments = path.split("/")
        labels = host.split(".")
        for label in reversed(labels):
            node = node[0].get(label)
            if node is None:
                break
            at = node[1]
            for segment in segments:
                if at is None:
                    break
                for begin, entry in at[1].items():
                    if segment.startswith(begin) and (
                            best is None or len(entry[1]) >= len(best[1])):
                        best = entry
                at = at[0].get(segment)
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES,
               default: str = "allow", id_column: str = "page_id", url_column: str = "url",
               most_rules: int = 1_000_000) -> DataFrame:
    """One row per input row: id, host, path, rule (null without a fitting one) and verdict.

    A rule ``(verdict, host, path)`` fits its host and all subdomains when the path starts with
    the rule's.  The longest rule wins; URLs that no rule fits get ``default``.  Null URLs and
    URLs without ``://`` have an empty host and path and get ``default``; null ids and repeated
    rows pass through; an empty table gives an empty result; other columns are not read.
    """
    rules = list(rules)
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; at most {most_rules} are sent to every task")
    sent = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches):
        trie = sent.value
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                entry = trie.longest(host, path) if host else None
                hosts.append(host)
                paths.append(path)
                found.append(entry[1] if entry else None)
                verdicts.append(entry[0] if entry else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in (
                    hosts, paths, found, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
    ).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")

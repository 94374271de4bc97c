"""URL filter: one broadcast trie over reversed host labels and path segments, longest match wins.

Edge cases: a null url or one without ``://`` has an empty host and path and matches no
rule; no rule gives the default verdict; rows repeat as they come; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.common import Scratch

#: A trie is broadcast, so a trie has a bound; more rules are judged in parts.
MAX_RULE_CHARS = 64_000_000

FIELDS = "page_id long, host string, path string, at_host string, at_path string, verdict string"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains; ``path`` is a prefix of the url's path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """``allow com/`` or ``block example.com/en/``, one a line."""
    rules = []
    for line in lines:
        verdict, _, target = line.strip().partition(" ")
        host, slash, rest = target.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule starts with allow or block: {line!r}")
        rules.append(Rule(verdict, host.lower(), slash + rest))
    return rules


class _Node:
    """``down`` by label or segment; ``paths`` is a host's first path node; ``ends`` are the last path pieces of rules."""

    __slots__ = ("down", "ends", "lengths", "paths")

    def __init__(self):
        self.down: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.ends: dict[str, Rule] = {}
        self.lengths: list[int] = []


class Trie:
    """Host labels from the top-level domain down, then path segments.

    A rule's last path piece may end inside a segment (``/en``); such ends hang on the
    node of the segments before it, and a url fits when its next segment starts with it.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.down.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *segments, last = rule.path.split("/") if rule.path else [""]
            for segment in segments:
                node = node.down.setdefault(segment, _Node())
            node.ends.setdefault(last, rule)
            if len(last) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(last)], reverse=True)

    def match(self, host: str, path: str) -> Rule | None:
        """The rule with the deepest host, then the longest path; None if none fits."""
        node, hosts = self.root, [self.root.paths]
        for label in reversed(host.split(".")) if host else ():
            node = node.down.get(label)
            if node is None:
                break
            hosts.append(node.paths)
        segments = path.split("/")
        for node in filter(None, reversed(hosts)):
            best = None
            for segment in segments:
                # One look-up for each length that ends here, the longest first.
                fits = (node.ends.get(segment[:n]) for n in node.lengths if n <= len(segment))
                best = next(filter(None, fits), best)
                node = node.down.get(segment)
                if node is None:
                    break
            if best:
                return best
        return None


def in_parts(rules: list[Rule], most: int) -> list[list[Rule]]:
    """``rules`` in order, cut so that no part has more than ``most`` characters (a longer rule is a part)."""
    parts, size = [[]], 0
    for rule in rules:
        if parts[-1] and size + len(rule.name) > most:
            parts.append([])
            size = 0
        parts[-1].append(rule)
        size += len(rule.name)
    return parts


def url_parts(url) -> tuple:
    """Columns for host (A-Z lower-cased) and path of a url column."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = MAX_RULE_CHARS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; ``default`` where no rule fits.

    A rule that names a host outranks one that names a parent of it, whatever their paths;
    on one host the longest path wins, and of equal rules the first. Only the id and url
    columns are scanned. No broadcast holds more than ``most`` characters of rules: beyond it
    the rules are judged in parts, one pass over the urls each, and the better match stays.
    """
    parts = in_parts(list(rules), most)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    rows = rows.select("*", none.alias("at_host"), none.alias("at_path"), F.lit(default).alias("verdict"))
    scratch = Scratch(pages.sparkSession) if len(parts) > 1 else None
    for part in parts:
        rows = _judged(rows, part)
        if scratch:  # one trie at a time in a worker's memory
            rows = scratch.keep(rows)
    out = rows.select("page_id", "host", "path", F.concat("at_host", "at_path").alias("rule"), "verdict")
    return scratch.finish(out) if scratch else out


def _judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with a rule of ``rules`` where it is better than the rule they have."""
    trie = rows.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.match
        for b in batches:
            hosts, paths, verdicts = [], [], []
            for h, p, at_host, at_path, verdict in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                rule = find(h, p)
                if rule and (at_host is None or (len(rule.host), len(rule.path)) > (len(at_host), len(at_path))):
                    at_host, at_path, verdict = rule.host, rule.path, rule.verdict
                hosts.append(at_host)
                paths.append(at_path)
                verdicts.append(verdict)
            found = [pa.array(c, pa.string()) for c in (hosts, paths, verdicts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *found], names=b.schema.names)

    return rows.mapInArrow(judge, FIELDS)

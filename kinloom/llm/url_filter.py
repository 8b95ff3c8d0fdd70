"""Allow and block rules for URLs: a trie over reversed host labels, then over path segments.

The trie is built on the driver from the rule list and broadcast. Its size is that of the rule list,
which is checked against ``MAX_RULE_BYTES``; a longer list goes through ``judge_by_join`` which
never broadcasts it.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict. Repeated rows are judged one by one. Of a block and an allow entry with the same
host and path, block wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 64 << 20
DEFAULT_VERDICT = "allow"

# The rule list of the registered query, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass(slots=True)
class Node:
    """One host label or path segment; ``ends`` holds entries that stop inside the next segment."""

    labels: dict[str, Node] = field(default_factory=dict)
    path: Node | None = None
    segments: dict[str, Node] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: tuple[int, ...] = ()


class Trie:
    """Longest match: the deepest host that has a fitting path, and there the longest path."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = Node()
        for verdict, host, path in rules:
            self._add(verdict, host, path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        node.path = node.path or Node()
        node = node.path
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if node.ends.get(last, ("allow",))[0] == "allow":
            node.ends[last] = (verdict, host + path)
        node.lengths = tuple(sorted({len(x) for x in node.ends}, reverse=True))

    @staticmethod
    def _in_path(node: Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in node.lengths:
                if n <= len(segment) and (hit := node.ends.get(segment[:n])):
                    best = hit
                    break
            if (node := node.segments.get(segment)) is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting entry."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.labels.get(label)) is None:
                break
            if node.path is not None:
                best = self._in_path(node.path, segments) or best
        return best


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path`` by built-in functions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select(
        "*",
        F.coalesce(F.translate(host, upper, lower), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``key, host, path, rule, verdict`` of each row of ``pages``; one pass, no shuffle."""
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_BYTES:
        return judge_by_join(pages, rules, key, default)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [trie.find(h, p) for h, p in zip(batch["host"], batch["path"], strict=True)]
            batch["rule"] = [x and x[1] for x in found]
            batch["verdict"] = [x[0] if x else default for x in found]
            yield batch

    small = with_host_and_path(pages.select(key, "url")).drop("url")
    kind = small.schema[key].dataType.simpleString()
    return small.mapInPandas(walk, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same result for a rule list too long to broadcast: each distinct host's suffixes meet the rules' hosts.

    Distinct (host, path) pairs are matched once, so a hot host or a repeated page adds no work; the
    rules of a host are folded per pair by ``max`` with map-side combine, never gathered.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame(list(rules), "r_verdict string, r_host string, r_path string")
    judged = with_host_and_path(pages.select(key, "url")).drop("url")
    pairs = judged.select("host", "path").distinct()
    suffixes = pairs.select("host", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))")).alias("r_host"))
    rank = F.struct(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("n"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))
    best = suffixes.join(listed, "r_host").filter(F.expr("startswith(path, r_path)")).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op5(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split_up AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(r_verdict, r_host, r_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, r_verdict, r_host || r_path AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC, r_verdict DESC) AS k
  FROM split_up JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM split_up LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
"""

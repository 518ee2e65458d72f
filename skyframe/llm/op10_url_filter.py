"""URL filters: a broadcast trie over reversed host labels and then path segments; the longest rule wins."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm._common import table


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """``rules``: (verdict, host, path prefix). Nodes: host labels from the right, then whole path segments.

    A node of the host part is ``{"h": children, "p": path node}``; a path node is
    ``{"s": children by whole segment, "e": [(rest, rule, verdict), ...]}`` where ``rest`` is the beginning of the
    segment that the rule still asks for. The same rule given twice: ``block`` wins over ``allow``.
    """
    root: dict = {"h": {}, "p": None}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule says allow or block, not {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["h"].setdefault(label, {"h": {}, "p": None})
        if node["p"] is None:
            node["p"] = {"s": {}, "e": []}
        node = node["p"]
        *whole, rest = path.split("/")
        for segment in whole:
            node = node["s"].setdefault(segment, {"s": {}, "e": []})
        node["e"] = [x for x in node["e"] if x[0] != rest or x[2] == "block"]
        if not any(x[0] == rest for x in node["e"]):
            node["e"].append([rest, f"{host.lower()}{path}", verdict])
            node["e"].sort(key=lambda x: -len(x[0]))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the longest host (in labels), among these the longest path."""
    hosts, node = [], trie
    for label in reversed(host.split(".")):
        node = node["h"].get(label)
        if node is None:
            break
        if node["p"] is not None:
            hosts.append(node["p"])
    segments = path.split("/")
    for node in reversed(hosts):
        found = None
        for segment in segments:
            found = next((x for x in node["e"] if segment.startswith(x[0])), found)
            node = node["s"].get(segment)
            if node is None:
                break
        if found is not None:
            return found[1], found[2]
    return None


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    url: str = "url",
    default: str = "allow",
    max_trie_bytes: int = 64 << 20,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``; a narrow job without a shuffle.

    The trie is broadcast. Its size is checked: rules that serialise to more than ``max_trie_bytes`` are refused
    (cut the list by registered domain and filter in turns). The rules are the caller's list, not the data's.

    * null URL, or one without ``://``: empty host and path, no rule, ``default``.
    * empty URL, very long URL: like any other; ties (one rule given twice): block wins.
    * repeated rows stay repeated; an empty table gives an empty table with the four columns.
    * columns named ``host``, ``path``, ``rule`` or ``verdict`` that ``pages`` already has are replaced.
    """
    packed = json.dumps(build_trie(rules))
    if len(packed) > max_trie_bytes:
        raise ValueError(f"the rules' trie has {len(packed)} bytes, over max_trie_bytes={max_trie_bytes}")
    shared = pages.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = json.loads(shared.value)
        for host, path in parts:
            found = [longest_match(trie, h, p) or (None, default) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    taken = pages.select(*[pages[c] for c in kept], url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path"))
    judged = taken.withColumn("__judged", judge("host", "path"))
    return judged.select(*[judged[c] for c in kept], "host", "path", "__judged.rule", "__judged.verdict")


RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) DESC NULLS LAST, length(r.rpath) DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

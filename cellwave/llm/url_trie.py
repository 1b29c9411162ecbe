"""URL filter: one trie of host labels from the last to the first, path segments below them.

The rules are a list that the caller holds, at most ``MOST_RULES`` of them, so the broadcast trie has a
known bound. Each url walks the trie once; among all fitting rules the longest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 2_000_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
# keys that no label or segment can be
_RULE, _PATHS = "/rule", "/paths"


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


class UrlTrie:
    """Rules ``(verdict, host, path)``. A rule fits its host, all subdomains, and paths that start with its path."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.hosts: dict = {}
        for count, (verdict, host, path) in enumerate(rules, 1):
            if count > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} url rules")
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(_PATHS, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(_RULE, {})
            # of a rule given twice, block holds
            if ends.get(tail, ("", ""))[0] != "block":
                ends[tail] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """``(verdict, rule)`` of the longest fitting rule; of equally long ones that with the longer host."""
        best, node = None, self.hosts
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(_PATHS)
            for segment in segments if below is not None else ():
                for tail, found in below.get(_RULE, {}).items():
                    if segment.startswith(tail) and (best is None or len(found[1]) >= len(best[1])):
                        best = found
                below = below.get(segment)
                if below is None:
                    break
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row's ``url``.

    Null urls and urls without ``://`` have empty host and path, no rule and the default verdict. Repeated
    rows stay; other columns of the input are left out.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        find, rows = trie.value.find, []
        for url in urls:
            host, path = url_parts(url)
            verdict, rule = find(host, path) or (default, None)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.select("page_id", judged("url").alias("judged")).select("page_id", "judged.*")

"""URL filtering by a broadcast trie over reversed host labels and path segments.

Longest match: of all rules that fit, the one with the most host labels wins,
then the one with the longest path; of two rules for the same host and path
``block`` wins. Rules are a configuration list; its length is checked against
``max_rules``, and the trie's size against ``max_bytes``, before it is broadcast.

Null and malformed urls (no ``://``) have an empty host and path and fit no
rule. Repeated rows are judged each for itself; other columns pass through
untouched unless an output column replaces one of the same name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or a url without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    rest = rest[: min(i if (i := rest.find(c)) >= 0 else len(rest) for c in "?#")]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Trie:
    """Host nodes are ``{label: node}``; a node's paths hang below the key ``None``.

    A path node maps each whole segment to the next node; under ``""`` it
    keeps (verdict, rule) of a rule that ends at this slash, and under
    ``None`` the rules whose last segment is only a prefix.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}: neither allow nor block")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            kept = node.setdefault(None, {})
            if last not in kept or verdict == "block":
                kept[last] = (verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match, or None."""
        node, best = self.root, None
        if not host:
            return None
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node and (found := self._path(node[None], path)):
                best = found
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            if ends := node.get(None):
                rest = "/".join(segments[i:])
                if fits := [p for p in ends if rest.startswith(p)]:
                    best = ends[max(fits, key=len)]
            if (node := node.get(("s", segment))) is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url: str = "url", max_rules: int = 1_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict to every row of pages.

    ``rules``: (verdict, "host/path") pairs. A rule fits its host and all
    subdomains when the url's path starts with the rule's path.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes {max_rules} at most")
    built = Trie(rules)
    if (size := len(pickle.dumps(built))) > max_bytes:
        raise ValueError(f"a trie of {size} bytes; {max_bytes} at most are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(built)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = trie.value
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                verdict, rule = held.find(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    out = pages.withColumn("__judged", judged(F.col(url)))
    return out.withColumns({c: F.col(f"__judged.{c}") for c in ("host", "path", "rule", "verdict")}).drop("__judged")

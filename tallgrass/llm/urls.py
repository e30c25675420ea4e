"""Operator 3, URL filters: pattern rules fetched by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ, arrow_map

#: (verdict, host and start of path): the site rules.
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: (verdict, pattern): the method's own rules, for addresses that no site rule fits. || stands for the start of
#: a label of the host, * for anything, ^ for a separator or the end.
PATTERN_RULES = [
    ("block", "||spam-farm."), ("block", "||cheap-pills."), ("block", "||casino."), ("block", "||free-casino."), ("block", "||poker-online."),
    ("block", "||adult."), ("block", "||xxx."), ("block", "||porn."), ("block", "||torrents."), ("block", "||warez."), ("block", "||buy-followers."),
    ("block", "^affiliate^*^click^"), ("block", "^doorway^"), ("block", "^wp-login.php^"), ("allow", "^robots.txt^"),
]

TOKEN = re.compile(r"[a-z0-9]+")
LOW = str.maketrans(UPPER_AZ, LOWER_AZ)


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def rule(verdict: str, pattern: str, site: bool = False) -> Rule:
    """A rule over host + path. Its tokens are the runs of letters and digits that any address it fits has whole:
    those with something literal that is no letter or digit, or a separator or label start, on both sides."""
    body = pattern.removeprefix("||")
    regex = r"^(?:[^/]*\.)?" if body != pattern else ""
    for c in body:
        regex += ".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else re.escape(c)
    whole = []
    for m in TOKEN.finditer(body.translate(LOW)):
        left = body[m.start() - 1] if m.start() else "" if body == pattern else "."
        right = body[m.end() : m.end() + 1]
        if left and right and "*" not in (left, right):
            whole.append(m[0])
    return Rule(verdict, pattern if not site else body, regex, tuple(whole), site)


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL)
    return m[1].translate(LOW), m[2]


class Index:
    """Rules by their rarest token; rules without a token are tried on every address.

    Addresses and rules are cut into tokens alike: A-Z count as a-z, and a letter outside them ends a token."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        self.compiled: dict[str, re.Pattern] = {}
        for r in rules:
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
            else:
                self.always.append(r)

    def expression(self, r: Rule) -> re.Pattern:
        """Compiled when the rule is first fetched: most of a long list never are."""
        out = self.compiled.get(r.regex)
        if out is None:
            out = self.compiled[r.regex] = re.compile(r.regex, re.DOTALL)
        return out

    def fitting(self, host: str, path: str) -> Iterator[Rule]:
        address = host + path
        for token in {None, *TOKEN.findall(address.translate(LOW))}:
            for r in self.always if token is None else self.by_token.get(token, ()):
                if self.expression(r).search(address):
                    yield r


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: list = SITE_RULES, pattern_rules: list = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, pattern.

    The longest site rule that fits gives rule and verdict. Else rule is null, and the longest pattern rule that fits
    gives the verdict and pattern (ties: the smaller name); else the verdict is the default and pattern null. A null or
    malformed url has empty host and path and gets the default, unless a rule fits empty addresses. Repeated rows
    get a row each; other columns aren't read; an empty table gives no rows.

    How often the rules' tokens come up is counted over all urls first; the counts that go to the driver are as many
    as the rules have tokens. Rows are judged alone, without a shuffle.
    """
    rules = [rule(v, f"||{p}", True) for v, p in site_rules] + [rule(v, p) for v, p in pattern_rules]
    wanted = {t for r in rules for t in r.tokens}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for url in batch.column("url").to_pylist():
                found.update(wanted.intersection(TOKEN.findall("".join(parts(url)).translate(LOW))))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    counts = {r["token"]: r["n"] for r in arrow_map(rows.select("url"), count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                fit = sorted(index.fitting(host, path), key=lambda r: (not r.site, -len(r.name), r.name))
                top = fit[0] if fit else None
                site = bool(top and top.site)
                out.append((host, path, top.name if site else None, top.verdict if top else default, top.name if top and not site else None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x[i] for x in out], pa.string()) for i in range(5))], names=["id", "host", "path", "rule", "verdict", "pattern"])

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, host string, path string, rule string, verdict string, pattern string").withColumnRenamed("id", id_col)

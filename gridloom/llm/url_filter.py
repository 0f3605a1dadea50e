"""URL filter: host rules, and a weighted vocabulary that an Aho-Corasick automaton looks for."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: General terms; a site's own list comes from a file (``Vocabulary.load``).
STRICT = ("casino", "cracked", "escort", "hentai", "keygen", "malware", "phishing", "poker", "porn", "porno", "roulette", "sportsbook", "torrent", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "affiliate", "bet", "bets", "bonus", "buy", "cheap", "click", "coupon", "crypto", "deal", "deals", "download", "farm", "free", "girls", "hot", "loan", "loans", "offer", "pills", "popup", "prize", "promo", "redirect", "sex", "spam", "sponsored", "survey", "track", "tracker", "unsubscribe", "win", "winner")


@dataclass(frozen=True)
class Vocabulary:
    """Terms and their weights. A URL is rejected when the weights of its distinct terms reach ``limit``.

    A strict term weighs ``limit`` by itself. Soft terms weigh 1 unless ``weights`` says otherwise, so with the limit of 2
    two distinct ones are needed. Terms count between characters that are no letters or digits.
    """

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    weights: tuple[tuple[str, float], ...] = ()
    limit: float = 2.0

    @classmethod
    def load(cls, path: str, limit: float = 2.0) -> Vocabulary:
        """From a text file: a term a line, then ``strict`` or a weight after a tab (1 if there is none); # starts a comment."""
        strict, weights = [], {}
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                term, _, kind = line.split("#")[0].strip().partition("\t")
                if term and kind.strip() == "strict":
                    strict.append(term.lower())
                elif term:
                    weights[term.lower()] = float(kind.strip() or 1)
        return cls(tuple(strict), tuple(weights), tuple(weights.items()), limit)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A to Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.encode().lower().decode(), path[:cut]


class Judge:
    """rules: (action, host, path). A rule fits its host and all subdomains if the path starts with its own; the longest wins, then block."""

    def __init__(self, rules: list[tuple[str, str, str]], vocabulary: Vocabulary):
        import ahocorasick

        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host, []).append((action, path, host + path))
        self.limit, self.weights = vocabulary.limit, dict(vocabulary.weights)
        self.automaton = ahocorasick.Automaton()
        for term, strict in (*((t, False) for t in vocabulary.soft), *((t, True) for t in vocabulary.strict)):
            self.automaton.add_word(term, (term, strict))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            fits += [r for r in self.by_host.get(".".join(labels[i:]), ()) if path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[2]), r[0] == "block"), default=None)
        return (best[2], best[0]) if best else None

    def terms(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct soft and strict terms of the URL, without case, at word boundaries."""
        low, found = url.encode().lower().decode(), (set(), set())
        for end, (term, strict) in self.automaton.iter(low) if len(self.automaton) else ():
            start = end - len(term) + 1
            if (start == 0 or not _inside(low[start - 1])) and (end + 1 == len(low) or not _inside(low[end + 1])):
                found[strict].add(term)
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = parts(url)
        soft, strict = self.terms(url or "")
        rule = self.rule(host, path)
        rejected = strict or sum(self.weights.get(t, 1.0) for t in soft) >= self.limit
        verdict = rule[1] if rule else "block" if rejected else "allow"
        return host, path, rule[0] if rule else None, verdict, len(strict), len(soft)


def _inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, strict_terms, soft_terms.

    A null URL has empty parts, no rule and no terms, so it is allowed. Of rules as long as each other that fit, block
    wins. Repeated rows are judged each for itself; very long URLs are read whole; an empty table gives no rows. Rules and
    vocabulary are parameters; only id and URL are read, so other columns can have any name.
    """
    vocabulary = vocabulary or Vocabulary()

    def run(batches):
        judge = Judge(rules, vocabulary)
        for batch in batches:
            cols = zip(*map(judge.judge, batch.column(1).to_pylist()), strict=True) if batch.num_rows else [[]] * 6
            types = [*[pa.string()] * 4, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return common.mapped(rows, run, "page_id long, host string, path string, rule string, verdict string, strict_terms int, soft_terms int")


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return url_verdicts(common.table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    acts = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in RULES)
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH rest AS (
  SELECT page_id, translate(coalesce(url, ''), {upper}) AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, low, translate(regexp_extract(r, '^[^/?#]*'), {upper}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), seen AS (
  SELECT page_id, host, path, CASE {fits} END AS rule, CAST({hits(STRICT)} AS INTEGER) AS strict_terms, CAST({hits(SOFT)} AS INTEGER) AS soft_terms FROM cut
)
SELECT page_id, host, path, rule, strict_terms, soft_terms,
  CASE rule {acts} ELSE CASE WHEN strict_terms > 0 OR soft_terms >= {Vocabulary().limit} THEN 'block' ELSE 'allow' END END AS verdict
FROM seen
"""


OP3_SQL = _sql()

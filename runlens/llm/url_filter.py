"""URL filter: host and path rules, and a weighted vocabulary searched with Aho-Corasick.

One strict term, or several distinct soft terms, block a url. A term counts
only between boundaries: the characters next to it are not ASCII letters or
digits. A rule that fits the url decides before the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, lower_ascii

# The default vocabulary (term, weight) and rules (host and path, verdict).
STRICT = 3
SOFT = 1
TERMS: tuple[tuple[str, int], ...] = tuple((t, STRICT) for t in ("adult", "betting", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")) + tuple(
    (t, SOFT) for t in ("ads", "banner", "bonus", "cheap", "click", "deal", "discount", "farm", "free", "hot", "jackpot", "loan", "offer", "popup", "promo", "sale", "track", "tracker", "win", "winner")
)
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SOFT = 2

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):  # later ones, which are longer, take precedence
        name, tail = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(tail)
        best, verdict = F.when(fits, rule).otherwise(best), F.when(fits, what).otherwise(verdict)
    return best, verdict


@lru_cache(maxsize=8)
def automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in terms:
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(text: str, terms: tuple[tuple[str, int], ...]) -> tuple[int, int]:
    """Distinct strict and soft terms between boundaries in a lower-cased text."""
    found: dict[str, int] = {}
    if terms:
        for end, (term, weight) in automaton(terms).iter(text):
            start = end - len(term)
            if (start < 0 or not _is_word(text[start])) and (end + 1 == len(text) or not _is_word(text[end + 1])):
                found[term] = weight
    strict = sum(w >= STRICT for w in found.values())
    return strict, len(found) - strict


def _count_batches(batches: Iterator[pa.RecordBatch], terms: tuple[tuple[str, int], ...], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [hits(x or "", terms) for x in batch.column(at).to_pylist()]
        columns = [*batch.columns, pa.array([c[0] for c in counts], pa.int32()), pa.array([c[1] for c in counts], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "strict_hits", "soft_hits"])


def judge_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", terms: tuple[tuple[str, int], ...] = TERMS, rules: tuple[tuple[str, str], ...] = RULES, min_soft: int = MIN_SOFT) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, strict_hits, soft_hits.

    The vocabulary is searched in the whole lower-cased url after the scheme.
    A null url, or one without ://, has an empty host and path, no rule and no
    hits, so it is allowed. Repeated rows each get a row; other columns are
    ignored; an empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rest = lower_ascii(F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")))
    one = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), rest.alias("rest"))
    schema = extended(one.schema, strict_hits=T.IntegerType(), soft_hits=T.IntegerType())
    counted = one.mapInArrow(partial(_count_batches, terms=tuple(terms), at=3), schema)
    rule, said = rule_of(F.col("host"), F.col("path"), tuple(rules))
    blocked = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= min_soft)
    verdict = F.coalesce(said, F.when(blocked, "block").otherwise("allow"))
    return counted.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits")


def oracle_sql(terms=TERMS, rules=RULES, min_soft: int = MIN_SOFT) -> str:
    """The same in SQL, with a regular expression for each term."""
    edge = "(^|[^a-z0-9]){}($|[^a-z0-9])"
    count = lambda strict: " + ".join(f"cast(regexp_matches(rest, '{edge.format(t)}') as int)" for t, w in terms if (w >= STRICT) == strict)
    fits = [(r, v, f"((host = '{r[: r.index('/')]}' or ends_with(host, '.{r[: r.index('/')]}')) and starts_with(path, '{r[r.index('/') :]}'))") for r, v in sorted(rules, key=lambda r: -len(r[0]))]
    case = lambda at: "case " + " ".join(f"when {f[2]} then '{f[at]}'" for f in fits) + " end"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with parts as (
      select page_id,
        {low.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
        case when contains(url, '://') then {low.format("regexp_replace(url, '(?s)^.*?://', '')")} else '' end as rest
      from pages),
    counted as (select *, {count(True)} as strict_hits, {count(False)} as soft_hits from parts)
    select page_id, host, path, {case(0)} as rule,
      coalesce({case(1)}, case when strict_hits > 0 or soft_hits >= {min_soft} then 'block' else 'allow' end) as verdict,
      cast(strict_hits as int) as strict_hits, cast(soft_hits as int) as soft_hits
    from counted"""

"""F: mentions of numbered cards in notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules


def _numbers(first: Column, tail: Column, prefix: Column) -> Column:
    """struct(last, ranged, nums) of one mention: its first number and the steps after it, as far as they hold."""
    step = F.concat(F.lit(f"({rules.RANGE_SIGN}|{rules.LIST_SIGN})(?:"), prefix, F.lit(r"-)?(\d{3})"))
    signs, numbers = F.regexp_extract_all(tail, step, F.lit(1)), F.regexp_extract_all(tail, step, F.lit(2))
    start = F.struct(first.alias("last"), F.lit(0).alias("ranged"), F.array(first).alias("nums"), F.lit(True).alias("open"))

    def go(state: Column, at: Column) -> Column:
        number, last = at["number"].cast("int"), state["last"]
        ranges = at["sign"].rlike(rules.RANGE_SIGN)
        spans = ranges & (number > last) & (number <= last + rules.LONGEST_RANGE)
        lists = ~ranges & number.between(*rules.LISTED_CARDS)
        more = F.when(spans, F.sequence(F.least(last + 1, number), number)).otherwise(F.array(number))
        taken = F.struct(number.alias("last"), (state["ranged"] + F.when(spans, number - last).otherwise(0)).alias("ranged"), F.concat(state["nums"], more).alias("nums"), F.lit(True).alias("open"))
        shut = F.struct(last.alias("last"), state["ranged"].alias("ranged"), state["nums"].alias("nums"), F.lit(False).alias("open"))
        return F.when(state["open"] & (spans | lists), taken).otherwise(shut)

    return F.aggregate(F.arrays_zip(signs.alias("sign"), numbers.alias("number")), start, go)


def card_mentions(units: DataFrame, text: str = "text", prefix: str = "prefix") -> DataFrame:
    """(units' columns, mention, numbers, blanket, at) for each mention of cards in a unit, alone, in a range or in a list.

    units: text and the run's card prefix. A mention whose ranges add more than five numbers is a blanket
    one. Bare numbers in the first cell of a table row count if the cell
    holds nothing else; their mention is null. at: the place in the text, from 0. Null texts and prefixes have none.
    """
    quoted = F.concat(F.lit(r"\Q"), F.col(prefix), F.lit(r"\E"))
    more = F.concat(F.lit(f"(?:{rules.RANGE_SIGN}(?:"), quoted, F.lit(rf"-)?\d{{3}}(?!\d)|{rules.LIST_SIGN}(?:"), quoted, F.lit(r"-)?\d{3}(?![\d.]))*"))
    head = F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit(r"-(\d{3})(?!\d)(?=("), more, F.lit("))"))
    # found once in columns of their own: inside of a lambda they would be sought again for each mention
    sought = {"__gaps": F.split(F.col(text), head, -1), "__heads": F.regexp_extract_all(text, head, F.lit(0)), "__tails": F.regexp_extract_all(text, head, F.lit(2))}
    gaps, heads, tails = map(F.col, sought)
    # a mention begins where the texts between mentions and the mentions before it end
    upto = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(heads, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))
    named = F.transform(
        F.arrays_zip(heads.alias("head"), tails.alias("tail")),
        lambda m, i: F.struct(i.alias("mention"), upto(i).alias("at"), _numbers(F.right(m["head"], F.lit(3)).cast("int"), m["tail"], quoted).alias("found")),
    )
    each = F.transform(named, lambda m: F.struct(m["mention"].alias("mention"), m["found"]["nums"].alias("numbers"), (m["found"]["ranged"] > rules.BLANKET).alias("blanket"), m["at"].alias("at")))
    cell = F.when(F.col(text).startswith("|"), F.split_part(F.col(text), F.lit("|"), F.lit(2)))
    bare = F.when(cell.rlike(rules.NUMBERS_ONLY), F.regexp_extract_all(cell, F.lit(r"(?<!\d)(2\d\d)(?!\d)"), F.lit(1)))
    cells = F.transform(bare, lambda n: F.struct(F.lit(None).cast("int").alias("mention"), F.array(n.cast("int")).alias("numbers"), F.lit(False).alias("blanket"), F.lit(1).alias("at")))
    none = F.array().cast("array<struct<mention:int,numbers:array<int>,blanket:boolean,at:int>>")
    return units.withColumns(sought).select(*units.columns, F.inline(F.concat(F.coalesce(each, none), F.coalesce(cells, none))))


def of_cards(mentions: DataFrame, cards: DataFrame, by: list[str]) -> DataFrame:
    """mentions with ``number`` in place of ``numbers``, a row for each card that exists. cards: by, number."""
    found = mentions.select(*[c for c in mentions.columns if c != "numbers"], F.explode("numbers").alias("number"))
    return found.join(cards.select(*by, "number").distinct().hint("merge"), [*by, "number"], "left_semi").select(*found.columns)


def card_ranges(units: DataFrame, cards: DataFrame, by: list[str], text: str = "text", prefix: str = "prefix") -> DataFrame:
    """(units' columns, mention, number, blanket, at) for each card that a unit names, as ``card_mentions`` finds them.

    units: by, text and the run's card prefix. cards: by, number (those that exist).
    """
    return of_cards(card_mentions(units, text, prefix), cards, by).select(*units.columns, "mention", "number", "blanket", "at")

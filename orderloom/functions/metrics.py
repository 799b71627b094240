"""Shared metric definitions: delay, lateness, negative reviews, aspect lists, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.vocabulary import NO_ASPECT

MICROS_PER_DAY = 86_400_000_000.0
# A string, None, a truth value or a number, as lists of aspects are written out.
LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|None|True|False|[-+]?[0-9]+(?:\.[0-9]+)?"""


def delay_days(delivered: Column, estimated: Column) -> Column:
    """Fractional days from the estimate to the delivery; NULL when undelivered."""
    return F.timestamp_diff("MICROSECOND", estimated, delivered) / F.lit(MICROS_PER_DAY)


def late_flag(delay: Column) -> Column:
    """1.0 late, 0.0 on time or early (the estimate itself is on time), NULL undelivered."""
    return (delay > 0).cast("double")


def neg_review_flag(score: Column, max_score: int = 2) -> Column:
    return F.coalesce((score <= max_score).cast("int"), F.lit(0))


def negative_label_flag(label: Column) -> Column:
    return F.coalesce((label == "Negative").cast("int"), F.lit(0))


def expected_sentiment(score: Column) -> Column:
    return F.when(score >= 4, "Positive").when(score <= 2, "Negative").otherwise("Neutral")


def parse_aspects(cell: Column, fallback: str = NO_ASPECT) -> Column:
    """Aspect array from a string cell: a list of literals, one literal, a bare name, blank or NULL.

    A quoted item ends at the quote it began with; escaped characters stand for themselves.
    """
    text = F.trim(cell)
    items = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))
    plain = F.transform(items, lambda x: F.when(
        x.rlike("^['\"]"), F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x))
    many = rf"(?:{LITERAL})\s*(?:,\s*(?:{LITERAL})\s*)*,?\s*"
    listed = text.rlike(rf"^[\[(]\s*(?:{many})?[\])]$|^(?:{LITERAL})$")
    return F.coalesce(
        F.when(listed & (F.size(plain) > 0), plain),
        F.when(~listed & (F.length(text) > 0), F.array(cell)),
        F.array(F.lit(fallback)),
    )


def parse_aspect_array(cell: Column, fallback: str = NO_ASPECT) -> Column:
    """Aspect array from an array cell; empty or NULL becomes the fallback."""
    return F.when(F.size(cell) > 0, cell).otherwise(F.array(F.lit(fallback)))


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (e[i-1], e[i]] that holds ``value``.

    With one more label than edges the first bin is open below; with as many labels
    as edges, values at or under the first edge belong to no bin (NULL).
    """
    open_below = len(labels) == len(edges) + 1
    names = list(labels) if open_below else [None, *labels]
    column = F.when(value <= F.lit(edges[0]), F.lit(names[0]))
    for edge, name in zip(edges[1:], names[1:]):
        column = column.when(value <= F.lit(edge), F.lit(name))
    return column.when(value > F.lit(edges[-1]), F.lit(names[-1]))


def month_of(ts: Column) -> Column:
    """``yyyy-MM`` without any session time zone in play."""
    return F.format_string("%04d-%02d", F.year(ts), F.month(ts))


def quarter_of(ts: Column) -> Column:
    return F.format_string("%04dQ%d", F.year(ts), F.quarter(ts))


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts).cast("date")


def share_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def confidence(n: Column, minimum: int) -> Column:
    return F.when(n >= minimum, "HIGH").otherwise("LOW-N")

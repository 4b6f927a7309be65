"""Text columns: identifiers, durations, display names and report cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of generated features and the words a term is broken before.
TRANSFORMS = ["log", "sqrt", "square"]
WRAP_MARKERS = ["Homo", "during"]


def zero_padded(value: Column, width: int = 6) -> Column:
    """Whole number as text with leading zeros; longer numbers are kept whole."""
    text = value.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def duration_minutes(text: Column, on_bad: str = "null") -> Column:
    """Minutes from a text whose first two numbers are hours and minutes."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    if on_bad == "error":
        hours, minutes = numbers[0], F.element_at(numbers, 2)
        parsed = hours.cast("bigint") * 60 + minutes.cast("bigint")
        return F.when(text.isNotNull(), parsed)
    return F.get(numbers, F.lit(0)).cast("bigint") * 60 + F.get(numbers, F.lit(1)).cast("bigint")


def pretty_feature(name: Column) -> Column:
    """``a_mul_b`` as a×b, ``a_div_b`` as a/b, ``a_log`` as log(a) and so on."""
    shown = F.replace(F.replace(name, F.lit("_mul_"), F.lit("×")), F.lit("_div_"), F.lit("/"))

    def wrap(text: Column, transform: str) -> Column:
        bare = F.replace(text, F.lit(f"_{transform}"), F.lit(""))
        return F.when(F.contains(text, F.lit(transform)), F.concat(F.lit(f"{transform}("), bare, F.lit(")"))).otherwise(text)

    return reduce(wrap, TRANSFORMS, shown)


def wrap_term(term: Column, markers: list[str] | None = None) -> Column:
    """Break a term at the last space before the first occurrence of each marker."""

    def broken(text: Column, marker: str) -> Column:
        # Greedy up to the last space ahead of the first marker, at least one
        # character before the break.
        before = F.substring_index(text, marker, 1)
        tail = F.substring_index(before, " ", -1)
        cut = F.length(before) - F.length(tail)
        wrapped = F.concat(F.substring(text, F.lit(1), cut - 1), F.lit("\n"), F.substring(text, cut + 1, F.length(text)))
        return F.when(F.contains(text, F.lit(marker)) & (cut > 1), wrapped).otherwise(text)

    return reduce(broken, WRAP_MARKERS if markers is None else markers, term)


def first_item(listed: Column, separator: str = ";") -> Column:
    """First entry of a separated list; empty when the list is null."""
    return F.coalesce(F.get(F.split(listed, separator), F.lit(0)), F.lit(""))


def reported_p(p: Column, alpha: float | None = 0.01) -> Column:
    """``< alpha`` below the threshold, the value itself otherwise."""
    if alpha is None:
        return p.cast("string")
    return F.when(p < alpha, F.lit(f"< {alpha}")).otherwise(p.cast("string"))


def mean_sd(mean: Column, sd: Column) -> Column:
    return F.format_string("%.1f±%.1f", mean, sd)


def count_share(count: Column, share: Column) -> Column:
    return F.format_string("%,d(%.1f%%)", count, 100 * share)


def signed_label(label: Column, name: str = "IR") -> Column:
    """Boolean or 0/1 label as ``name+`` / ``name-``; null stays null."""
    return F.when(label.cast("int") == 1, F.lit(f"{name}+")).when(label.isNotNull(), F.lit(f"{name}-"))

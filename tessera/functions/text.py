"""Text columns: white space, case, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, spelled so that Java and RE2 read it alike.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def filled(c: Column) -> Column:
    """The value, or null where it is null or blank."""
    return F.when(ws_trim(c) != "", c)


def casefold(c: Column) -> Column:
    """Lower case with sharp s folded; other multi-letter foldings are not made."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def city_key(c: Column) -> Column:
    """The form in which cities are compared; a blank city is no city."""
    key = casefold(ws_trim(c))
    return F.when(key != "", key)


def doc_text(title: Column, description: Column) -> Column:
    return ws_trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))


def words(c: Column) -> Column:
    return F.filter(F.split(casefold(c), f"{WS}+"), lambda w: w != "")


def shingles(c: Column, k: int = 2) -> Column:
    """Distinct runs of ``k`` words; at most ``k`` words make one shingle, none make none."""
    # Slices are zipped with each other: a lambda over positions would split the text again for every word.
    w = words(c)
    count = F.greatest(F.size(w) - (k - 1), F.lit(1))
    runs = F.slice(w, 1, count)
    for j in range(1, k):
        runs = F.zip_with(runs, F.slice(w, j + 1, count), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))

"""What language models are asked: one text per row, built from columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.render import format_when, numbered
from tessera.functions.text import filled
from tessera.vocabulary import ATTRIBUTES, CALLS, describe, keys_of


def _or(c: Column, otherwise: str) -> Column:
    return F.coalesce(filled(c), F.lit(otherwise))


def expand_prompt(text: Column, city: Column, languages: Sequence[str], most: int) -> Column:
    """Ask for search queries in several languages."""
    return F.concat(
        F.lit(f"Write at most {most} web search queries for the request below, in the languages {', '.join(languages)}. Answer by calling {CALLS['expand']}.\nRequest: "),
        text, F.lit("\nPlace: "), _or(city, "anywhere"),
    )


def classify_prompt(text: Column) -> Column:
    """Ask which of the domains a request belongs to."""
    return F.concat(F.lit(f"Name the domain of the request by calling {CALLS['classify']}: one of {', '.join(ATTRIBUTES)}.\nRequest: "), text)


def search_prompt(text: Column, city: Column, domain: str, most: int) -> Column:
    """Ask for results with the attributes of a domain."""
    wanted = "; ".join(f"{k}: {describe(k)}" for k in keys_of(domain))
    return F.concat(F.lit(f"Find at most {most} results and submit them by calling {CALLS['search']}. Attributes: {wanted}.\nQuery: "), text, F.lit("\nPlace: "), _or(city, "anywhere"))


def rerank_prompt(request: Column, summary: Column, items: Column) -> Column:
    """Ask for an order of items: ``items`` is an array of struct(title, description, starts_at, ends_at)."""
    shown = F.transform(items, lambda x: F.concat_ws(" | ", x["title"], filled(x["description"]), filled(format_when(x["starts_at"], x["ends_at"]))))
    return F.concat(F.lit(f"Order the items from best to worst for this reader by calling {CALLS['rerank']}; give a short reason for each.\nRequest: "), request, F.lit("\nWhat is known of the reader: "), _or(summary, "nothing yet"), F.lit("\n"), numbered(shown))


def summary_prompt(before: Column, liked: Column, disliked: Column) -> Column:
    """Ask for a summary of a reader's taste: ``liked`` and ``disliked`` are arrays of titles with reasons."""
    listed = lambda rows: F.when(F.size(rows) > 0, numbered(rows)).otherwise(F.lit("none"))
    return F.concat(F.lit("Sum up in a few sentences what this reader likes and dislikes. Answer with the summary alone.\nSo far: "), _or(before, "nothing"), F.lit("\nLiked:\n"), listed(liked), F.lit("\nDisliked:\n"), listed(disliked))


def builder_prompt(turns: Column) -> Column:
    """Ask for the next turn of a dialogue that drafts a search: ``turns`` is an array of struct(role, text)."""
    said = F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return F.concat(F.lit(f"Help the user to describe a recurring search: its text, a city, when to run it and how many results to show. Answer by calling {CALLS['builder']}; set ready once the text is clear.\n"), F.array_join(said, "\n"))

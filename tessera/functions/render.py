"""Display text, and the texts given to language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import filled

_DAY, _TIME = "d MMM yyyy", "HH:mm"


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_when(starts: Column, ends: Column) -> Column:
    """An instant, a span within a day, or a span of days; empty without a start."""
    full = lambda c: F.date_format(c, f"{_DAY}, {_TIME}")
    same = F.to_date(starts) == F.to_date(ends)
    return F.when(starts.isNull(), "").when(ends.isNull(), full(starts)).when(same, F.concat(full(starts), F.lit("-"), F.date_format(ends, _TIME))).otherwise(F.concat(full(starts), F.lit(" - "), full(ends)))


def label(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def format_facts(attributes: Column, between: str = ", ") -> Column:
    """Non-blank attributes as 'Label: value', by key."""
    entries = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, v: filled(v).isNotNull())))
    return F.array_join(F.transform(entries, lambda e: F.concat(label(e["key"]), F.lit(": "), e["value"])), between)


def fact_lines(attributes: Column, signs: dict[str, str]) -> Column:
    """Non-blank attributes for a chat, a line each by key, with the domain's sign before those that have one."""
    entries = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, v: filled(v).isNotNull())))
    known = F.create_map(*(F.lit(x) for item in signs.items() for x in item)) if signs else None
    sign = lambda k: F.coalesce(F.concat(known[k], F.lit(" ")), F.lit("")) if known is not None else F.lit("")
    return F.array_join(F.transform(entries, lambda e: F.concat(sign(e["key"]), label(e["key"]), F.lit(": "), e["value"])), "\n")


def schedule_line(text: Column, cron: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", escape_html(text)).when(F.coalesce(cron, F.lit("")) != "", F.concat(F.lit("<code>"), escape_html(cron), F.lit("</code>"))).otherwise("manual (run on demand)")


def fill_template(template: str, query: Column, max_results: int) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{max_results}"), F.lit(str(max_results))), F.lit("{query}"), query)


def numbered(rows: Column) -> Column:
    """Numbered lines of an ordered array of strings."""
    return F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _lines(*parts: Column) -> Column:
    """Non-blank parts, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: filled(x).isNotNull()), "\n")


def render_result(title: Column, url: Column, starts: Column, ends: Column, price: Column, attributes: Column, rationale: Column | None = None) -> Column:
    """One result as a message: linked title, when, price, facts and why, each escaped and left out where blank."""
    head = F.concat(F.lit('<a href="'), escape_html(url), F.lit('"><b>'), escape_html(title), F.lit("</b></a>"))
    why = F.concat(F.lit("<i>"), escape_html(rationale), F.lit("</i>")) if rationale is not None else F.lit("")
    return _lines(head, escape_html(format_when(starts, ends)), escape_html(F.coalesce(price, F.lit(""))), escape_html(format_facts(attributes)), F.coalesce(why, F.lit("")))


def render_draft(text: Column, city: Column, schedule_text: Column, schedule_cron: Column, most: Column) -> Column:
    """A drafted search before it is saved."""
    named = lambda name, c: F.when(filled(c).isNotNull(), F.concat(F.lit(f"<b>{name}</b>: "), escape_html(c))).otherwise("")
    when = F.concat(F.lit("<b>When</b>: "), schedule_line(schedule_text, schedule_cron))
    return _lines(named("Search", text), named("City", city), when, named("Results", most.cast("string")))


def render_saved_query(text: Column, city: Column, schedule_text: Column, schedule_cron: Column, enabled: Column) -> Column:
    """A saved search in a list: its text, place and schedule, and whether it is paused."""
    place = F.when(filled(city).isNotNull(), F.concat(F.lit(" ("), escape_html(city), F.lit(")"))).otherwise("")
    return F.concat(F.lit("<b>"), escape_html(text), F.lit("</b>"), place, F.lit("\n"), schedule_line(schedule_text, schedule_cron), F.when(enabled, "").otherwise(F.lit("\npaused")))

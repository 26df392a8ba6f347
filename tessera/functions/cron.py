"""Five-field cron expressions: validity, previous and next fire."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ws_trim

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = ({}, {}, {}, {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}, {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())})
#: Fires are looked for this many days away; leap days on a weekday come every 40 years at most.
_FARTHEST = 366 * 41


def _field(text: str, k: int) -> frozenset[int] | None:
    lo, hi = _RANGES[k]
    out: set[int] = set()
    for part in text.lower().split(","):
        m = re.fullmatch(r"(\*|[a-z]{3}|\d+)(?:-([a-z]{3}|\d+))?(?:/(\d+))?", part)
        if not m:
            return None
        number = lambda s, k=k: _NAMES[k].get(s, int(s) if s.isdigit() else None)
        if m[1] == "*":
            if m[2]:
                return None
            a, b = lo, hi if k != 4 else 6
        else:
            a = number(m[1])
            b = number(m[2]) if m[2] else (hi if m[3] and k != 4 else 6 if m[3] else a)
        step = int(m[3]) if m[3] else 1
        if a is None or b is None or not lo <= a <= b <= hi or not step:
            return None
        out.update(range(a, b + 1, step))
    return frozenset(v % 7 for v in out) if k == 4 else frozenset(out)


def parse(expression: str | None) -> tuple | None:
    """The allowed values of each field, or None."""
    fields = (expression or "").split()
    if len(fields) != 5:
        return None
    sets = [_field(f, k) for k, f in enumerate(fields)]
    return None if any(s is None for s in sets) else (*sets, fields[2].startswith("*"), fields[4].startswith("*"))


def _on(day: datetime, parsed: tuple) -> bool:
    _, _, dom, month, dow, any_dom, any_dow = parsed
    if day.month not in month:
        return False
    in_dom, in_dow = day.day in dom, (day.weekday() + 1) % 7 in dow
    return in_dom and in_dow if any_dom or any_dow else in_dom or in_dow


def _fires(parsed: tuple, start: datetime, forward: bool) -> Iterator[datetime]:
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    times = sorted(((h, m) for h in parsed[1] for m in parsed[0]), reverse=not forward)
    for _ in range(_FARTHEST):
        if _on(day, parsed):
            for h, m in times:
                yield day.replace(hour=h, minute=m)
        day += timedelta(days=1 if forward else -1)


def prev_fire(expression: str, now: datetime) -> datetime | None:
    """The last fire at or before ``now``."""
    parsed = parse(expression)
    return next((t for t in _fires(parsed, now, False) if t <= now), None) if parsed else None


def next_fire(expression: str, base: datetime) -> datetime | None:
    """The first fire strictly after ``base``."""
    parsed = parse(expression)
    return next((t for t in _fires(parsed, base, True) if t > base), None) if parsed else None


def is_due(expression: str | None, since: datetime, now: datetime) -> bool:
    """Whether a fire lies in (since, now]; however many were missed, that is one run."""
    fire = prev_fire(expression, now) if expression else None
    return fire is not None and fire > since


# ---------------------------------------------------------------- by columns
#
# An expression is compiled to one bit mask per field; fires are found by arithmetic on masks and
# on the calendar of a month, so nothing leaves the JVM.

_FIELDS = ("minutes", "hours", "days", "months", "weekdays")
#: Months that are looked at first, and at all: 41 years.
_NEAR_MONTHS, _ALL_MONTHS = 13, _FARTHEST * 12 // 366


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shl(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _bit(n: Column) -> Column:
    return _shl(F.lit(1).cast("bigint"), n)


def _top(mask: Column) -> Column:
    """Place of the highest bit."""
    return F.length(F.bin(mask)) - 1


def _low(mask: Column) -> Column:
    return _top(mask.bitwiseAND(-mask))


def _below(n: Column) -> Column:
    """All bits under place ``n``."""
    return _bit(n) - 1


def _part_mask(part: Column, k: int) -> Column:
    """The bits of one part of field ``k``; null if it can't be read."""
    lo, hi = _RANGES[k]
    shape = r"^(\*|[a-z]{3}|\d+)(?:-([a-z]{3}|\d+))?(?:/(\d+))?$"
    first, last, every = (F.regexp_extract(part, shape, g) for g in (1, 2, 3))
    names = F.create_map(*(F.lit(x) for item in _NAMES[k].items() for x in item)) if _NAMES[k] else None
    number = lambda t: F.coalesce(*([names[t]] if names is not None else []), t.try_cast("int"))
    star, top = first == "*", 6 if k == 4 else hi
    start = F.when(star, F.lit(lo)).otherwise(number(first))
    end = F.when(star, F.when(last == "", F.lit(top))).when(last != "", number(last)).when(every != "", F.lit(top)).otherwise(start)
    step = F.when(every == "", F.lit(1)).otherwise(every.try_cast("int"))

    def bits(x: Column) -> Column:
        good = part.rlike(shape) & (x["a"] >= lo) & (x["a"] <= x["b"]) & (x["b"] <= hi) & (x["s"] >= 1)
        place = (lambda v: v % 7) if k == 4 else (lambda v: v)
        return F.when(good, F.aggregate(F.sequence(x["a"], x["b"], x["s"]), F.lit(0).cast("bigint"), lambda m, v: m.bitwiseOR(_bit(place(v)))))

    return _let(F.struct(start.alias("a"), end.alias("b"), step.alias("s")), bits)


def compiled(expression: Column) -> Column:
    """struct(minutes, hours, days, months, weekdays, either): masks, and whether a starred day field makes both needed; null if invalid."""

    def masks(fields: Column) -> Column:
        def field(k: int) -> Column:
            parts = F.transform(F.split(fields[k], ",", -1), lambda p: _part_mask(p, k))
            # A null part makes the whole null.
            return F.aggregate(parts, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseOR(p))

        made = F.struct(*(field(k).alias(n) for k, n in enumerate(_FIELDS)), (~(fields[2].startswith("*") | fields[4].startswith("*"))).alias("either"))
        whole = _let(made, lambda m: F.when(reduce(lambda a, b: a & b, (m[n].isNotNull() for n in _FIELDS)), m))
        return F.when(F.size(fields) == 5, whole)

    return _let(F.split(F.lower(ws_trim(F.coalesce(expression, F.lit("")))), r"\s+", -1), masks)


def valid_cron(c: Column) -> Column:
    return compiled(c).isNotNull()


def _month_days(c: Column, first: Column) -> Column:
    """Days (bits 1 to 31) of the month that begins on ``first`` on which an expression fires."""
    before = F.dayofweek(first) - 1
    week = _shl(c["weekdays"], 7 - before).bitwiseOR(F.call_function("shiftright", c["weekdays"], before)).bitwiseAND(F.lit(127).cast("bigint"))
    weekly = week * F.lit(2 * (1 + (1 << 7) + (1 << 14) + (1 << 21) + (1 << 28)))
    days = F.when(c["either"], c["days"].bitwiseOR(weekly)).otherwise(c["days"].bitwiseAND(weekly))
    there = days.bitwiseAND(_below(F.dayofmonth(F.last_day(first)) + 1))
    return F.when(c["months"].bitwiseAND(_bit(F.month(first))) != 0, there).otherwise(F.lit(0).cast("bigint"))


def _day_fires(c: Column, day: Column) -> Column:
    return _month_days(c, F.trunc(day, "MM")).bitwiseAND(_bit(F.dayofmonth(day))) != 0


def _another_day(c: Column, day: Column, forward: bool) -> Column:
    """The nearest day after (or before) ``day`` on which an expression fires, month by month; null if there is none."""

    def look(a: int, b: int) -> Column:
        def month(found: Column, k: Column) -> Column:
            first = F.add_months(F.trunc(day, "MM"), k if forward else -k)
            upto = _below(F.dayofmonth(day) + (1 if forward else 0))
            side = (F.lit(-1).cast("bigint") - upto) if forward else upto
            mask = _month_days(c, first).bitwiseAND(F.when(k == 0, side).otherwise(F.lit(-1).cast("bigint")))
            return F.when(found.isNotNull(), found).otherwise(_let(mask, lambda m: F.when(m != 0, F.date_add(first, ((_low if forward else _top)(m) - 1).cast("int")))))

        return F.aggregate(F.sequence(F.lit(a), F.lit(b)), F.lit(None).cast("date"), month)

    return F.coalesce(look(0, _NEAR_MONTHS - 1), look(_NEAR_MONTHS, _ALL_MONTHS))


def _time_of_day(c: Column, minute: Column, forward: bool) -> Column:
    """The nearest minute of the day at or after (at or before) ``minute``; null if there is none."""
    hour, m = F.floor(minute / 60), minute % 60
    here, pick = c["hours"].bitwiseAND(_bit(hour)) != 0, _low if forward else _top
    if forward:
        inside = c["minutes"].bitwiseAND(F.lit(-1).cast("bigint") - _below(m))
        others = c["hours"].bitwiseAND(F.lit(-1).cast("bigint") - _below(hour + 1))
    else:
        inside, others = c["minutes"].bitwiseAND(_below(m + 1)), c["hours"].bitwiseAND(_below(hour))
    return F.when(here & (inside != 0), hour * 60 + pick(inside)).when(others != 0, pick(others) * 60 + pick(c["minutes"]))


def _fire(expression: Column, at: Column, forward: bool) -> Column:
    def found(x: Column) -> Column:
        c, minute = x["c"], x["minute"]
        day = F.date_from_unix_date(F.floor(minute / 1440).cast("int"))
        edge = _low if forward else _top
        today = F.when(_day_fires(c, day), F.unix_date(day).cast("bigint") * 1440 + _time_of_day(c, minute - F.floor(minute / 1440) * 1440, forward))
        other = F.unix_date(_another_day(c, day, forward)).cast("bigint") * 1440 + edge(c["hours"]) * 60 + edge(c["minutes"])
        return F.when(c.isNotNull() & minute.isNotNull(), F.timestamp_seconds(F.coalesce(today, other) * 60))

    minute = F.floor(F.unix_seconds(at.cast("timestamp")) / 60) + (1 if forward else 0)
    return _let(F.struct(compiled(expression).alias("c"), minute.alias("minute")), found)


def prev_fire_column(expression: Column, now: Column) -> Column:
    """The last fire at or before ``now``; null for an invalid expression or one that never fires."""
    return _fire(expression, now, False)


def next_fire_column(expression: Column, base: Column) -> Column:
    """The first fire strictly after ``base``."""
    return _fire(expression, base, True)

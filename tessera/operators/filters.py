"""Structured filters: a small specification that becomes one column, so that it reaches the scan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_time, trim_space

OPERATORS = ("<", "<=", ">", ">=", "==")


@dataclass(frozen=True)
class TimeRange:
    """A metadata field's time between two ends, both included; None leaves an end open."""

    field: str
    start: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class Filter:
    """All parts must hold. impossible marks a filter that nothing can match."""

    sources: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)
    within: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time: TimeRange | None = None
    numeric: tuple[tuple[str, str, float], ...] = ()
    impossible: bool = False

    def is_empty(self) -> bool:
        return self == Filter()


def _number(value: Column) -> Column:
    return trim_space(value).try_cast("double")


def filter_expr(spec: Filter, source: str = "source", metadata: str = "metadata") -> Column:
    """The filter over a source column and a metadata map<string,string>.

    A missing key equals the empty text, but is in no list, matches no time and no number. An unknown
    operator matches nothing.
    """
    if spec.impossible:
        return F.lit(False)
    meta = lambda k: F.try_element_at(F.col(metadata), F.lit(k))
    out = F.lit(True)
    if spec.sources:
        out = out & F.col(source).isin(*spec.sources)
    for k, v in sorted(spec.equal.items()):
        out = out & (F.coalesce(meta(k), F.lit("")) == v)
    for k, values in sorted(spec.within.items()):
        out = out & (F.coalesce(meta(k).isin(*values), F.lit(False)) if values else F.lit(False))
    if spec.time:
        t = parse_time(meta(spec.time.field))
        ok = t.isNotNull()
        if spec.time.start is not None:
            ok = ok & (t >= F.lit(spec.time.start))
        if spec.time.end is not None:
            ok = ok & (t <= F.lit(spec.time.end))
        out = out & F.coalesce(ok, F.lit(False))
    for k, op, bound in spec.numeric:
        x = _number(meta(k))
        hit = {"<": x < bound, "<=": x <= bound, ">": x > bound, ">=": x >= bound, "==": x == bound}.get(op, F.lit(False))
        out = out & F.coalesce(hit, F.lit(False))
    return out


def merge_and(a: Filter, b: Filter) -> Filter:
    """Both filters as one: lists intersect, the time window tightens, b's equalities win over a's."""
    if a.impossible or b.impossible:
        return Filter(impossible=True)
    sources = a.sources or b.sources
    if a.sources and b.sources:
        sources = tuple(s for s in a.sources if s in b.sources)
        if not sources:
            return Filter(impossible=True)
    within = dict(a.within)
    for k, v in b.within.items():
        within[k] = tuple(x for x in within[k] if x in v) if k in within else v
    time = a.time or b.time
    if a.time and b.time:
        if a.time.field != b.time.field:
            return Filter(impossible=True)
        starts = [x for x in (a.time.start, b.time.start) if x is not None]
        ends = [x for x in (a.time.end, b.time.end) if x is not None]
        time = TimeRange(a.time.field, max(starts, default=None), min(ends, default=None))
    return Filter(sources, {**a.equal, **b.equal}, within, time, a.numeric + b.numeric)


def narrow(base: Filter, qualifier: Filter) -> Filter:
    """The base with a question's qualifiers; equalities that contradict each other match nothing."""
    if any(base.equal.get(k, v) != v for k, v in qualifier.equal.items()):
        return Filter(impossible=True)
    return merge_and(base, qualifier)


def parse_qualifiers(text: str) -> Filter:
    """A model's JSON (equal, in, time, numeric) as a filter; unknown operators and blank parts are left out.

    A date without a time as upper end means the whole of that day. Text that is no JSON object is an
    empty filter.
    """
    try:
        raw = json.loads(text)
    except ValueError:
        return Filter()
    if not isinstance(raw, dict):
        return Filter()

    def when(x: object, late: bool) -> datetime | None:
        if not isinstance(x, str) or not x.strip():
            return None
        try:
            t = datetime.fromisoformat(x.strip())
        except ValueError:
            return None
        if late and len(x.strip()) == 10:
            t += timedelta(days=1) - timedelta(microseconds=1)
        return t

    equal = {k.strip(): str(v).strip() for k, v in (raw.get("equal") or {}).items() if k.strip() and str(v).strip()}
    within = {k.strip(): tuple(str(x).strip() for x in v if str(x).strip()) for k, v in (raw.get("in") or {}).items() if k.strip() and isinstance(v, list)}
    time = None
    if isinstance(t := raw.get("time"), dict) and str(t.get("field", "")).strip():
        start, end = when(t.get("from"), False), when(t.get("to"), True)
        if start or end:
            time = TimeRange(t["field"].strip(), start, end)
    numeric = tuple((n["field"].strip(), n["op"], float(n["value"])) for n in raw.get("numeric") or () if isinstance(n, dict) and n.get("op") in OPERATORS and str(n.get("field", "")).strip() and isinstance(n.get("value"), int | float))
    return Filter((), equal, {k: v for k, v in within.items() if v}, time, numeric)


def with_fallback(rows: DataFrame, base: Filter, qualifier: Filter, relaxable: bool = True) -> DataFrame:
    """Rows under both filters, or under the base alone if both leave nothing and the qualifier may give way."""
    both = rows.where(filter_expr(narrow(base, qualifier)))
    if relaxable and not qualifier.is_empty() and both.isEmpty():
        return rows.where(filter_expr(base))
    return both


def expand_collection(selector: str, members: DataFrame, sources: DataFrame) -> DataFrame:
    """The distinct source names of a collection.

    members: collection, type, name, where name `*` takes all of a type. sources: type, name.
    """
    m = members.where(F.col("collection") == selector).alias("m")
    s = sources.alias("s")
    # One collection's members: a handful of rows by their nature, yet left to the planner to place.
    joined = s.join(m, (F.col("s.type") == F.col("m.type")) & ((F.col("m.name") == "*") | (F.col("m.name") == F.col("s.name"))))
    return joined.select(F.col("s.name").alias("name")).distinct()


def with_sources(spec: Filter, names: list[str]) -> Filter:
    return replace(spec, sources=tuple(names))

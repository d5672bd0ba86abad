"""Facets: a bucket column is added to the rows (one row for each bucket of a document), then grouped, ranked and cut, level by level."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, values
from ..plans.errors import RequestError, only
from .collection import Scope

COMMON = "ops limit mincount missing sort selected selection_mode count_unit count_distinct offset "


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def term_filter(spec: Mapping[str, Any], c: Column) -> Column:
    only(spec, "prefix regex exclude_regex include exclude partition", "term_filter")
    keep = F.lit(True)
    if "prefix" in spec:
        keep = keep & c.startswith(spec["prefix"])
    if "regex" in spec:
        keep = keep & c.rlike(f"^(?:{spec['regex']})$")
    if "exclude_regex" in spec:
        keep = keep & ~c.rlike(f"^(?:{spec['exclude_regex']})$")
    if "include" in spec:
        keep = keep & c.isin(list(spec["include"]))
    if "exclude" in spec:
        keep = keep & ~c.isin(list(spec["exclude"]))
    if "partition" in spec:
        part, of = int(spec["partition"]["index"]), int(spec["partition"]["count"])

        @F.pandas_udf("boolean")
        def mine(t: pd.Series) -> pd.Series:
            return t.map(lambda x: x is not None and fnv1a64(x) % of == part)

        keep = keep & mine(c)
    return keep


def group_key(scope: Scope, spec: Any) -> tuple[list[Column], str]:
    """Columns of a collapse's key, and what becomes of rows without one: expand, group or drop."""
    spec = {"field": spec} if isinstance(spec, (str, list)) else spec
    names = spec["field"] if isinstance(spec["field"], list) else [spec["field"]]
    return [scope.column(n) for n in names], spec.get("missing", "expand")


def counter(scope: Scope, spec: Mapping[str, Any], collapse: Any) -> Column:
    """Documents, or exact distinct keys. Rows without a key are a group each, one group, or none."""
    own = spec.get("count_distinct") or (collapse if spec.get("count_unit") == "groups" else None)
    if not own:
        return F.count("*")
    keys, missing = group_key(scope, own)
    lone = F.lit(False)
    for k in keys:
        lone = lone | k.isNull()
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    if missing == "drop":
        return F.count_distinct(F.when(~lone, key))
    if missing == "group":
        return F.count_distinct(key)
    return F.count_distinct(F.struct(F.when(~lone, key).alias("k"), F.when(lone, F.col("_owner_")).alias("o")))


def bucket(scope: Scope, kind: str, spec: Mapping[str, Any], name: str, compile: Callable[[Any], Column], extent: Callable[[Column], tuple]) -> tuple[Callable[[DataFrame], DataFrame], list[Any] | None]:
    """How to add the bucket column to any rows of the view, and the buckets in order where the request fixes them."""
    if kind == "query_facet":
        only(spec, COMMON + "buckets", kind)
        tests = {n: compile(q) for n, q in spec["buckets"].items()}
        hits = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
        return lambda df: df.withColumn(name, F.explode(hits)), list(tests)
    if kind == "field_facet":
        only(spec, COMMON + "field term_filter", kind)
        field = scope.view.field(spec["field"], "value")
        if field.type == "text":
            column = scope.view.tokens(field)
            each = F.array_distinct(F.transform(column, lambda x: x.t))
            added = lambda df: df.withColumn(name, F.explode(each))
        elif field.multi:
            added = lambda df: df.withColumn(name, F.explode(F.array_distinct(F.col(field.source))))
        else:
            added = lambda df: df.withColumn(name, F.col(field.source)).where(F.col(name).isNotNull())
        if "term_filter" not in spec:
            return added, None
        return lambda df: added(df).where(term_filter(spec["term_filter"], F.col(name))), None
    only(spec, COMMON + "field start end gap bounds origin calendar_gap time_zone include max_buckets", kind)
    field = scope.view.field(spec["field"], "value")
    c = F.col(field.source)
    read = values.instant if field.type == "date" else (lambda x: x)
    zone = spec.get("time_zone", scope.time_zone)
    at = lambda v: dates.window(v, scope.now, zone)[0] if field.type == "date" else v
    each = F.transform(c, read) if field.multi else read(c)
    unit = spec.get("calendar_gap")
    if spec.get("bounds", "explicit").lower() == "data":
        low, high = extent(F.array_min(each) if field.multi else each), extent(F.array_max(each) if field.multi else each)
        low, high = low[0], high[1]
        if low is None:
            return lambda df: df.withColumn(name, F.lit(None).cast("double")).where(F.lit(False)), []
        if unit:
            start, stop = dates.floor_instant(int(low), dates.unit_of(unit["unit"]), zone), int(high) + 1
        else:
            origin, gap = at(spec.get("origin", 0)), spec["gap"]
            start = origin + (low - origin) // gap * gap
            stop = start + ((high - start) // gap + 1) * gap
    else:
        start, stop = at(spec["start"]), at(spec["end"])
    if unit:
        edges = dates.fences(int(start), int(stop), int(unit.get("n", 1)), dates.unit_of(unit["unit"]), zone)
        if spec.get("bounds", "explicit").lower() != "data":
            edges[-1] = min(edges[-1], int(stop))
        literal = F.array(*(F.lit(e) for e in edges))
        # The fences are sorted, so a value's bucket is how many lie at or below it.
        place = lambda x: F.when((x >= edges[0]) & (x < edges[-1]), F.element_at(literal, F.size(F.filter(literal, lambda e: e <= x))))
        known = edges[:-1]
    else:
        gap = spec["gap"]
        n = -(-(stop - start) // gap)
        if n > 100_000:
            raise RequestError("too_many_buckets", "over 100,000 buckets")
        place = lambda x: F.when((x >= start) & (x < stop), F.floor((x - start) / F.lit(gap)) * gap + start)
        known = [start + i * gap for i in range(int(n))]
    kind_name = "long" if all(isinstance(k, int) for k in known) else "double"
    if field.multi:
        return lambda df: df.withColumn(name, F.explode(F.array_distinct(F.filter(F.transform(each, place), lambda x: x.isNotNull()))).cast(kind_name)), known
    return lambda df: df.withColumn(name, place(each).cast(kind_name)).where(F.col(name).isNotNull()), known


def counted(rows: DataFrame, parents: Sequence[str], name: str, count: Column, metrics: Mapping[str, Column], kind: str, spec: Mapping[str, Any], known: list[Any] | None) -> DataFrame:
    """Buckets with count and metrics, ranked within their parents and cut to the facet's limit."""
    out = rows.groupBy(*parents, name).agg(count.alias("count"), *(m.alias(n) for n, m in metrics.items()))
    least = spec.get("mincount", 1 if kind == "field_facet" else 0)
    if known is not None and least == 0 and known:
        spark = rows.sparkSession
        listed = spark.createDataFrame([(k, i) for i, k in enumerate(known)], out.select(name).withColumn("_at", F.lit(0)).schema)
        if parents:
            tops = out.select(*parents).distinct()
            listed = tops.withColumn("_all", F.explode(F.array(*(F.struct(F.lit(k).cast(out.schema[name].dataType).alias(name), F.lit(i).alias("_at")) for i, k in enumerate(known))))).select(*parents, "_all.*")
        out = listed.join(out, [*parents, name], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    elif known is not None and kind == "query_facet":
        out = out.withColumn("_at", F.array_position(F.array(*(F.lit(k) for k in known)), F.col(name)))
    out = out.where(F.col("count") >= least)
    if kind == "field_facet":
        order = []
        for s in spec.get("sort") or []:
            what, _, way = s.partition(" ")
            order.append(F.col(what).asc_nulls_last() if way == "asc" else F.col(what).desc_nulls_last())
        order = [*order, F.desc("count"), F.asc(name)] if order else [F.desc("count"), F.asc(name)]
    else:
        order = [F.asc("_at")] if "_at" in out.columns else [F.asc(name)]
    limit, skip = spec.get("limit", 5 if kind == "field_facet" else -1), int(spec.get("offset", 0))
    if parents:
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*parents).orderBy(*order)))
        out = out.where((F.col("_rank") > skip) & ((F.col("_rank") <= skip + limit) if limit >= 0 else F.lit(True)))
        return out.orderBy(*parents, "_rank").drop("_rank", "_at")
    out = out.orderBy(*order)
    out = out.offset(skip) if skip else out
    return (out.limit(limit) if limit >= 0 else out).drop("_at")

"""Values of incoming documents made to fit their fields; what doesn't fit is told document by document."""

from __future__ import annotations

from collections.abc import Mapping
from ipaddress import ip_address

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..operators.geo import point
from ..plans.errors import RequestError
from ..plans.schema import Field, Schema

#: Letters of geohashes, in order. A fixed value.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Vector components may be this large at most.
MAGNITUDE = float(1 << 40)


def geohash(text: str) -> tuple[float, float]:
    """(lat, lon) of a geohash cell's middle."""
    low, high = [-90.0, -180.0], [90.0, 180.0]
    axis = 1
    for c in text.lower():
        n = GEOHASH.index(c)
        for bit in range(4, -1, -1):
            middle = (low[axis] + high[axis]) / 2
            (low if n >> bit & 1 else high)[axis] = middle
            axis = 1 - axis
    return (low[0] + high[0]) / 2, (low[1] + high[1]) / 2


def _points(c: Column) -> Column:
    """Points from text: JSON in any form, "lat,lon", WKT or a geohash; null if malformed."""

    @F.pandas_udf("struct<lat:double,lon:double>")
    def run(values: pd.Series) -> pd.DataFrame:
        import json

        def one(v: str | None) -> tuple[float | None, float | None]:
            if v is None:
                return None, None
            try:
                text = v.strip()
                lat, lon = point(json.loads(text)) if text[:1] in "[{" else point(text) if "," in text or "(" in text else geohash(text)
                return (lat, lon) if -90 <= lat <= 90 and -180 <= lon <= 180 else (None, None)
            except (ValueError, KeyError, TypeError, IndexError):
                return None, None

        return pd.DataFrame([one(v) for v in values], columns=["lat", "lon"])

    made = run(c)
    return F.when(made["lat"].isNotNull(), made)


def _ips(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> bytes | None:
            try:
                a = ip_address(v) if v is not None else None
            except ValueError:
                return None
            return None if a is None else b"\x00" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed

        return values.map(one)

    return run(c)


def _instants(c: Column) -> Column:
    """ISO dates of any granule, or epoch milliseconds, as timestamps: a partial date is its first instant."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> int | None:
            try:
                return None if v is None else dates.window(v, 0)[0]
            except RequestError:
                return None

        return values.map(one).astype("Int64")

    return F.timestamp_millis(run(c))


def _one(field: Field, c: Column, kind: T.DataType) -> Column:
    text = isinstance(kind, T.StringType)
    if field.type in ("string", "id", "text"):
        return c.cast("string")
    if field.type == "int":
        # A number with a fraction doesn't fit, and is never cut.
        return F.when(c.try_cast("double") == F.floor(c.try_cast("double")), c.try_cast("long") if not text else F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long")))
    if field.type in ("float", "double"):
        return c.try_cast(field.type)
    if field.type == "decimal":
        return F.round(c.try_cast("decimal(38,18)"), field.scale).try_cast(f"decimal(19,{field.scale})")
    if field.type == "boolean":
        return F.when(c.cast("string").isin("true", "false"), c.cast("string") == "true") if text or isinstance(kind, T.BooleanType) else F.lit(None).cast("boolean")
    if field.type == "date":
        return _instants(c.cast("string")) if text or isinstance(kind, T.IntegralType) else c.cast("timestamp")
    if field.type == "ip":
        return _ips(c) if text else c
    if field.type == "geo_point":
        return _points(c) if text else c
    return c


def vector(c: Column, field: Field) -> Column:
    """Finite components of bounded magnitude and the field's length; cut to truncate_dims; cosine vectors of length 1."""
    sound = (F.size(c) == field.dims if field.dims else F.lit(True)) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= MAGNITUDE))
    cut = F.slice(c, 1, field.truncate_dims) if field.truncate_dims else c
    if field.metric == "cosine":
        size = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        cut = F.transform(cut, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))
    return F.when(sound, cut)


def coerced(df: DataFrame, schema: Schema | Mapping, key: str = "id", ignore_malformed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): every column with a field in its field's form; a document with a value that doesn't fit is bad, with `error`.

    With `ignore_malformed` such a value is missing instead. Sets are sorted and without repeats; an empty array is missing.
    """
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    made: dict[str, Column] = {}
    wrong: list[Column] = []
    for f in df.schema.fields:
        try:
            field = schema.find(f.name, df.schema)
        except RequestError:
            continue
        c = F.col(f.name)
        if field.type == "vector":
            out = F.transform(c, lambda v, field=field: vector(v, field)) if field.multi else vector(c, field)
        elif isinstance(f.dataType, T.ArrayType) and field.multi and field.type in ("string", "int", "float", "double", "boolean"):
            out = F.transform(c, lambda x: _one(field, x, f.dataType.elementType))
            wrong.append(F.when(F.exists(out, lambda x: x.isNull()) & ~F.exists(c, lambda x: x.isNull()), F.lit(f"{f.name} has values that are not {field.type}")))
            out = F.filter(out, lambda x: x.isNotNull())
            out = F.array_sort(F.array_distinct(out)) if field.multi == "set" else out
            out = F.when(F.size(out) > 0, out)
            made[f.name] = out
            continue
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            out = c
        else:
            out = _one(field, c, f.dataType)
        wrong.append(F.when(c.isNotNull() & out.isNull(), F.lit(f"{f.name} is not {field.type}")))
        made[f.name] = out
    error = F.coalesce(*([] if ignore_malformed else wrong), F.when(F.col(key).isNull(), F.lit(f"{key} is missing")))
    marked = df.withColumns({f"_new_{n}": c for n, c in made.items()}).withColumn("error", error)
    good = marked.where("error is null").select(*(F.col(f"_new_{n}").alias(n) if n in made else F.col(n) for n in df.columns))
    return good, marked.where("error is not null").select(*df.columns, "error")

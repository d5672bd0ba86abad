"""How results leave: request flags, row or column documents, and decorators of hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import RequestError

#: Decorators by name: each adds columns to a page of hits.
DECORATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FLAGS = ("date_native", "date_iso", "date_ms", "date_ns", "int64_str", "decimal_scaled")


def register(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    DECORATORS[name] = fn


def decorated(page: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        if n not in DECORATORS:
            raise RequestError("unknown_decorator", f"no decorator {n}")
        page = DECORATORS[n](page)
    return page


def _shaped(c: Column, kind: T.DataType, flags: Mapping[str, Any]) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _shaped(x, kind.elementType, flags))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = c.cast("timestamp")
        if flags.get("date_ns"):
            return F.unix_micros(at) * 1000
        if flags.get("date_ms"):
            return F.unix_millis(at)
        return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if flags.get("date_iso") else c
    if isinstance(kind, T.LongType) and flags.get("int64_str"):
        return c.cast("string")
    if isinstance(kind, T.DecimalType) and flags.get("decimal_scaled"):
        return (c * (10**kind.scale)).cast("long")
    return c


def shaped(page: DataFrame, flags: Mapping[str, Any]) -> DataFrame:
    """Dates as native values, ISO text, milliseconds or nanoseconds; whole numbers as text; decimals as scaled numbers."""
    if sum(bool(flags.get(f)) for f in FLAGS[:4]) > 1:
        raise RequestError("bad_flags", "one date mode at a time")
    return page.select(*(_shaped(F.col(f.name), f.dataType, flags).alias(f.name) for f in page.schema.fields))


def documents(page: DataFrame, layout: str = "row") -> Any:
    """Rows without missing fields; or columns of all values; `adaptive` takes columns where no value is missing."""
    rows = [r.asDict(recursive=True) for r in page.collect()]
    if layout == "row":
        return [{k: v for k, v in r.items() if v is not None} for r in rows]
    columns = {c: [r[c] for r in rows] for c in page.columns}
    if layout == "column":
        return columns
    if layout != "adaptive":
        raise RequestError("bad_format", f"no document format {layout}")
    whole = {c: v for c, v in columns.items() if None not in v}
    return {"columns": whole, "docs": [{k: v for k, v in r.items() if v is not None and k not in whole} for r in rows]}


def canonical(request: Mapping[str, Any], vars: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The request with every query in its structured form, as `explain` echoes it."""
    from .query import normalise

    def walk(x: Any, key: str = "") -> Any:
        if isinstance(x, str) and key in ("query", "filter", "required", "optional", "prohibited", "queries"):
            return walk(normalise(x, vars))
        if isinstance(x, Mapping):
            return {k: walk(v, k) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [walk(v, key) for v in x]
        return x

    out = walk(dict(request))
    return out if "ops" in out and not {"query", "filter", "sort"} & set(out) else {"ops": {"q": {"top_docs": out}}}

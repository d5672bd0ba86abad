"""A collection: rows, their schema, and the views that requests run in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis
from ..functions.values import Names, now_ms
from ..plans.errors import RequestError, Warn
from ..plans.schema import Field, Schema
from .scoring import Rehearsal, Stats

ORDER = "_docid_"


class Collection:
    """`df` with a unique column `key`; its order is the documents' order wherever sorts tie."""

    def __init__(self, df: DataFrame, schema: Schema | Mapping | None = None, key: str = "id"):
        self.schema = schema if isinstance(schema, Schema) else Schema(schema)
        self.key = key
        self.df = df.withColumn(ORDER, F.col(key))
        self.views: dict[str, View] = {}

    def view(self, path: str = "") -> View:
        if path not in self.views:
            self.views[path] = View(self, path)
        return self.views[path]

    def search(self, request: Mapping[str, Any], **options: Any):
        from .search import search

        return search(self, {**request, **options})


class View:
    """The rows at a nested path ("" for documents): child columns, with `_owner_` the document's key and `_at_` places on the way."""

    def __init__(self, collection: Collection, path: str):
        self.collection, self.path = collection, path
        self.texts: dict[str, tuple[str, Field]] = {}

    @cached_property
    def base(self) -> DataFrame:
        df, key = self.collection.df, self.collection.key
        if not self.path:
            return df.withColumn("_owner_", F.col(key))
        at = df.select(F.col(key).alias("_owner_"), ORDER, F.array().cast("array<int>").alias("_at_"), F.struct(*df.columns).alias("_0"))
        for i, name in enumerate(self.path.split(".")):
            above = [f"_{j}" for j in range(i + 1)]
            at = at.select("_owner_", ORDER, "_at_", *above, F.posexplode(f"_{i}.{name}").alias("_p", f"_{i + 1}")).withColumn("_at_", F.concat("_at_", F.array("_p"))).drop("_p")
        depth = len(self.path.split("."))
        return at.select("_owner_", "_at_", f"_{depth}.*", *[F.col(f"_{j}").alias(f"_up{depth - j}") for j in range(depth)], F.struct(ORDER, "_at_").alias("_row_")).withColumn(ORDER, F.struct(F.col("_owner_"), F.col("_at_")))

    @property
    def columns(self) -> T.StructType:
        return T.StructType([f for f in self.base.schema.fields if not f.name.startswith("_")])

    def field(self, name: str, use: str = "primary") -> Field:
        schema = self.collection.schema
        full = f"{self.path}.{name}" if self.path else name
        if full in schema.fields:
            return schema.fields[full] if use == "primary" else schema.find(full, self.columns, use)
        return schema.find(name, self.columns, use)

    def names(self, pattern: str) -> list[str]:
        from fnmatch import fnmatchcase

        known = [*self.columns.names, *(n for n in self.collection.schema.fields if "." not in n)]
        return [n for n in dict.fromkeys(known) if fnmatchcase(n, pattern)]

    def tokens(self, field: Field) -> str:
        """The name of the column of a text's tokens; analyse() adds it."""
        name = f"_tok_{field.name}"
        self.texts[name] = (field.source, field)
        return name

    def analyse(self, df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
        made = {n: analysis.tokens(F.col(s), f.analyzer, f.multi is not None) for n, (s, f) in self.texts.items() if n not in df.columns and (only is None or n in only)}
        return df.withColumns(made) if made else df


class Scope:
    """What one request shares: the view, frozen time, variables, corpus numbers, warnings."""

    def __init__(self, view: View, options: Mapping[str, Any] | None = None, stats: Stats | None = None):
        self.view, self.options = view, dict(options or {})
        self.now = self.options.setdefault("now", now_ms())
        self.time_zone = self.options.get("time_zone")
        self.warnings: list[Warn] = self.options.setdefault("warnings", [])
        self.exact_norms = bool(self.options.get("exact_norms"))
        self._stats = stats

    def stats_for(self, column: str) -> Stats:
        """Numbers of the whole view, whatever the request selects."""
        held = self.options.setdefault("stats", {})
        at = (self.view.path, column)
        if at not in held:
            made = Rehearsal if self.options.get("rehearsal") else Stats
            held[at] = made(self.view.analyse(self.view.base, [column]))
        return held[at]

    def at(self, path: str) -> Scope:
        return Scope(self.view.collection.view(path), self.options)

    def column(self, name: str) -> Column:
        """A field's values in this view: arrays for many, also along a nested path."""
        if name in self.view.columns.names and name not in self.view.collection.schema.fields:
            return F.col(name)
        head, dot, tail = name.partition(".")
        if dot and head in self.view.columns.names:
            out = F.col(head)
            for i, part in enumerate(tail.split(".")):
                out = (F.flatten(out) if i else out)[part]
            return out
        f = self.view.field(name, "value")
        if f.type == "text":
            raise RequestError("field_without_values", f"{name} is analysed text; it has no values")
        return F.col(f.source)

    def kind(self, name: str) -> str:
        if name.startswith("["):
            inner = name[1:-1]
            if "." in inner and inner.partition(".")[0] in self.view.columns.names:
                return "many"
            try:
                return "many" if self.view.field(inner, "value").multi else "one"
            except RequestError:
                return "one"
        try:
            head = name.partition(".")[0]
            if "." in name and head in self.view.columns.names:
                kind = self.view.columns[head].dataType
                for part in name.split(".")[1:]:
                    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
                    kind = kind[part].dataType
                return "int" if kind.simpleString() in ("int", "bigint", "smallint", "tinyint") else kind.simpleString()
            return self.view.field(name, "value").type
        except (RequestError, KeyError):
            return ""

    def expressions(self, score: Column | None = None, vars: Mapping[str, Any] | None = None) -> Names:
        return Names(self.column, {**self.options.get("vars", {}), **(vars or {})}, score, self.kind)

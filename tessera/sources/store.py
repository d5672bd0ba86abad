"""Collections on disk: each commit is a new version, published by one rename of a manifest, so readers keep the version they opened.

Paths may be on any store that Spark reads; nothing here uses local file calls.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import RequestError
from ..plans.schema import Schema

CONTROL = ("_update_", "_end_", "_header_")


class Files:
    """Hadoop's file system for one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Written beside, then moved into place."""
        beside = self.path(path + ".next")
        out = self.fs.create(beside, True)
        out.write(text.encode())
        out.close()
        self.fs.delete(self.path(path), False)
        if not self.fs.rename(beside, self.path(path)):
            raise RequestError("commit_failed", f"{path} could not be published", "INTERNAL")

    def list(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path)) if s.isDirectory()) if self.fs.exists(self.path(path)) else []

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)

    def move(self, a: str, b: str) -> None:
        if self.fs.exists(self.path(b)):
            raise RequestError("already_exists", b, "ALREADY_EXISTS")
        if not self.fs.rename(self.path(a), self.path(b)):
            raise RequestError("not_found", a, "NOT_FOUND")


def mapped(df: DataFrame, field_map: Mapping[str, str] | None = None, drop_unmapped: bool = False) -> DataFrame:
    """Columns renamed; where two land on one name the last wins; others stay unless `drop_unmapped`."""
    field_map = field_map or {}
    out: dict[str, Column] = {}
    for c in df.columns:
        if c in field_map:
            out[field_map[c]] = F.col(c)
        elif not drop_unmapped:
            out.setdefault(c, F.col(c))
    return df.select(*(c.alias(n) for n, c in out.items()))


def latest(df: DataFrame, key: str = "id", order: Sequence[str] = ("_seq_",)) -> DataFrame:
    """The last document of each key within a batch."""
    by = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("_n_", F.row_number().over(by)).where("_n_ = 1").drop("_n_")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", delete: DataFrame | Sequence | None = None, allow_dups: bool = False) -> DataFrame:
    """Whole-document replacement by key: old rows that neither a new nor a deleted key names, then the new ones."""
    kept = old if allow_dups else old.join(new.select(key).distinct(), key, "left_anti")
    if delete is not None:
        gone = delete.select(key) if isinstance(delete, DataFrame) else old.sparkSession.createDataFrame([(d,) for d in delete], T.StructType([T.StructField(key, old.schema[key].dataType)]))
        kept = kept.join(gone.distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def checked(df: DataFrame, types: Mapping[str, str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(good, bad): columns cast to `types`; a document with a value that can't be cast, or without key, is bad, with `error`."""
    wrong = [F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull(), F.lit(f"{c} is not {t}")) for c, t in types.items() if c in df.columns]
    marked = df.withColumn("error", F.coalesce(*wrong, F.when(F.col(key).isNull(), F.lit(f"{key} is missing"))) if wrong else F.when(F.col(key).isNull(), F.lit(f"{key} is missing")))
    good = marked.where("error is null").drop("error")
    return good.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in types.items() if c in df.columns}), marked.where("error is not null")


class Store:
    """One collection's versions under `path`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.files = Files(spark, path)

    def manifest(self) -> dict[str, Any]:
        return json.loads(self.files.read(f"{self.path}/manifest.json") or '{"version": 0, "schema": {}}')

    def read(self, version: int | None = None, at_least: int | None = None) -> DataFrame | None:
        """The latest version, or the one named; `at_least` fails if it isn't published yet."""
        held = self.manifest()["version"]
        if at_least is not None and held < at_least:
            raise RequestError("not_committed", f"version {at_least} is not published", "UNAVAILABLE")
        n = held if version is None else version
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/v={n}") if n else None

    def commit(self, df: DataFrame, max_segments: int | None = None, cluster: Sequence[str] = (), compression: str = "zstd") -> int:
        """`df` as the next version; `max_segments` bounds its files, `cluster` sorts within them so that statistics prune."""
        now = self.manifest()
        out = df.coalesce(max_segments) if max_segments else df
        out = out.sortWithinPartitions(*cluster) if cluster else out
        n = now["version"] + 1
        out.write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/v={n}")
        self.files.publish(f"{self.path}/manifest.json", json.dumps({**now, "version": n}))
        return n

    def update(self, docs: DataFrame | None = None, delete_ids: DataFrame | Sequence | None = None, *, types: Mapping[str, str] | None = None, field_map: Mapping[str, str] | None = None, drop_unmapped: bool = False, allow_dups: bool = False, all_or_none: bool = False, max_segments: int | None = None) -> dict[str, Any]:
        """One batch, published as a whole. Bad documents are reported and left out; with `all_or_none` they stop the batch."""
        old = self.read()
        errors: list[dict] = []
        if docs is not None:
            docs = mapped(docs, field_map, drop_unmapped)
            docs, bad = checked(docs, types or {}, self.key)
            errors = [{"id": r[self.key], "message": r["error"]} for r in bad.select(self.key, "error").limit(1000).collect()]
            if errors and all_or_none:
                raise RequestError("batch_rejected", f"{len(errors)} bad documents: {errors[0]['message']}")
            if not allow_dups:
                docs = latest(docs.withColumn("_seq_", F.monotonically_increasing_id()), self.key).drop("_seq_")
        if docs is None:
            docs = old.limit(0) if old is not None else None
        if docs is None:
            return {"version": 0, "errors": errors}
        out = docs if old is None else upserted(old, docs, self.key, delete_ids, allow_dups)
        return {"version": self.commit(out, max_segments), "errors": errors}

    def set_schema(self, fields: Mapping[str, Any], replace_all: bool = False) -> Schema:
        now = self.manifest()
        held = fields if replace_all else {**now["schema"], **fields}
        made = Schema(held)
        self.files.publish(f"{self.path}/manifest.json", json.dumps({**now, "schema": held}))
        return made

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops versions before the last `keep`."""
        names = sorted((n for n in self.files.list(self.path) if n.startswith("v=")), key=lambda n: int(n[2:]))
        gone = [n for n in names if int(n[2:]) <= self.manifest()["version"] - keep]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        return gone


class Catalog:
    """Collections by name under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def list(self) -> list[str]:
        return self.files.list(self.path)

    def get(self, name: str) -> Store:
        return Store(self.spark, f"{self.path}/{name}")

    def create(self, name: str, schema: Mapping[str, Any] | None = None) -> Store:
        if name in self.list():
            raise RequestError("already_exists", f"collection {name} exists", "ALREADY_EXISTS")
        out = self.get(name)
        out.set_schema(schema or {}, replace_all=True)
        return out

    def drop(self, name: str) -> None:
        if not self.files.delete(f"{self.path}/{name}"):
            raise RequestError("not_found", f"no collection {name}", "NOT_FOUND")

    def rename(self, a: str, b: str) -> None:
        self.files.move(f"{self.path}/{a}", f"{self.path}/{b}")

    def swap(self, a: str, b: str) -> None:
        self.rename(a, f"{a}.swapped")
        self.rename(b, a)
        self.rename(f"{a}.swapped", b)


def ndjson(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, deleted ids) of NDJSON files: an object a line is a document, `{"_update_": {"delete_ids": [...]}}` and other control records are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    control = F.coalesce(F.get_json_object("value", "$._update_"), F.get_json_object("value", "$._end_"), F.get_json_object("value", "$._header_"))
    plain = lines.where(control.isNull() & (F.trim("value") != "{}"))
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    docs = plain.select(F.from_json("value", kind).alias("d")).select("d.*")
    gone = lines.select(F.explode(F.from_json(F.get_json_object("value", "$._update_.delete_ids"), "array<string>")).alias("id"))
    return docs, gone


def exported(df: DataFrame, path: str, layout: str = "docs") -> None:
    """All rows: one document a line without missing fields, or Parquet columns."""
    if layout == "docs":
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").parquet(path)

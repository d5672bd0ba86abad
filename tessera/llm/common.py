"""Shared helpers of the training-data operators: tokens, batches, durable cuts of lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python step holds at a time; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where that is unset, on a local master, a temporary one serves."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder, without its lineage; a lost executor costs no recomputation."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again; Python steps on the way get at most `rows` rows at a time.

    Later steps read only the columns they need, and loops stay cheap to plan: a checkpoint hands on all constraints of
    the plan it cuts, and those multiply from one turn to the next. Shuffle files of the write go at its end, as nothing
    reads them again; else they would stay until the driver happens to collect its garbage.
    """
    conf, folder = df.sparkSession.conf, f"{_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        # Snappy takes direct memory for whole pages, which without a check grow to a hundred rows of any size, and keeps it.
        df.write.option("compression", "zstd").option("parquet.page.size.row.check.min", "4").parquet(folder)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote for `df`, which no later step reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: What this Python worker keeps from one task to the next.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept for tasks of the same step; a released() step that doesn't name `key` drops it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, in tasks that leave no memory behind.

    Workers serve one step after another. Without this each would go on holding the most that any of its tasks took, and
    what earlier steps keep.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in [k for k in _KEPT if k != key]:
            del _KEPT[k]
        try:
            yield from run(batches)
        finally:
            give_back()

    return step


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ..., so that an operator's own names can't clash with them, and those names by the former ones."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str], *own: str) -> DataFrame:
    """The columns of numbered() under their former names, then the operator's `own`. Names change by place, so none can stand for another."""
    return df.select(*names.values(), *own).toDF(*names, *own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of `batch` with at most `limit` bytes of text and `rows` rows, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        to = min(to, at + rows) if rows else to
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, A-Z in lower case if `lower`: how many, and all of them in order. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    offsets = offsets - offsets[0]
    # A copy of its own: ascii_lower reads wrong bytes of arrays that begin within a buffer.
    flat = flat.take(pa.array(np.flatnonzero(full)))
    return np.diff(before[offsets]), pc.ascii_lower(flat) if lower else flat


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of `flat`'s values and the distinct values."""
    if not len(flat):
        return np.zeros(0, np.int64), flat
    packed = flat.dictionary_encode()
    return packed.indices.to_numpy(zero_copy_only=False).astype(np.int64), packed.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each value's bytes. Equal hashes count as equal values: with 10^9 distinct values, two share one in 1 of 37 corpora."""
    raw = values.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in raw), np.uint64, len(raw))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order is as good as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

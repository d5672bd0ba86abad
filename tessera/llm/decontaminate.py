"""Benchmark decontamination by the q-gram lemma.

An item is cut into overlapping segments of WINDOW characters. Within EDITS errors of a segment of length m, a stretch of
text shares at least m - q + 1 - q * EDITS of its q-grams, all on diagonals no further apart than EDITS. Hits are counted
in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, released, slices

#: Characters of a segment, of a q-gram, and errors allowed in a whole segment (shorter items: in proportion).
WINDOW, Q, EDITS = 64, 8, 3
#: Characters from one segment's start to the next. Any passage of WINDOW characters is then within STRIDE // 2 of a segment.
STRIDE = 4
#: Bits of the table that tells most q-grams of texts apart from those of items.
TABLE_BITS = 22
#: Characters of items, once for each half window of their segments' starts, whose index is sent to the executors at a time;
#: a longer benchmark takes more passes.
BLOCK_CHARS = 4 << 20
#: Text bytes gone through at a time, shared q-grams counted at a time, and candidates aligned at a time.
STEP_BYTES, HITS, ALIGNED = 1 << 18, 1 << 20, 1 << 15


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position on."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out = out * np.uint64(0x100000001B3) + codes[i : i + n]
    return mixed(out)


class Index:
    """Segments of items, and where their q-grams occur."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []
        self.length: list[int] = []
        self.edits: list[int] = []
        rows, hashes, at = [], [], []
        for item, text in items:
            codes = _codes(normal(text or ""))
            last = max(0, len(codes) - WINDOW)
            for start in sorted({*range(0, last, STRIDE), last}):
                part = codes[start : start + WINDOW]
                if len(part) < Q:
                    continue
                rows.append(np.pad(part, (0, WINDOW - len(part))))
                made = grams(part)
                hashes.append(made)
                at.append(np.stack([np.full(len(made), len(self.item)), np.arange(len(made))], axis=1))
                self.item.append(item)
                self.length.append(len(part))
                self.edits.append(EDITS * len(part) // WINDOW)
        self.items, self.lengths, self.budget = (np.array(x, np.int64) for x in (self.item, self.length, self.edits))
        self.text = np.array(rows, np.uint32).reshape(-1, WINDOW)
        self.least = self.lengths - Q + 1 - Q * self.budget
        found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        places = np.concatenate(at) if at else np.zeros((0, 2), np.int64)
        order = np.argsort(found, kind="stable")
        self.hash, first = np.unique(found[order], return_index=True)
        self.start = np.r_[first, len(found)]
        self.segment, self.position = places[order].T
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hash >> np.uint64(64 - TABLE_BITS)] = True

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, first diagonal) of each band with hits enough, about HITS hits at a time; a band may come twice. `codes` has texts between zeros."""
        made = grams(codes)
        at = np.flatnonzero(self.table[made >> np.uint64(64 - TABLE_BITS)])
        slot = np.searchsorted(self.hash, made[at])
        slot[slot == len(self.hash)] = 0
        same = self.hash[slot] == made[at] if len(self.hash) else np.zeros(0, bool)
        at, slot = at[same], slot[same]
        times = self.start[slot + 1] - self.start[slot]
        ends, start = np.cumsum(times), 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, side="right")))
            # A band's hits are within so many characters, so of bands that begin before `stop` all hits are here.
            upto = int(np.searchsorted(at, at[stop - 1] + WINDOW + 2 * (EDITS + 1), side="right"))
            found = self._bands(len(codes), at[start:upto], slot[start:upto], times[start:upto])
            if len(found[0]):
                yield found
            start = stop

    def _bands(self, size: int, at: np.ndarray, slot: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(times)
        which = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times - self.start[slot], times)
        segment, diagonal = self.segment[which], np.repeat(at, times) - self.position[which] + WINDOW
        # Bands start every step diagonals and are twice as wide, so that any step + 1 neighbouring ones share a band.
        step = EDITS + 1
        size = (size + 2 * WINDOW) // step + 2
        band = diagonal // step
        key = np.concatenate([segment * size + band, segment * size + np.maximum(band - 1, 0)])
        key, n = np.unique(key, return_counts=True)
        key = key[n >= np.maximum(self.least[key // size], 1)]
        return key // size, key % size * step - WINDOW

    def verified(self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least errors of each segment against any stretch of its band, and where the best stretch ends.

        Row i of the alignment has columns i to i + width of the band, for all candidates at once.
        """
        if len(segment) > ALIGNED:
            parts = [self.verified(codes, segment[i : i + ALIGNED], diagonal[i : i + ALIGNED]) for i in range(0, len(segment), ALIGNED)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        width = 3 * (EDITS + 1) + EDITS
        low = diagonal - EDITS
        steps = np.arange(width + 1)
        cost = np.zeros((len(segment), width + 1), np.int32)
        best, end = np.full(len(segment), 1 << 20), np.zeros(len(segment), np.int64)
        for i in range(WINDOW):
            place = low[:, None] + i + steps[None, :]
            inside = (place >= 0) & (place < len(codes))
            letter = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], 0)
            # Items have no zeros, so to run from one text into another costs an error a character.
            match = cost + (letter != self.text[segment, i][:, None])
            drop = np.concatenate([cost[:, 1:], np.full((len(segment), 1), 1 << 20)], axis=1) + 1
            now = np.minimum(match, drop)
            cost = (np.minimum.accumulate(now - steps, axis=1) + steps).astype(np.int32)
            done = self.lengths[segment] == i + 1
            best[done], end[done] = cost[done].min(axis=1), low[done] + i + cost[done].argmin(axis=1) + 1
        return best, end


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull() & F.col(item).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1]) * (WINDOW // 2) // STRIDE
        if size > BLOCK_CHARS:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def regions(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each (text, segment) within the segment's errors: key, item_id, end (in the normalised text), errors.

    Whole texts, lower-cased and with runs of white space as one space. The benchmark is the stated set of queries: its
    index goes to the executors in blocks of bounded size, one pass over the texts each. Items of fewer than Q characters
    can't be told from chance and match nothing; null texts neither. Repeated rows give rows each. Equal items all match.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, item_id long, end long, errors long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in slices(batch, "text", STEP_BYTES):
                    texts = [normal(x.replace("\x00", " ")) for x in part.column(1).to_pylist()]
                    codes = _codes("\x00".join(["", *texts, ""]))
                    starts = np.flatnonzero(codes == 0) + 1
                    doc = np.cumsum(codes == 0) - 1
                    found = np.zeros((0, 4), np.int64)
                    for segment, diagonal in index.candidates(codes):
                        errors, end = index.verified(codes, segment, diagonal)
                        good = errors <= index.budget[segment]
                        segment, errors, end = segment[good], errors[good], end[good]
                        of = doc[end - 1]
                        # Neighbouring bands find the same stretch: one row for each text, item and end.
                        found = np.unique(np.concatenate([found, np.stack([of, index.items[segment], end - starts[of], errors], axis=1)]), axis=0)
                    if not len(found):
                        continue
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[:, 0])), *(pa.array(found[:, i]) for i in (1, 2, 3))], names=["key", "item_id", "end", "errors"])

        out = out.unionByName(rows.mapInArrow(released(run), schema))
    return out.withColumnRenamed("key", key)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with item_ids, the sorted distinct items that each text has a segment of. Columns of that name are replaced.

    Texts are marked where they are, so nothing is shuffled and repeated rows or null keys need no care; null texts have
    no items; long and repetitive ones are counted in parts. A benchmark of several blocks takes a pass each, with the table cut between.
    """
    docs = docs.drop("item_ids").withColumn("item_ids", F.array().cast("array<long>"))

    def run(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in slices(batch, text, STEP_BYTES):
                    texts = [normal((x or "").replace("\x00", " ")) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                    codes = _codes("\x00".join(["", *texts, ""]))
                    doc = np.cumsum(codes == 0) - 1
                    held = [set(x) for x in part.column(part.num_columns - 1).to_pylist()]
                    for segment, diagonal in index.candidates(codes):
                        errors, end = index.verified(codes, segment, diagonal)
                        good = errors <= index.budget[segment]
                        for i, x in zip(doc[end[good] - 1].tolist(), index.items[segment[good]].tolist()):
                            held[i].add(x)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([sorted(x) for x in held], pa.list_(pa.int64()))], names=part.schema.names)

        return one

    for i, block in enumerate(_blocks(benchmark, item, item_text)):
        docs = (cut(docs) if i else docs).mapInArrow(released(run(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs

"""Packing by Karmarkar-Karp multiway differencing.

Texts are tokenised, cut into full windows and one rest each, and the rests of a group of documents are dealt into
windows of near-equal length. Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import coded, kept, mixed, released, slices, words

WINDOW, END_ID = 4096, 2
#: Documents dealt together. A group's windows are within a few tokens of each other, so padding is about one window a group.
GROUP = 4000
#: Words, and pieces of words, that a worker keeps between slices, until it serves another step; and text bytes of a slice.
KEPT, STEP_BYTES = 500_000, 8 << 20
#: Characters that the tokenizer is given at a time.
CHARS = 1 << 14


class Encoder:
    """Ids by a `tokenizers` file that drops white space and ends each word with a suffix, as encode() of the whole text gives.

    Words between ASCII white space are independent, and so are the pieces that the file's own pattern finds in them, so
    each different piece is encoded once a batch and recent ones are kept. Pieces go to the tokenizer many at a time;
    where its words can't be told apart again, one at a time.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 << 16, bool)
        for token, i in spec["model"]["vocab"].items():
            self.last[i] = token.endswith(suffix)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pieces(self, word: str) -> tuple[str, ...] | list[str] | None:
        """What the file's pattern finds in the word; None if it has none, or a special token, or a character newer than Unicode 3.2.

        The pattern's classes are then the same whatever version of Unicode `regex` and the tokenizer know.
        """
        if not word.isascii() and max(word) > "\xff" and any(unicodedata.ucd_3_2_0.category(x) == "Cn" for x in word):
            return None
        # Letter by letter in lower case, so no final sigma.
        word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if word.isalpha():
            return (word,)
        return None if "<|" in word and any(x in word for x in self.special) else self.pattern.findall(word)

    def _learn(self, missing: list[str]) -> None:
        """`missing`: pieces, each one word of the tokenizer."""
        at = 0
        while at < len(missing):
            to, size = at, 0
            while to < len(missing) and size < CHARS:
                size += len(missing[to]) + 1
                to += 1
            some = missing[at:to]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint16)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for piece, end in zip(some, (2 * ends).tolist()):
                    self.pieces[piece] = raw[start:end]
                    start = end
            else:
                for piece, x in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                    self.pieces[piece] = np.array(x.ids, np.uint16).tobytes()
            at = to

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        counts, flat = words(texts, lower=False)
        codes, distinct = coded(flat)
        for held in (self.words, self.pieces):
            if len(held) > KEPT:
                held.clear()
        # to_pylist() makes a scalar of each value first, which takes several times as long.
        named = distinct.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.words.get, named))
        missing = [i for i, x in enumerate(raw) if x is None]
        # A word of ASCII letters is one piece.
        spelled = [w.lower() if (w := named[i]).isalpha() and w.isascii() else self._pieces(w) for i in missing]
        need: dict[str, None] = {}
        for x in spelled:
            if type(x) is str:
                need[x] = None
            elif x:
                need.update(dict.fromkeys(x))
        self._learn([x for x in need if x not in self.pieces])
        get = self.pieces.__getitem__
        for i, x in zip(missing, spelled):
            if type(x) is str:
                ids = get(x)
            elif x:
                ids = get(x[0]) if len(x) == 1 else b"".join(map(get, x))
            else:
                ids = np.array(self.tokenizer.encode(named[i], add_special_tokens=False).ids, np.uint16).tobytes()
            raw[i] = self.words[named[i]] = ids
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        store, start = np.frombuffer(b"".join(raw), np.uint16), np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        # A slice has few enough ids for 32 bits, and no need of as much memory again for each step.
        at = np.repeat((start[codes] - ends + each).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        ids = store[at]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return ids, np.diff(upto)


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def deal(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of `sizes` in `windows` parts of near-equal sum.

    Each partial partition is its parts' sums in falling order; the two with the widest spread merge again and again, the
    largest part of one with the least of the other. Parts without members aren't stored.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    made = n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)] if windows > 1 else [(0, 0, np.array([sum(sizes)]), np.array([0]))]
    if windows == 1:
        return [list(range(n))]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both > 0:
            joined = np.arange(made, made + both)
            left[joined], right[joined] = x[len(x) - both :], y[len(y) - both :][::-1]
            made += both
            sums = np.concatenate([a[: len(a) - both], b[: len(b) - both], a[len(a) - both :] + b[len(b) - both :][::-1]])
            nodes = np.concatenate([x[: len(x) - both], y[: len(y) - both], joined])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == windows else 0)), tie, sums, nodes))
        tie += 1
    parts = []
    for root in heap[0][3].tolist():
        found, todo = [], [root]
        while todo:
            at = todo.pop()
            if at < n:
                found.append(at)
            else:
                todo += [int(left[at]), int(right[at])]
        parts.append(sorted(found))
    return parts


def fill(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Parts of at most `window`; their number rises from the least possible until none is over."""
    windows = max(1, -(-sum(sizes) // window))
    while True:
        parts = deal(sizes, windows)
        if max(sum(sizes[i] for i in p) for p in parts) <= window:
            return parts
        windows = min(len(sizes), windows + max(1, windows // 256))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's ids, then `end_id`, are cut into full windows and a rest. Rows are dealt into groups of about `group`,
    evenly and whatever their values; a full window is a sequence of its own, and the rests of a group share as few
    windows as Karmarkar-Karp differencing fits them in. Groups are bounded, so no task holds more than one of them.

    A null or empty text has one id. Repeated rows and null keys are packed each. No rows give no rows. `tokenizer` is a
    path that all executors can read.
    """
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        context = TaskContext.get()
        seen = 0
        for batch in batches:
            for part in slices(batch, text, STEP_BYTES):
                ids, sizes = encode(part.column(1))
                ends = np.cumsum(sizes)
                out: list[list] = [[], [], [], [], [], []]
                for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    own = np.append(ids[end - size : end], np.uint16(0)).astype("<u4")
                    own[-1] = end_id
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        for column, x in zip(out, (i, start, len(piece), zlib.crc32(piece), len(own))):
                            column.append(x)
                of = np.array(out[0], np.int64)
                place = mixed(np.uint64(context.partitionId()) * np.uint64(1 << 40) + np.arange(seen, seen + len(sizes), dtype=np.uint64)) % np.uint64(groups)
                seen += len(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in out[1:5]), pa.array(place.astype(np.int64)[of])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "g"])

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        length = pdf["length"].to_numpy()
        full = int((length == window).sum())
        number, offset = np.arange(len(pdf), dtype=np.int64), np.zeros(len(pdf), np.int64)
        if full < len(pdf):
            for w, part in enumerate(fill(length[full:].tolist(), window)):
                part = np.array(part) + full
                number[part] = full + w
                offset[part] = np.cumsum(length[part]) - length[part]
        return pdf.assign(sequence_id=(np.int64(pdf["g"].iloc[0]) << 32) + number, offset=offset).drop(columns="g")

    base = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(released(cut, ("encoder", tokenizer)), base + ", g long").groupBy("g").applyInPandas(arrange, base + ", sequence_id long, offset long")

"""LM scoring with a sharded Elias-Fano n-gram trie.

The model interpolates from the words upwards: with c the count of a context, t its distinct followers,
P(w | h) = c(h w) / (c(h) + t(h)) + t(h) / (c(h) + t(h)) * P(w | h without its first word), and
P(w) = (c(w) + 1) / (N + V + 1). Both factors are quantised to a byte on a logarithmic scale.

Slices of texts count their distinct n-grams and send them, once each, to the shard of their context. A shard builds its
part of the trie from the training counts (levels of contexts and of followers, each a monotone sequence in Elias-Fano
form, in a memory-mapped file) and answers all slices by successor search among the followers of a context. Answers go
back to the slices, which sum up their texts. Nothing is collected but hot contexts, whose number is bounded.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, give_back, hashes, mixed, released, slices, stored, words

#: Words of the longest n-gram.
ORDER = 2
#: Text bytes of a slice, and slices a shard.
SLICE, PER_SHARD = 8 << 20, 2
#: A context with this share of a slice's n-grams may be hot; its followers are then dealt over all shards.
HOT_SHARE = 1 / 256
#: Quantised factors: 0 is 0, 255 is 1, and steps between are equal in the logarithm, down to 2^-30.
LEAST = -30.0
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def quantised(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        level = np.rint(1 + (np.log2(x) - LEAST) * (254 / -LEAST))
    return np.where(x > 0, np.clip(level, 1, 255), 0).astype(np.uint8)


#: What each byte stands for.
FACTORS = np.r_[0.0, 2.0 ** (LEAST + (np.arange(1, 256) - 1) * (-LEAST / 254))]


class EliasFano:
    """A rising sequence of n values below `universe`: low bits packed, high bits as unary gaps, in one memory-mapped file.

    successor() finds where the first value not under a key stands: the key's high bits name a run of ones between two
    zeros, found by a directory of zeros; within the run, low bits are compared.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low = n, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        size = n + (universe >> self.low) + 2
        bits = np.zeros(-(-size // 64) * 64 + 64, bool)
        bits[high + np.arange(n)] = True
        lows = np.zeros((n * self.low + 63) // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(self.low)
        part = values & np.uint64((1 << self.low) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(lows, word, part << shift)
        over = shift + np.uint64(self.low) > 64
        np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        packed = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.cumsum(64 - np.bitwise_count(packed).astype(np.int64))
        self.zeros = (zeros - zeros[0] if not len(zeros) else np.r_[0, zeros[:-1]]).astype(np.uint32)
        self.file = tempfile.TemporaryFile()
        self.file.write(packed.tobytes() + lows.tobytes())
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.bits = np.frombuffer(self.map, np.uint64, len(packed))
        self.lows = np.frombuffer(self.map, np.uint64, len(lows), len(packed) * 8)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # A shift by 64 is undefined, so the next word is shifted twice.
        value = (self.lows[word] >> shift) | ((self.lows[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return value & np.uint64((1 << self.low) - 1)

    def _zero(self, which: np.ndarray) -> np.ndarray:
        """Place of each numbered zero bit."""
        word = np.searchsorted(self.zeros, which, side="right") - 1
        left = (which - self.zeros[word]).astype(np.uint64)
        value, place = ~self.bits[word], np.zeros(len(which), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            lower = value & np.uint64((1 << width) - 1)
            count = np.bitwise_count(lower).astype(np.uint64)
            up = left >= count
            left, place = np.where(up, left - count, left), np.where(up, place + np.uint64(width), place)
            value = np.where(up, value >> np.uint64(width), lower)
        return word * 64 + place.astype(np.int64)

    def successor(self, keys: np.ndarray) -> np.ndarray:
        if not self.n or not len(keys):
            return np.zeros(len(keys), np.int64)
        keys = keys.astype(np.uint64)
        high, low = (keys >> np.uint64(self.low)).astype(np.int64), keys & np.uint64((1 << self.low) - 1)
        # Ones before the run: its start among the bits less the zeros before it.
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0) - high
        end = self._zero(high) - high
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                return start
            middle = (start[open_] + end[open_]) // 2
            under = self._low(middle) < low[open_]
            start[open_[under]] = middle[under] + 1
            end[open_[~under]] = middle[~under]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        at = self.successor(keys)
        return np.where(self.get(np.minimum(at, max(self.n - 1, 0))) == keys.astype(np.uint64), at, -1) if self.n else np.full(len(keys), -1)

    @cached_property
    def _ones(self) -> np.ndarray:
        return np.r_[0, np.cumsum(np.bitwise_count(self.bits).astype(np.int64))][:-1].astype(np.uint32)

    def get(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self._ones, at, side="right") - 1
        left = (at - self._ones[word]).astype(np.uint64)
        value, place = self.bits[word], np.zeros(len(at), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            lower = value & np.uint64((1 << width) - 1)
            count = np.bitwise_count(lower).astype(np.uint64)
            up = left >= count
            left, place = np.where(up, left - count, left), np.where(up, place + np.uint64(width), place)
            value = np.where(up, value >> np.uint64(width), lower)
        high = word.astype(np.uint64) * np.uint64(64) + place - at.astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(at)


class Trie:
    """A level of contexts over a level of followers, from counts summed over n-grams.

    A follower is stored as its rank among the shard's follower hashes, offset by its context's rank times their number,
    so the whole level is one rising sequence, and pointers to the first follower of each context are another.
    """

    def __init__(self, context: np.ndarray, follower: np.ndarray, count: np.ndarray):
        order = np.lexsort((follower, context))
        context, follower, count = context[order], follower[order], count[order]
        new = np.r_[True, (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])] if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.add.reduceat(count, at) if len(at) else count
        context, follower = context[at], follower[at]
        names, first = np.unique(context, return_index=True)
        self.total = np.add.reduceat(count, first) if len(first) else count
        self.contexts = EliasFano(names, 1 << 64)
        self.pointers = EliasFano(np.r_[first, len(at)], len(at) + 1)
        self.ranks, rank = np.unique(follower, return_inverse=True)
        self.size = max(1, len(self.ranks))
        owner = np.repeat(np.arange(len(names)), np.diff(np.r_[first, len(at)]))
        self.followers = EliasFano(owner * self.size + rank, max(1, len(names)) * self.size)
        self.counts = count

    def spread(self) -> np.ndarray:
        """Distinct followers of each context."""
        return np.diff(self.pointers.get(np.arange(self.pointers.n)).astype(np.int64))

    def find(self, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and n-gram, -1 for those not there. A follower is sought only after its context."""
        names, back = np.unique(context, return_inverse=True)
        of = self.contexts.find(names)[back]
        rank = np.searchsorted(self.ranks, follower)
        known = (of >= 0) & (rank < len(self.ranks))
        known[known] = self.ranks[rank[known]] == follower[known]
        place = np.full(len(of), -1)
        place[known] = self.followers.find(of[known] * self.size + rank[known])
        return of, place


def _events(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens a text, and for all tokens in turn their hashes and those of their contexts of 1 to order - 1 words."""
    counts, flat = words(texts)
    codes, distinct = coded(flat)
    named = hashes(distinct)
    del flat, distinct
    pa.default_memory_pool().release_unused()
    ends = np.cumsum(counts + 1) - 1
    token = np.empty(int(counts.sum()) + len(counts), np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = named[codes] if len(codes) else 0, END
    place = np.arange(len(token)) - np.repeat(np.r_[0, ends[:-1] + 1], counts + 1)
    contexts, rolled = [], np.zeros(len(token), np.uint64)
    for k in range(1, order):
        back = np.r_[np.full(min(k, len(token)), START), token[: max(0, len(token) - k)]]
        rolled = mixed(rolled * np.uint64(3) + np.where(place >= k, back, START) + np.uint64(k))
        contexts.append(rolled)
    return counts + 1, token, contexts


def _distinct(context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct pairs, by context, and each pair's number."""
    _, first, back = np.unique(mixed(context) + follower * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
    order = np.lexsort((follower[first], context[first]))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return first[order], rank[back]


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`."""
    return F.crc32(key.cast("string").cast("binary")) % by


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """A row for each text: key, train, n_tokens, n_known, train_tokens, train_types, base_score and score.

    Tokens are lower-cased (A-Z) words and one end a text. The model learns from rows where `train` holds (null: not).
    `score` is the log10 probability of the text under the interpolated model, `base_score` under P(w) alone.

    A null or empty text is one end. Rows that repeat are counted and scored each, whatever their keys. No rows give
    none; without a training row, N and V are 0. Words and contexts are told apart by 64-bit hashes,
    followers of a context by the upper 32 bits of theirs: of a million distinct ones after one context, about 116 pairs
    share their counts in `score`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    result = f"{key} {kind}, train boolean, n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double"
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if not total["n"]:
        return spark.createDataFrame([], result)
    shards = max(8, -(-total["b"] // (SLICE * PER_SHARD)))
    # About a slice's rows at a time, but no more than Spark's own number.
    at_once = min(10_000, max(1, int(0.95 * SLICE * total["n"] / max(1, total["b"]))))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, _, contexts = _events(part.column(2), order)
                for k, context in enumerate(contexts):
                    found, n = np.unique(context, return_counts=True)
                    often = n >= max(64, HOT_SHARE * len(context))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), k + 2)), pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["level", "c", "n"])

    # At most 1 / HOT_SHARE contexts a level can have that share of all n-grams; the commonest are kept.
    hot: dict[int, np.ndarray] = {}
    often = stored(rows.mapInArrow(released(heavy), "level long, c long, n long"), at_once)
    for k in range(2, order + 1):
        some = often.where(F.col("level") == k).groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(round(1 / HOT_SHARE)).collect()
        hot[k] = np.sort(np.array([r["c"] for r in some], np.int64).view(np.uint64))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield number, part
                number += 1

    def levels(part: pa.RecordBatch) -> Iterator[tuple]:
        """Level, tokens a text, the distinct n-grams (context, follower) by shard, bounds of shards, and the number of each token's n-gram."""
        sizes, token, contexts = _events(part.column(2), order)
        for level, context in enumerate([None, *contexts], 1):
            # Words are level 1: each its own context, so that they are dealt over all shards.
            head = token if context is None else context
            first, number = _distinct(head, token)
            c, f = head[first], token[first]
            place = mixed(c)
            if level > 1 and len(hot[level]):
                place = np.where(np.isin(c, hot[level]), mixed(c + f * np.uint64(0x9E3779B97F4A7C15)), place)
            place = (place % np.uint64(shards)).astype(np.int64)
            by = np.argsort(place, kind="stable")
            back = np.empty(len(by), np.uint32)
            back[by] = np.arange(len(by), dtype=np.uint32)
            yield level, sizes, c[by], f[by], np.searchsorted(place[by], np.arange(shards + 1)), back[number]

    texts = f"keys array<{kind}>, train array<boolean>, lengths array<long>, chain array<binary>"
    sent = f"level int, shard long, slice long, context binary, sizes binary, follower binary, count binary, {texts}"
    names = [x.split()[0] for x in sent.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's n-grams for each shard, and at level 0 what its sums need: each token's longest n-gram, and each n-gram's next shorter one."""
        for name, part in sliced(batches):
            give_back()
            learned = part.column(1).to_numpy(zero_copy_only=False)
            numbers = []
            for level, sizes, c, f, bounds, number in levels(part):
                numbers.append(number)
                count = np.bincount(number, weights=np.repeat(learned, sizes), minlength=len(c)).astype(np.uint32)
                out: list[list] = [[] for _ in range(7)]
                for shard in range(shards):
                    a, b = bounds[shard], bounds[shard + 1]
                    if a == b:
                        continue
                    heads = np.flatnonzero(np.r_[True, c[a + 1 : b] != c[a : b - 1]])
                    follower = b"" if level == 1 else (f[a:b] >> np.uint64(32)).astype(np.uint32).tobytes()
                    for column, x in zip(out, (level, shard, name, c[a:b][heads].tobytes(), _squeezed(np.diff(np.r_[heads, b - a]).astype(np.uint16 if b - a < 1 << 16 else np.uint32)), follower, _squeezed(count[a:b].astype(np.uint8 if count[a:b].max() < 256 else np.uint32)))):
                        column.append(x)
                none = [pa.nulls(len(out[0]), t) for t in (pa.list_(part.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:3]), *(pa.array(x, pa.binary()) for x in out[3:]), *none], names=names)
            chain = [_packed(numbers[-1])]
            for longer, shorter in zip(numbers[:0:-1], numbers[-2::-1]):
                of = np.zeros(int(longer.max()) + 1, np.int64)
                of[longer] = shorter
                chain.append(_packed(of))
            own = [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([part.column(1).to_pylist()], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([chain], pa.list_(pa.binary()))]
            place = int(mixed(np.array([name], np.uint64))[0] % np.uint64(shards))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([place], pa.int64()), pa.array([name], pa.int64()), *(pa.array([b""], pa.binary()) for _ in range(4)), *own], names=names)

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = np.frombuffer(row.context, np.uint64)
        sizes, count = _loosened(row.sizes), _loosened(row.count)
        sizes = np.frombuffer(sizes, np.uint16 if len(sizes) == 2 * len(heads) else np.uint32)
        c = np.repeat(heads, sizes)
        f = np.frombuffer(row.follower, np.uint32) if row.level > 1 else np.zeros(len(c), np.uint32)
        return c, f, np.frombuffer(count, np.uint8 if len(count) == len(c) else np.uint32).astype(np.int64)

    answered = f"level int, shard long, slice long, first binary, second binary, third binary, tokens long, types long, {texts}"

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """For words their counts; for longer n-grams both factors. A row without slice has totals, or those of hot contexts."""
        level, shard = int(pdf["level"].iloc[0]), int(pdf["shard"].iloc[0])
        if level == 0:
            return pdf.assign(first=b"", second=b"", third=b"", tokens=0, types=0)[[x.split()[0] for x in answered.split(", ")]]
        asked = [unpack(r) for r in pdf.itertuples()]
        learnt = [(c[n > 0], f[n > 0], n[n > 0]) for c, f, n in asked]
        trie = Trie(*(np.concatenate([x[i] for x in learnt]) for i in range(3)))
        # A last entry serves what isn't there: place -1 reads it.
        total = np.r_[trie.total, 0]
        if level == 1:
            out = [(level, shard, -1, b"", b"", b"", int(total.sum()), len(trie.total))]
            out += [(level, shard, r.slice, _squeezed(total[trie.contexts.find(c)].astype(np.uint32)), b"", b"", 0, 0) for r, (c, _, _) in zip(pdf.itertuples(), asked)]
        else:
            spread, counts, warm = np.r_[trie.spread(), 1], np.r_[trie.counts, 0], hot[level]
            names = trie.contexts.get(np.arange(trie.contexts.n))
            own = np.isin(names, warm)
            out = [(level, shard, -1, names[own].tobytes(), np.stack([total[:-1][own], spread[:-1][own]]).astype(np.int64).tobytes(), b"", 0, 0)]
            for r, (c, f, _) in zip(pdf.itertuples(), asked):
                of, at = trie.find(c, f)
                scale = (total + spread)[of]
                # Followers of hot contexts are dealt over shards, so for them the count itself goes back.
                far = np.flatnonzero(np.isin(c, warm))
                held = np.searchsorted(warm, c[far]).astype(np.uint16).tobytes() + counts[at][far].astype(np.uint32).tobytes() + far.astype(np.uint32).tobytes()
                out.append((level, shard, r.slice, _squeezed(quantised(counts[at] / scale)), _squeezed(quantised(spread[of] / scale)), held, 0, 0))
        return pd.DataFrame(out, columns=["level", "shard", "slice", "first", "second", "third", "tokens", "types"]).assign(keys=None, train=None, lengths=None, chain=None)

    answers = stored(rows.mapInArrow(released(ask), sent).groupBy("level", "shard").applyInPandas(_then_give_back(answer), answered), at_once)
    known = answers.where("level = 1 and slice = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_all, types = int(known[0]), int(known[1])
    sums = {k: np.zeros((2, len(v)), np.int64) for k, v in hot.items()}
    for r in answers.where("level > 1 and slice = -1 and octet_length(first) > 0").select("level", "first", "second").toLocalIterator():
        sums[r["level"]][:, np.searchsorted(hot[r["level"]], np.frombuffer(r["first"], np.uint64))] += np.frombuffer(r["second"], np.int64).reshape(2, -1)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["level", "shard"])
        head, rest = pdf.iloc[0], pdf.iloc[1:]
        sizes, chain = np.array(head["lengths"], np.int64), [_unpacked(x) for x in head["chain"]]
        count = np.frombuffer(b"".join(map(_loosened, rest.loc[rest["level"] == 1, "first"])), np.uint32).astype(np.int64)
        base = np.log10((count + 1) / (n_all + types + 1))
        p = (count + 1) / (n_all + types + 1)
        for k in range(2, order + 1):
            own = rest[rest["level"] == k]
            firsts = [_loosened(x) for x in own["first"]]
            share, back = (FACTORS[np.frombuffer(b"".join(x), np.uint8)] for x in (firsts, map(_loosened, own["second"])))
            lower = p[chain[order + 1 - k]]
            p = share + back * lower
            start = 0
            for first, third in zip(firsts, own["third"]):
                n = len(third) // 10
                which, seen, at = np.frombuffer(third, np.uint16, n), np.frombuffer(third, np.uint32, n, 2 * n), np.frombuffer(third, np.uint32, n, 6 * n) + start
                total, spread = sums[k][:, which]
                none = total == 0
                p[at] = np.where(none, lower[at], (seen + spread * lower[at]) / np.maximum(total + spread, 1))
                start += len(first)
        word = chain[0]
        for of in chain[1:]:
            word = of[word]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  a text has one token or more
        return pd.DataFrame({key: head["keys"], "train": head["train"], "n_tokens": sizes, "n_known": add((count[word] > 0).astype(np.int64)), "train_tokens": n_all, "train_types": types, "base_score": add(base[word]), "score": add(np.log10(p)[chain[0]])})

    return answers.where("slice >= 0").groupBy("slice").applyInPandas(_then_give_back(add_up), result)


def _then_give_back(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """`run` for applyInPandas; memory that a group has taken goes back before the next one comes."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf)
        finally:
            give_back()

    return step


def _squeezed(x: np.ndarray) -> bytes:
    """How many bytes, then the numbers' bytes by place, in less room: neighbours are often equal, and upper places have few values."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return bytes([x.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(raw: bytes) -> bytes:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    return np.frombuffer(pa.decompress(raw[9:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8).reshape(size, -1).T.tobytes()


def _packed(x: np.ndarray) -> bytes:
    """How many numbers, then their bytes by place: the upper ones have few values, so that they take little room."""
    return len(x).to_bytes(8, "little") + pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    places = np.frombuffer(pa.decompress(raw[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(places.T).view("<u4").ravel().astype(np.int64)

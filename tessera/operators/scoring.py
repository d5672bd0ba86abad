"""BM25 over columns of tokens. Corpus numbers come from one aggregation a field and set of terms; they are literals of the plan."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def norm(length: Column) -> Column:
    """A length as one byte keeps it: exact below 24, then 24 plus what four leading bits keep of the rest."""
    rest = F.greatest(length.cast("long") - 24, F.lit(0))
    drop = F.greatest(F.length(F.bin(rest)) - 4, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", rest, drop), drop)
    return F.when(length < 24, length.cast("long")).otherwise(kept + 24)


class Stats:
    """Of one view: texts with a field, their mean length, and texts with each term. Cached a request."""

    def __init__(self, view: DataFrame):
        self.view = view
        self.fields: dict[str, tuple[int, float]] = {}
        self.terms: dict[tuple[str, str], int] = {}
        self.vocabularies: dict[str, DataFrame] = {}

    def learn(self, column: str, terms: Iterable[str]) -> None:
        """Document frequencies of `terms` and the field's totals, in one pass over the tokens alone."""
        need = sorted({t for t in terms if (column, t) not in self.terms})
        if not need and column in self.fields:
            return
        own = F.transform(F.col(column), lambda x: x.t)
        counts = [F.count_if(F.array_contains(own, t)).alias(f"d{i}") for i, t in enumerate(need)]
        row = self.view.select(column).agg(F.count(column).alias("n"), F.coalesce(F.avg(F.size(column)), F.lit(0.0)).alias("l"), *counts).first()
        self.fields[column] = (row["n"], row["l"])
        self.terms |= {(column, t): row[f"d{i}"] for i, t in enumerate(need)}

    def vocabulary(self, column: str) -> DataFrame:
        """(t, df) of all terms of a field."""
        if column not in self.vocabularies:
            self.vocabularies[column] = self.view.select(F.explode(F.array_distinct(F.transform(column, lambda x: x.t))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        return self.vocabularies[column]

    def idf(self, column: str, df: int) -> float:
        n = self.fields[column][0]
        return math.log1p((n - df + 0.5) / (df + 0.5))


class Unforeseen(Exception):
    """What a rehearsal can't go on with."""


class Rehearsal(Stats):
    """Takes down what is asked of a column's Stats, and reads nothing."""

    def learn(self, column: str, terms: Iterable[str]) -> None:
        for t in terms:
            self.terms[column, t] = 0
        self.fields[column] = (0, 0.0)

    def vocabulary(self, column: str) -> DataFrame:
        raise Unforeseen


def saturated(tf: Column, length: Column, average: float, weight: Column | float, norms: bool = True, exact: bool = False) -> Column:
    """w - w / (1 + tf * inv): nothing of a term not there, w for endlessly many."""
    scale = (1 - B) + B * (length if exact else norm(length)).cast("double") / (average or 1.0) if norms else F.lit(1.0)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w - w / (1 + tf.cast("double") / (K1 * scale))


def tf(column: str, term: str) -> Column:
    return F.size(F.filter(F.col(column), lambda x: x.t == term))


def phrase_freq(column: str, terms: Sequence[tuple[str, int]]) -> Column:
    """Places where all terms stand at their distances from the first: each term's places, moved to the first's, in common."""
    first, at = terms[0]
    if len(terms) == 1:
        return tf(column, first)

    return F.size(reduce(F.array_intersect, [_starts(column, t, q - at) for t, q in terms]))


def _starts(column: str, term: str, ahead: int) -> Column:
    return F.transform(_of(column, term), lambda x: x.p - F.lit(ahead))


def _of(column: str, term: str) -> Column:
    return F.filter(F.col(column), lambda x: x.t == term)


def sloppy_freq(column: str, terms: Sequence[tuple[str, int]], slop: int) -> Column:
    """Sum of 1 / (1 + spread) over matches: from each adjusted place on, the least spread that has every term.

    Python gets the places of the terms only, not the texts' tokens.
    """
    offsets = [q for _, q in terms]

    def one(places: list[list[int]]) -> float:
        if not all(places):
            return 0.0
        places = [sorted(p) for p in places]
        at, total = [0] * len(places), 0.0
        while True:
            now = [p[i] for p, i in zip(places, at)]
            spread = max(now) - min(now)
            if spread <= slop and len({v + q for v, q in zip(now, offsets)}) == len(now):
                total += 1 / (1 + spread)
            i = now.index(min(now))
            at[i] += 1
            if at[i] == len(places[i]):
                return total

    @F.arrow_udf("double")
    def run(found: pa.Array) -> pa.Array:
        return pa.array((None if not x.is_valid else one(x.as_py()) for x in found), pa.float64())

    places = F.array(*(_starts(column, t, q) for t, q in terms))
    return run(F.when(F.col(column).isNotNull(), places))

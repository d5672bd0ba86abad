"""Value expressions: text such as `log1p(popularity_i) * score` becomes a Column, or with aggregates, an aggregate Column.

A missing operand makes a value missing (null); division by zero too; a math domain error or an overflow fails the query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import RequestError
from . import dates

EARTH_M = 6371008.7714
_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(\$?[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(\|\||&&|>>>|<<|>>|<=|>=|==|!=|[-+*/%!~&|^<>()?:,=]))")
#: Binary operators by rising precedence.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
NAMED = {"||": "or", "&&": "and", "|": "bit_or", "^": "bit_xor", "&": "bit_and", "==": "eq", "!=": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte", "<<": "shl", ">>": "shr", ">>>": "ushr", "+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod"}


@dataclass
class Names:
    """What names stand for: `column` gives a field's Column (an array for many values), `vars` the request's values."""

    column: Callable[[str], Column]
    vars: Mapping[str, Any] = field(default_factory=dict)
    score: Column | None = None
    kind: Callable[[str], str] = lambda name: ""


def _d(c: Column) -> Column:
    return c.cast("double")


def _long(c: Column) -> Column:
    return c.cast("long")


def _both(a: Column, b: Column, c: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), c)


def _compare(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: _long(test(a, b))


def _domain(name: str, c: Column, good: Column, value: Column) -> Column:
    return F.when(good, value).when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: not defined for "), c.cast("string"))).cast("double"))


def _checked(fn: Callable[[Column], Column], name: str, good: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: _domain(name, _d(x), good(_d(x)), fn(_d(x)))


def _and(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), None).when(a == 0, F.lit(0)).otherwise(_long(b != 0)).cast("long")


def _or(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), None).when(a != 0, F.lit(1)).otherwise(_long(b != 0)).cast("long")


def _sum(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(F.transform(xs, _d), F.lit(0.0), lambda a, x: a + x))


def instant(c: Column) -> Column:
    """A date column's epoch milliseconds, whatever its type."""
    return F.unix_millis(c.cast("timestamp"))


def _at(ms: Column, offset: Column | None) -> Column:
    return F.timestamp_millis(_long(ms if offset is None else ms + offset * 60000))


def _part(fn: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda ms, offset=None: _long(fn(_at(ms, offset)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.sqrt(a), F.lit(1.0))) * (2 * EARTH_M)


def _bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def _plane(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy = F.radians(lat2 - lat1)
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy) * EARTH_M


def _shift(name: str) -> Callable[[Column, Column], Column]:
    return lambda a, n: F.call_function(name, _long(a), n.bitwiseAND(63).cast("int"))


def _decay(shape: Callable[[Column, Column, Column], Column]) -> Callable[..., Column]:
    def made(x: Column, origin: Column, scale: Column, offset: Column = None, decay: Column = None) -> Column:
        offset, decay = F.lit(0.0) if offset is None else offset, F.lit(0.5) if decay is None else decay
        return F.coalesce(shape(F.greatest(F.abs(_d(x) - origin) - offset, F.lit(0.0)), _d(scale), _d(decay)), F.lit(1.0))

    return made


def _geotile(lat: Column, lon: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    r = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    top = _long(n - 1)
    x = F.greatest(F.least(_long(F.floor((lon + 180) / 360 * n)), top), F.lit(0))
    y = F.greatest(F.least(_long(F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * n)), top), F.lit(0))
    return F.shiftleft(_long(zoom), 58).bitwiseOR(F.shiftleft(x, 29)).bitwiseOR(y)


def _geohash(lat: Column, lon: Column, chars: Column) -> Column:
    """The cell's bits, longitude first, as one number: five a character."""
    bits = chars * 5
    x = _long(F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), F.ceil(bits / 2))))
    y = _long(F.floor((lat + 90) / 180 * F.pow(F.lit(2.0), F.floor(bits / 2))))
    low_x = (bits % 2).cast("int")
    spread = lambda v, at: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", v, i.cast("int")).bitwiseAND(1), (i * 2 + at).cast("int"))))
    return spread(x, F.when(low_x == 1, 0).otherwise(1)).bitwiseOR(spread(y, F.when(low_x == 1, 1).otherwise(0)))


def _hash(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    def made(c: Column) -> Column:
        @F.pandas_udf("long")
        def run(x: pd.Series) -> pd.Series:
            held = x.notna().to_numpy()
            out = fn(x.fillna(0).astype("int64").to_numpy().view(np.uint64)).view(np.int64)
            return pd.Series(out, dtype="Int64").where(pd.Series(held))

        return run(_long(c))

    return made


#: Fixed values of XXH64 and MurmurHash64A.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_M = np.uint64(0xC6A4A7935BD1E995)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each number's eight little-endian bytes."""
    h = np.uint64(seed) + _P5 + np.uint64(8) if seed == 0 else np.uint64((seed + int(_P5) + 8) % (1 << 64))
    h = h ^ (_rotl(x * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def murmur64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    k = x * _M
    k = (k ^ (k >> np.uint64(47))) * _M
    h = (np.uint64(seed ^ (8 * int(_M)) % (1 << 64)) ^ k) * _M
    h = (h ^ (h >> np.uint64(47))) * _M
    return h ^ (h >> np.uint64(47))


def _combine(a: Column, b: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        held = (x.notna() & y.notna()).to_numpy()
        u, v = (s.fillna(0).astype("int64").to_numpy().view(np.uint64) for s in (x, y))
        out = (u ^ (v + np.uint64(0x9E3779B97F4A7C15) + (u << np.uint64(6)) + (u >> np.uint64(2)))).view(np.int64)
        return pd.Series(out, dtype="Int64").where(pd.Series(held))

    return run(_long(a), _long(b))


def _bucket(x: Column, n: Column, seed: Column = None) -> Column:
    @F.pandas_udf("long")
    def run(v: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        held = v.notna().to_numpy()
        raw = v.fillna(0).astype("int64").to_numpy().view(np.uint64)
        out = np.zeros(len(raw), np.uint64)
        for one in s.unique():
            at = (s == one).to_numpy()
            out[at] = xxh64(raw[at], int(one))
        return pd.Series((out % m.astype("int64").to_numpy().view(np.uint64)).view(np.int64), dtype="Int64").where(pd.Series(held))

    return run(_long(x), _long(n), _long(F.lit(0) if seed is None else seed))


def _seeded(seed: Column, key: Column) -> Column:
    mixed = F.call_function("xxhash64", _long(seed), _long(key))
    return _d(F.shiftrightunsigned(mixed, 40)) / float(1 << 24)


_TRIG = {n: (lambda f: lambda x: f(_d(x)))(getattr(F, n)) for n in "sin cos tan atan sinh cosh tanh asinh exp expm1 cbrt rint".split()}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **_TRIG,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(_d(a), _d(b)),
    "mod": lambda a, b: F.try_mod(a, b),
    "neg": lambda a: -a,
    "abs": F.abs,
    "def": lambda a, b: F.coalesce(a, b),
    "lt": _compare(lambda a, b: a < b),
    "lte": _compare(lambda a, b: a <= b),
    "gt": _compare(lambda a, b: a > b),
    "gte": _compare(lambda a, b: a >= b),
    "eq": _compare(lambda a, b: a == b),
    "ne": _compare(lambda a, b: a != b),
    "and": _and,
    "or": _or,
    "not": lambda a: _long(a == 0),
    "if": lambda c, a, b: F.when(c.isNull(), None).when(c != 0, a).otherwise(b),
    "asin": _checked(F.asin, "asin", lambda x: x.between(-1, 1)),
    "acos": _checked(F.acos, "acos", lambda x: x.between(-1, 1)),
    "acosh": _checked(F.acosh, "acosh", lambda x: x >= 1),
    "atanh": _checked(F.atanh, "atanh", lambda x: (x > -1) & (x < 1)),
    "atan2": lambda a, b: F.atan2(_d(a), _d(b)),
    "log": _checked(F.ln, "log", lambda x: x > 0),
    "ln": _checked(F.ln, "ln", lambda x: x > 0),
    "log2": _checked(F.log2, "log2", lambda x: x > 0),
    "log10": _checked(F.log10, "log10", lambda x: x > 0),
    "log1p": _checked(F.log1p, "log1p", lambda x: x > -1),
    "logn": lambda base, x: F.try_divide(_domain("logn", _d(x), x > 0, F.ln(_d(x))), F.ln(_d(base))),
    "sqrt": _checked(F.sqrt, "sqrt", lambda x: x >= 0),
    "pow": lambda a, b: F.pow(_d(a), _d(b)),
    "hypot": lambda a, b: F.hypot(_d(a), _d(b)),
    "floor": lambda x: _d(F.floor(_d(x))),
    "ceil": lambda x: _d(F.ceil(_d(x))),
    "trunc": lambda x: _d(F.when(x < 0, F.ceil(_d(x))).otherwise(F.floor(_d(x)))),
    "round": lambda x: _d(F.floor(_d(x) + 0.5)),
    "signum": lambda x: F.signum(_d(x)),
    "to_radians": lambda x: F.radians(_d(x)),
    "to_degrees": lambda x: F.degrees(_d(x)),
    "pi": F.pi,
    "e": F.e,
    "clamp": lambda x, a, b: _both(x, x, F.greatest(F.least(x, b), a)),
    "to_int": lambda x: _long(x),
    "to_double": _d,
    "bit_and": lambda a, b: _long(a).bitwiseAND(_long(b)),
    "bit_or": lambda a, b: _long(a).bitwiseOR(_long(b)),
    "bit_xor": lambda a, b: _long(a).bitwiseXOR(_long(b)),
    "bit_not": lambda a: F.bitwise_not(_long(a)),
    "shl": _shift("shiftleft"),
    "shr": _shift("shiftright"),
    "ushr": _shift("shiftrightunsigned"),
    "year": _part(F.year),
    "month": _part(F.month),
    "day_of_month": _part(F.dayofmonth),
    "day_of_week": _part(lambda t: F.weekday(t) + 1),
    "day_of_year": _part(F.dayofyear),
    "week_of_year": _part(F.weekofyear),
    "quarter": _part(F.quarter),
    "hour": _part(F.hour),
    "minute": _part(F.minute),
    "second": _part(F.second),
    "millis": lambda ms, offset=None: F.pmod(_long(ms), F.lit(1000)),
    "millis_of_day": lambda ms, offset=None: F.pmod(_long(ms if offset is None else ms + offset * 60000), F.lit(86400000)),
    "epoch_millis": lambda ms: _long(ms),
    "geo_lat": lambda p: p["lat"],
    "geo_lon": lambda p: p["lon"],
    "geo_distance": lambda p, lat, lon: haversine(p["lat"], p["lon"], _d(lat), _d(lon)),
    "arc_distance": lambda a, b, c, d: haversine(_d(a), _d(b), _d(c), _d(d)),
    "haversin": lambda a, b, c, d: haversine(_d(a), _d(b), _d(c), _d(d)) / 1000,
    "plane_distance": lambda p, lat, lon: _plane(p["lat"], p["lon"], _d(lat), _d(lon)),
    "geo_bearing": lambda p, lat, lon: _bearing(p["lat"], p["lon"], _d(lat), _d(lon)),
    "geo_in_box": lambda p, top, left, bottom, right: _long((p["lat"] <= top) & (p["lat"] >= bottom) & F.when(left <= right, p["lon"].between(left, right)).otherwise((p["lon"] >= left) | (p["lon"] <= right))),
    "geotile": lambda p, zoom: _geotile(p["lat"], p["lon"], zoom),
    "geohash": lambda p, chars: _geohash(p["lat"], p["lon"], chars),
    "gauss_decay": _decay(lambda d, s, k: F.exp(F.ln(k) * d * d / (s * s))),
    "exp_decay": _decay(lambda d, s, k: F.exp(F.ln(k) * d / s)),
    "linear_decay": _decay(lambda d, s, k: F.greatest(F.lit(0.0), (s / (1 - k) - d) / (s / (1 - k)))),
    "xxhash64": _hash(xxh64),
    "murmur64": _hash(murmur64),
    "hash_bucket": _bucket,
    "hash_combine": _combine,
}
PARTS = {"year", "month", "day_of_month", "day_of_week", "day_of_year", "week_of_year", "quarter", "hour", "minute", "second", "millis", "millis_of_day", "epoch_millis"}


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(_d(x)) & (F.abs(_d(x)) < float("inf")), x)


def _whole_sum(x: Column) -> Column:
    total = F.try_sum(x.cast("decimal(38,0)"))
    return F.when(total.between(-(1 << 63), (1 << 63) - 1), _long(total))


#: Aggregates by name; each takes the row's values. Values that aren't finite are skipped where only finite ones have a place.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "avg": lambda x: F.avg(_d(x)),
    "min": F.min,
    "max": F.max,
    "cardinality": lambda x, threshold=None: F.count_distinct(x),
    "percentile": lambda x, p, compression=None: F.percentile(_finite(_d(x)), _d(p) / 100),
    "percentile_rank": lambda x, v: F.try_divide(100.0 * F.count_if(_finite(_d(x)) <= v), F.count(_finite(_d(x)))),
}


class _Parser:
    def __init__(self, text: str, names: Names, aggregate: bool):
        self.text, self.names, self.aggregate = text, names, aggregate
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise RequestError("bad_expression", f"{text!r} at {at}")
            self.tokens.append(("number" if m[1] else "name" if m[2] else "string" if m[3] else "op", m[0].strip()))
            at = m.end()
        self.at = 0
        self.local: dict[str, Column] = {}
        self.inside = False

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want and self.tokens[self.at][1] != want):
            raise RequestError("bad_expression", f"{self.text!r}: expected {want or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Column:
        out = self.ternary()
        if self.at < len(self.tokens):
            raise RequestError("bad_expression", f"{self.text!r}: {self.peek()!r} is too much")
        return out

    def ternary(self) -> Column:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take("?")
        a = self.ternary()
        self.take(":")
        return FUNCTIONS["if"](test, a, self.ternary())

    def binary(self, level: int) -> Column:
        if level == len(LEVELS):
            return self.unary()
        left, compared = self.binary(level + 1), False
        while self.peek() in LEVELS[level] and self.tokens[self.at][0] == "op":
            op = self.take()[1]
            if compared and op in ("<", "<=", ">", ">=", "==", "!="):
                raise RequestError("bad_expression", f"{self.text!r}: comparisons don't chain")
            compared = True
            left = FUNCTIONS[NAMED[op]](left, self.binary(level + 1))
        return left

    def unary(self) -> Column:
        if self.peek() in ("-", "+", "!", "~") and self.tokens[self.at][0] == "op":
            op = self.take()[1]
            x = self.unary()
            return {"-": lambda: -x, "+": lambda: x, "!": lambda: FUNCTIONS["not"](x), "~": lambda: FUNCTIONS["bit_not"](x)}[op]()
        return self.primary()

    def primary(self) -> Column:
        kind, text = self.take()
        if kind == "number":
            if text[:2] in ("0x", "0X"):
                value = int(text, 16)
                return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")
            return F.lit(int(text)).cast("long") if text.isdigit() else F.lit(float(text))
        if text == "(":
            out = self.ternary()
            self.take(")")
            return out
        if kind != "name":
            raise RequestError("bad_expression", f"{self.text!r}: {text!r} is no value")
        if self.peek() == "(":
            return self.call(text)
        return self.leaf(text)

    def leaf(self, name: str) -> Column:
        if name.startswith("$"):
            if name[1:] not in self.names.vars:
                raise RequestError("unknown_variable", f"no variable {name}")
            return F.lit(self.names.vars[name[1:]])
        if name in self.local:
            return self.local[name]
        if name in ("score", "_score", "_score_"):
            if self.names.score is None:
                raise RequestError("no_score", f"{self.text!r}: there is no score here")
            return self.names.score
        if self.aggregate and not self.inside:
            raise RequestError("bad_expression", f"{self.text!r}: {name} needs an aggregate around it")
        head, _, last = name.rpartition(".")
        if head and last in PARTS and self.names.kind(head) == "date":
            return FUNCTIONS[last](self.field(head))
        if head and last in ("lat", "lon") and self.names.kind(head) == "geo_point":
            return self.names.column(head)[last]
        return self.field(name)

    def field(self, name: str) -> Column:
        c = self.names.column(name)
        return instant(c) if self.names.kind(name) == "date" else c

    def arguments(self) -> list[Column]:
        out = []
        self.take("(")
        while self.peek() != ")":
            out.append(self.ternary())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return out

    def call(self, name: str) -> Column:
        if name == "col":
            self.take("(")
            text = self.take()[1][1:-1]
            self.take(")")
            return self.field(text)
        if name == "let":
            self.take("(")
            local = self.take()[1]
            self.take(",")
            value = self.ternary()
            self.take(",")
            before = dict(self.local)
            self.local[local] = value
            out = self.ternary()
            self.local = before
            self.take(")")
            return out
        reducer = name in ("min", "max", "avg", "sum", "count")
        if self.aggregate and not self.inside and (name in AGGREGATES or name == "sum"):
            begin = self.at
            self.inside = True
            args = self.arguments()
            self.inside = False
            if name == "sum":
                whole = self._integral(begin)
                return _whole_sum(args[0]) if whole else F.sum(_d(args[0]))
            return AGGREGATES[name](*args)
        begin = self.at
        args = self.arguments()
        if reducer and len(args) == 1:
            many = self.names.kind(f"[{self.tokens[begin + 1][1]}]") == "many"
            xs = args[0] if many else F.filter(F.array(args[0]), lambda x: x.isNotNull())
            held = F.filter(xs, lambda x: x.isNotNull())
            if name == "count":
                return F.coalesce(_long(F.size(held)), F.lit(0))
            return {"min": F.array_min, "max": F.array_max, "sum": _sum, "avg": lambda x: _sum(x) / F.size(x)}[name](held)
        if name in ("min", "max") and len(args) == 2:
            return _both(*args, (F.least if name == "min" else F.greatest)(*args))
        if name == "random":
            return F.rand() if not args else _seeded(*args)
        if name not in FUNCTIONS:
            raise RequestError("unknown_function", f"no function {name}")
        try:
            return FUNCTIONS[name](*args)
        except TypeError:
            raise RequestError("bad_expression", f"{name} doesn't take {len(args)} arguments") from None

    def _integral(self, begin: int) -> bool:
        """Whether the aggregate's argument is built of whole numbers, so that its sum is exact."""
        part = self.tokens[begin : self.at]
        names = [t for i, (k, t) in enumerate(part) if k == "name" and not t.startswith("$")]
        simple = all(k != "number" or t.isdigit() for k, t in part) and not any(t == "/" for _, t in part)
        return simple and all(n in ("count", "abs", "add", "sub", "mul", "min", "max", "lt", "gt", "lte", "gte", "eq", "ne") or self.names.kind(n) in ("int", "boolean") or (n.partition(".")[0] and self.names.kind(f"[{n}]") == "many") for n in names) and not any(t.startswith("$") for _, t in part)


def value(text: str, names: Names) -> Column:
    """A row's value."""
    return _Parser(text, names, False).whole()


def metric(text: str, names: Names) -> Column:
    """A group's value: aggregates, and arithmetic over them. What can't be evaluated is null, never an error."""
    return _Parser(text, names, True).whole()


def now_ms() -> int:
    import time

    return int(time.time() * 1000)


__all__ = ["AGGREGATES", "FUNCTIONS", "Names", "dates", "haversine", "instant", "metric", "now_ms", "value"]

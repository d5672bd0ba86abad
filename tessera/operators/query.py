"""Queries: each compiles to a match (never null) and a score over one row of a view.

What needs knowledge of other rows (document frequencies, expansion of terms, nearest vectors) runs first, as an
aggregation whose result becomes literals, or a small keyed table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from ipaddress import ip_address, ip_network
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analysis, dates, values
from ..plans.errors import RequestError, Warn, only
from ..plans.schema import NUMERIC, RANGES, Field
from . import geo, knn, parse, scoring
from .collection import Scope

Query = Mapping[str, Any] | str


@dataclass(frozen=True)
class Compiled:
    """`scored` tells queries that rank from filters, which score 1 alone and 0 where a boolean requires them."""

    match: Column
    score: Column
    scored: bool = True


#: Arms of one's own: name -> (scope, spec) -> Compiled.
CUSTOM: dict[str, Callable[[Scope, Any], Compiled]] = {}


def register(name: str, arm: Callable[[Scope, Any], Compiled]) -> None:
    CUSTOM[name] = arm


def _plain(match: Column) -> Compiled:
    return Compiled(F.coalesce(match, F.lit(False)), F.lit(1.0), False)


def _any(parts: Sequence[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def _all(parts: Sequence[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def normalise(q: Query, vars: Mapping[str, Any] | None = None, nested: Sequence[str] = ()) -> dict:
    if isinstance(q, str):
        return parse.expression(q, vars, nested)
    arms = [k for k in q if k != "name"]
    if len(arms) != 1:
        raise RequestError("bad_query", f"a query has one arm, not {arms}")
    return {arms[0]: q[arms[0]], **({"name": q["name"]} if "name" in q else {})}


def compile(scope: Scope, q: Query) -> Compiled:
    nested = [n for n in scope.view.columns.names if scope.kind(n) == "nested"]
    q = normalise(q, scope.options.get("vars"), nested)
    arm = next(k for k in q if k != "name")
    spec = q[arm]
    made = {**_ARMS, **CUSTOM}.get(arm)
    if made is None:
        raise RequestError("unknown_query", f"no query {arm}")
    if isinstance(spec, Mapping) and arm in ("match", "any_of", "phrase", "prefix", "wildcard", "regex", "fuzzy") and "field" not in spec:
        short = {"match": "val", "any_of": "vals", "phrase": "text", "prefix": "prefix", "wildcard": "pattern", "regex": "pattern", "fuzzy": "term"}[arm]
        known = {"operator", "min_match", "case_insensitive", "slop", "max_expansions", "max_edits", "prefix_length"}
        names = [k for k in spec if k not in known]
        if len(names) == 1:
            spec = {**{k: v for k, v in spec.items() if k in known}, "field": names[0], short: spec[names[0]]}
    # A child's field in a condition on the parent: some child has it.
    name = spec.get("field") if isinstance(spec, Mapping) else None
    if isinstance(name, str) and "." in name and arm not in ("to_parent", "nested"):
        path, _, leaf = name.rpartition(".")
        if scope.kind(path.partition(".")[0]) == "nested":
            return compile(scope, {"to_parent": {"path": path, "query": {arm: {**spec, "field": leaf}}}})
    return made(scope, spec)


def foresee(scope: Scope, queries: Sequence[Query]) -> None:
    """Learn the terms of all `queries` in one pass for each field, not one for each clause. A rehearsal tells them; what it can't, clauses learn themselves."""
    scope.options.setdefault("stats", {})
    told: dict[tuple[str, str], Any] = {}
    for q in queries:
        try:
            compile(Scope(scope.view, {**scope.options, "joins": {}, "warnings": [], "stats": told, "rehearsal": True}), q)
        except Exception:  # noqa: BLE001, the request itself says what is wrong with it
            continue
    for (path, column), asked in told.items():
        own = scope if path == scope.view.path else scope.at(path)
        own.stats_for(column).learn(column, [t for c, t in asked.terms if c == column])


def _field(scope: Scope, spec: Mapping, use: str) -> Field:
    if "field" not in spec:
        raise RequestError("missing_key", "a field is missing")
    return scope.view.field(spec["field"], use)


def _each(field: Field, test: Callable[[Column], Column]) -> Column:
    c = F.col(field.source)
    return F.exists(c, test) if field.multi else test(c)


def _terms(scope: Scope, field: Field, found: Sequence[tuple[str, int]], boost: float = 1.0) -> list[Compiled]:
    column = scope.view.tokens(field)
    stats = scope.stats_for(column)
    stats.learn(column, [t for t, _ in found])
    average = stats.fields[column][1]
    out = []
    for t, _ in found:
        n = scoring.tf(column, t)
        weight = stats.idf(column, stats.terms[column, t]) * boost
        out.append(Compiled(F.coalesce(n > 0, F.lit(False)), scoring.saturated(n, F.size(column), average, weight, field.norms, scope.exact_norms)))
    return out


def _sum(parts: Sequence[Compiled], match: Column) -> Compiled:
    return Compiled(match, reduce(Column.__add__, [F.when(p.match, p.score).otherwise(0.0) for p in parts], F.lit(0.0)))


def _match(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field val operator min_match case_insensitive", "match")
    field, val = _field(scope, spec, "search"), spec.get("val")
    if field.type == "text":
        found = analysis.terms(field.analyzer, str(val))
        if spec.get("case_insensitive"):
            return _sum(cased := [_cased(scope, field, t) for t, _ in found], _any([p.match for p in cased]))
        parts = _terms(scope, field, found)
        need = len(parts) if spec.get("operator") == "and" else max(1, min(int(spec.get("min_match") or 1), len(parts)))
        if not parts:
            return _plain(F.lit(False))
        held = reduce(Column.__add__, [p.match.cast("int") for p in parts])
        return _sum(parts, _all([p.match for p in parts]) if need == len(parts) else _any([p.match for p in parts]) if need == 1 else held >= need)
    if field.type in ("string", "id"):
        for step in field.normalizer:
            val = analysis.run(("keyword", step), str(val))[0][0]
        test = (lambda c: F.lower(c) == str(val).lower()) if spec.get("case_insensitive") else (lambda c: c == str(val))
        return _plain(_each(field, test))
    if field.type == "ip":
        low, high = _ip_window(str(val))
        return _plain(_each(field, lambda c: c.between(F.lit(low), F.lit(high))))
    return _range(scope, {"field": spec["field"], "gte": val, "lte": val})


def _cased(scope: Scope, field: Field, term: str) -> Compiled:
    """All spellings that differ in case, as one term; others than the one asked for count nine tenths."""
    column = scope.view.tokens(field)
    stats = scope.stats_for(column)
    stats.learn(column, [term])
    variants = [r["t"] for r in stats.vocabulary(column).where(F.lower("t") == term.lower()).orderBy("t").collect()]
    stats.learn(column, variants)
    both = F.filter(F.col(column), lambda x: x.t.isin(variants or [term]))
    n = F.aggregate(both, F.lit(0.0), lambda a, x: a + F.when(x.t == term, 1.0).otherwise(0.9))
    df = max([stats.terms[column, t] for t in variants], default=0)
    return Compiled(F.coalesce(n > 0, F.lit(False)), scoring.saturated(n, F.size(column), stats.fields[column][1], stats.idf(column, df), field.norms, scope.exact_norms))


def _ip(text: str) -> bytes:
    a = ip_address(text)
    return (b"\x00" * 10 + b"\xff\xff" + a.packed) if a.version == 4 else a.packed


def _ip_window(text: str) -> tuple[bytearray, bytearray]:
    net = ip_network(text, strict=False)
    return bytearray(_ip(str(net[0]))), bytearray(_ip(str(net[-1])))


def _any_of(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field vals", "any_of")
    field, vals = _field(scope, spec, "value"), list(spec["vals"])
    if field.type == "text":
        found = [analysis.terms(field.analyzer, str(v)) for v in vals]
        if any(len(f) > 1 for f in found):
            raise RequestError("bad_value", f"a value of {field.name} is more than one term")
        column = scope.view.tokens(field)
        return _plain(F.exists(F.col(column), lambda x: x.t.isin([f[0][0] for f in found if f])))
    if field.type == "date":
        wanted = [dates.window(v, scope.now, scope.time_zone)[0] for v in vals]
        return _plain(_each(field, lambda c: values.instant(c).isin(wanted)))
    if field.type == "ip":
        return _plain(_each(field, lambda c: c.isin([bytearray(_ip(v)) for v in vals])))
    cast = {"int": int, "float": float, "double": float, "boolean": lambda v: v in (True, "true")}.get(field.type, str)
    return _plain(_each(field, lambda c: c.isin([cast(v) for v in vals])))


def _boolean(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "required filter optional prohibited min_match", "boolean")
    listed = lambda k: [compile(scope, q) for q in (spec.get(k) or [])]
    required, filters, optional, prohibited = (listed(k) for k in ("required", "filter", "optional", "prohibited"))
    held = reduce(Column.__add__, [p.match.cast("int") for p in optional], F.lit(0))
    need = int(spec.get("min_match") or 0)
    if not required and not filters and optional:
        need = max(need, 1)
    if not (required or filters or optional or prohibited):
        return _plain(F.lit(False))
    match = _all([p.match for p in [*required, *filters]] + [~p.match for p in prohibited])
    if need:
        match = match & (_any([p.match for p in optional]) if need == 1 else held >= need)
    # A filter that is required adds nothing; as an option it adds its constant.
    ranked = [p for p in required if p.scored] + optional
    score = reduce(Column.__add__, [F.when(p.match, p.score).otherwise(0.0) for p in ranked], F.lit(0.0))
    return Compiled(match, score, bool(ranked) or bool(required))


def _exists(scope: Scope, spec: Mapping | str) -> Compiled:
    name = spec if isinstance(spec, str) else spec["field"]
    c = F.col(scope.view.field(name).source)
    return _plain(F.size(c) > 0 if scope.view.field(name).multi else c.isNotNull())


def _bounds(scope: Scope, field: Field, spec: Mapping) -> list[tuple[str, Any]]:
    """Comparisons with literals; a date's literal is a window, of which gt and lte take the end."""
    out = []
    for op in ("gte", "gt", "lte", "lt"):
        v = spec.get(op)
        if v is None or v == "*":
            continue
        if field.type in ("date", "date_range"):
            low, high = dates.window(v, scope.now, scope.time_zone)
            v = high if op in ("gt", "lte") else low
        elif field.type in ("int", "long_range"):
            number = float(v)
            v = int(v) if str(v).lstrip("-").isdigit() else number
        elif field.type in ("float", "double", "double_range", "decimal"):
            v = float(v)
        elif field.type == "boolean":
            v = v in (True, "true")
        elif field.type == "ip":
            v = bytearray(_ip(str(v)))
        elif field.type == "text":
            v = analysis.folded(field.analyzer, str(v))
        out.append((op, v))
    return out


_OPS = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}


def _range(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field gte gt lte lt relation", "range")
    field = _field(scope, spec, "value")
    bounds = _bounds(scope, field, spec)
    if not bounds:
        return _exists(scope, spec["field"])
    if field.type in RANGES:
        ends = dict(bounds)
        low, high = ends.get("gte", ends.get("gt", -math.inf)), ends.get("lte", ends.get("lt", math.inf))
        c = F.col(field.source)
        lo, hi = F.coalesce(c["lo"].cast("double"), F.lit(-math.inf)), F.coalesce(c["hi"].cast("double"), F.lit(math.inf))
        tests = {"intersects": (lo <= high) & (hi >= low), "contains": (lo <= low) & (hi >= high), "within": (lo >= low) & (hi <= high)}
        relation = spec.get("relation", "intersects")
        if relation not in tests:
            raise RequestError("bad_relation", f"no relation {relation}")
        return _plain(c.isNotNull() & tests[relation])
    read = (lambda c: values.instant(c)) if field.type == "date" else (lambda c: c)
    if field.type == "date" and not field.multi:
        # A plain comparison of the column, so that it reaches the scan.
        kind = scope.view.columns[field.source].dataType.simpleString() if field.source in scope.view.columns.names else "timestamp"
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.col(field.source)
            return _plain(_all([_OPS[op](c, F.timestamp_millis(F.lit(v)).cast(kind)) if op in ("gte", "lt") else _OPS[op](c, F.timestamp_millis(F.lit(v)).cast(kind) + F.expr("interval 999 microseconds")) for op, v in bounds]))
    test = lambda c: _all([_OPS[op](read(c), F.lit(v)) for op, v in bounds])
    if field.type == "text":
        return _plain(F.exists(F.col(scope.view.tokens(field)), lambda x: test(x.t)))
    return _plain(_each(field, test))


def _phrase(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field text slop", "phrase")
    field = _field(scope, spec, "search")
    if field.type != "text":
        return _match(scope, {"field": spec["field"], "val": spec["text"]})
    found = analysis.terms(field.analyzer, spec["text"])
    if not found:
        return _plain(F.lit(False))
    if len(found) == 1:
        return _terms(scope, field, found)[0]
    slop = max(0, int(spec.get("slop") or 0))
    column = scope.view.tokens(field)
    stats = scope.stats_for(column)
    stats.learn(column, [t for t, _ in found])
    weight = sum(stats.idf(column, stats.terms[column, t]) for t, _ in found)
    n = scoring.sloppy_freq(column, found, slop) if slop else scoring.phrase_freq(column, found)
    # Texts without all words are settled before places are compared.
    own = F.transform(F.col(column), lambda x: x.t)
    n = F.when(_all([F.array_contains(own, t) for t in dict(found)]), n)
    return Compiled(F.coalesce(n > 0, F.lit(False)), scoring.saturated(n, F.size(column), stats.fields[column][1], weight, field.norms, scope.exact_norms))


def _pattern(scope: Scope, field: Field, test: Callable[[Column], Column], most: int = 0) -> Compiled:
    """Terms that pass `test`, with a constant score; `most` keeps the commonest only."""
    if field.type != "text":
        return _plain(_each(field, test))
    column = scope.view.tokens(field)
    if most:
        rows = scope.stats_for(column).vocabulary(column).where(test(F.col("t"))).orderBy(F.desc("df"), "t").limit(most).collect()
        return _plain(F.exists(F.col(column), lambda x: x.t.isin([r["t"] for r in rows])))
    return _plain(F.exists(F.col(column), lambda x: test(x.t)))


def _prefix(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field prefix max_expansions", "prefix")
    field = _field(scope, spec, "search")
    text = analysis.folded(field.analyzer, spec["prefix"]) if field.type == "text" else spec["prefix"]
    return _pattern(scope, field, lambda c: c.startswith(text), int(spec.get("max_expansions") or 0))


def wildcard_regex(pattern: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        at += 1
    return f"^(?s:{''.join(out)})$"


def _wildcard(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field pattern max_expansions", "wildcard")
    field = _field(scope, spec, "search")
    text = analysis.folded(field.analyzer, spec["pattern"]) if field.type == "text" else spec["pattern"]
    return _pattern(scope, field, lambda c: c.rlike(wildcard_regex(text)), int(spec.get("max_expansions") or 0))


def _regex(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "field pattern max_expansions", "regex")
    field = _field(scope, spec, "search")
    # Patterns are anchored, and ^ and $ stand for themselves outside classes.
    plain = re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.|[$^]", lambda m: "\\" + m[0] if m[0] in "$^" else m[0], spec["pattern"])
    return _pattern(scope, field, lambda c: c.rlike(f"^(?:{plain})$"), int(spec.get("max_expansions") or 0))


def _bytes_view(c: Column) -> Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _fuzzy(scope: Scope, spec: Mapping) -> Compiled:
    """Terms within some byte edits. Those found share the greatest document frequency and count less the farther off."""
    only(spec, "field term max_edits prefix_length max_expansions", "fuzzy")
    field = _field(scope, spec, "search")
    term = analysis.folded(field.analyzer, spec["term"]) if field.type == "text" else spec["term"]
    size = len(term.encode())
    edits = spec.get("max_edits")
    edits = (0 if size <= 2 else 1 if size <= 5 else 2) if edits is None else int(edits)
    if edits > 2:
        scope.warnings.append(Warn("fuzzy_clamped", f"max_edits is 2, not {edits}: more edits than two are never searched"))
        edits = 2
    head = term[: int(spec.get("prefix_length", 1))]
    latin = term.encode().decode("latin-1")
    distance = lambda c: F.levenshtein(_bytes_view(c), F.lit(latin), edits)
    test = lambda c: c.startswith(head) & distance(c).between(0, edits)
    if field.type != "text":
        return _plain(_each(field, test))
    column = scope.view.tokens(field)
    stats = scope.stats_for(column)
    most = int(spec.get("max_expansions") or 50)
    rows = stats.vocabulary(column).where(test(F.col("t"))).select("t", "df", distance(F.col("t")).alias("d")).orderBy("d", F.desc("df"), "t").limit(most).collect()
    stats.learn(column, [r["t"] for r in rows])
    if not rows:
        return Compiled(F.lit(False), F.lit(0.0))
    df, parts = max(r["df"] for r in rows), []
    for r in rows:
        n = scoring.tf(column, r["t"])
        damp = 1 - r["d"] / (len(head.encode()) + min(size, len(r["t"].encode())))
        parts.append(Compiled(F.coalesce(n > 0, F.lit(False)), scoring.saturated(n, F.size(column), stats.fields[column][1], stats.idf(column, df) * damp, field.norms, scope.exact_norms)))
    return _sum(parts, _any([p.match for p in parts]))


def _constant(scope: Scope, spec: Mapping) -> Compiled:
    inner = compile(scope, spec["query"])
    return Compiled(inner.match, F.lit(float(spec.get("score", 1.0))))


def _boost(scope: Scope, spec: Mapping) -> Compiled:
    inner = compile(scope, spec["query"])
    return Compiled(inner.match, inner.score * float(spec["boost"]), True)


def _rescore(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "query expr vars min_score", "rescore")
    inner = compile(scope, spec["query"])
    made = values.value(spec["expr"], scope.expressions(inner.score, spec.get("vars"))).cast("double")
    sound = F.when(F.isnan(made) | (F.abs(made) == math.inf), F.raise_error(F.lit("rescore: not finite")).cast("double")).otherwise(made)
    score = F.when(inner.match, F.coalesce(sound, F.lit(0.0))).otherwise(0.0)
    return Compiled(inner.match & (score >= float(spec["min_score"])) if spec.get("min_score") is not None else inner.match, score)


def _dis_max(scope: Scope, spec: Mapping) -> Compiled:
    only(spec, "queries tie", "dis_max")
    return _best([compile(scope, q) for q in spec["queries"]], float(spec.get("tie") or 0.0))


def _best(parts: Sequence[Compiled], tie: float) -> Compiled:
    held = [F.when(p.match, p.score) for p in parts]
    if not held:
        return _plain(F.lit(False))
    top = F.coalesce(F.greatest(*held) if len(held) > 1 else held[0], F.lit(0.0))
    total = reduce(Column.__add__, [F.coalesce(h, F.lit(0.0)) for h in held])
    return Compiled(_any([p.match for p in parts]), top + (total - top) * tie)


def _weighted(scope: Scope, fields: Sequence[Any]) -> list[tuple[Field, float]]:
    out: dict[str, tuple[Field, float]] = {}
    for f in fields:
        name, weight = (f["field"], float(f.get("weight", 1.0))) if isinstance(f, Mapping) else (f.partition("^")[0], float(f.partition("^")[2] or 1))
        for n in scope.view.names(name) if "*" in name else [name]:
            out[n] = (scope.view.field(n, "search"), weight)
    if len(out) > 64:
        raise RequestError("too_many_fields", "a pattern names over 64 fields")
    return list(out.values())


def _multi_match(scope: Scope, spec: Mapping) -> Compiled:
    """combined: fields of one analyzer are one field of weighted counts and lengths; per_field: the best field's own match."""
    only(spec, "text fields operator min_match mode tie phrase", "multi_match")
    fields = [(f, w) for f, w in _weighted(scope, spec["fields"]) if f.type == "text"]
    if spec.get("mode") == "per_field":
        one = lambda f: {"phrase": {"field": f.name, "text": spec["text"], **spec["phrase"]}} if "phrase" in spec else {"match": {"field": f.name, "val": spec["text"], **{k: spec[k] for k in ("operator", "min_match") if k in spec}}}
        return _best([Compiled((m := compile(scope, one(f))).match, m.score * w) for f, w in fields], float(spec.get("tie") or 0.0))
    groups: dict[Any, list[tuple[Field, float]]] = {}
    for f, w in fields:
        groups.setdefault(f.analyzer, []).append((f, w))
    return _best([_combined(scope, own, spec) for own in groups.values()], float(spec.get("tie", 1.0)))


def _combined(scope: Scope, fields: Sequence[tuple[Field, float]], spec: Mapping) -> Compiled:
    found = [t for t, _ in analysis.terms(fields[0][0].analyzer, spec["text"])]
    held = []
    for f, w in fields:
        column = scope.view.tokens(f)
        stats = scope.stats_for(column)
        stats.learn(column, found)
        held.append((column, w, stats))
    average = sum(w * s.fields[c][1] for c, w, s in held)
    length = reduce(Column.__add__, [F.coalesce(F.size(c), F.lit(0)) * w for c, w, _ in held])
    parts = []
    for t in found:
        n = reduce(Column.__add__, [F.coalesce(scoring.tf(c, t), F.lit(0)) * w for c, w, _ in held])
        most = max(held, key=lambda x: x[2].terms[x[0], t])
        df, size = most[2].terms[most[0], t], max(s.fields[c][0] for c, _, s in held)
        weight = math.log1p((size - df + 0.5) / (df + 0.5))
        parts.append(Compiled(n > 0, scoring.saturated(n, F.round(length), average, weight, True, scope.exact_norms)))
    if not parts:
        return _plain(F.lit(False))
    need = len(parts) if spec.get("operator") == "and" else max(1, min(int(spec.get("min_match") or 1), len(parts)))
    return _sum(parts, reduce(Column.__add__, [p.match.cast("int") for p in parts]) >= need)


def _to_parent(scope: Scope, spec: Mapping) -> Compiled:
    """Documents by their children: a correlated test over the array of children, no join."""
    only(spec, "path query score min_children max_children", "to_parent")
    path = spec["path"]
    mode, low, high = spec.get("score", "none"), spec.get("min_children"), spec.get("max_children")
    view = scope.view.collection.view(f"{scope.view.path}.{path}" if scope.view.path else path)
    inner_scope = scope.at(view.path)
    inner = compile(inner_scope, spec["query"])
    hits = view.analyse(view.base).where(inner.match).select(F.col("_owner_").alias("_o"), inner.score.alias("_s"))
    agg = {"max": F.max("_s"), "min": F.min("_s"), "sum": F.sum("_s"), "avg": F.avg("_s"), "none": F.lit(1.0)}
    if mode not in agg:
        raise RequestError("bad_score", f"no score {mode}")
    owners = hits.groupBy("_o").agg(agg[mode].alias("_s"), F.count("*").alias("_n"))
    joins = scope.options.setdefault("joins", {}).setdefault(scope.view.path, [])
    at = len(joins)
    joins.append(owners.select(F.col("_o").alias(f"_j{at}_o"), F.col("_s").alias(f"_j{at}_s"), F.col("_n").alias(f"_j{at}_n")))
    n = F.coalesce(F.col(f"_j{at}_n"), F.lit(0))
    match = n >= int(low if low is not None else 1)
    if high is not None:
        match = match & (n <= int(high))
    return Compiled(match, F.coalesce(F.col(f"_j{at}_s"), F.lit(0.0)) if mode != "none" else F.lit(1.0), mode != "none")


def _knn(scope: Scope, spec: Mapping) -> Compiled:
    """The k rows nearest, within the filters of its own and the list's; found first, joined back by key."""
    only(spec, "field query k similarity filter unit nprobe ivf refine_candidates", "knn")
    if scope.options.get("rehearsal"):
        raise scoring.Unforeseen
    field = _field(scope, spec, "primary")
    domain = scope.view.analyse(scope.view.base)
    for f in [*(spec.get("filter") or []), *scope.options.get("domain", [])]:
        inner = compile(scope, f)
        domain = attach(scope, scope.view.analyse(domain)).where(inner.match)
    group = scope.options.get("collapse") if spec.get("unit") == "groups" else None
    near = knn.nearest(domain, "_owner_", field, spec["query"], int(spec.get("k", 10)), spec.get("similarity"), group)
    joins = scope.options.setdefault("joins", {}).setdefault(scope.view.path, [])
    at = len(joins)
    joins.append(near.select(F.col("_owner_").alias(f"_j{at}_o"), F.col("_near_").alias(f"_j{at}_s"), F.lit(1).alias(f"_j{at}_n")))
    return Compiled(F.col(f"_j{at}_n").isNotNull(), F.coalesce(F.col(f"_j{at}_s"), F.lit(0.0)))


def attach(scope: Scope, df):
    """`df` with what parents' and vector queries found, by left joins on the owner's key."""
    for i, found in enumerate(scope.options.get("joins", {}).get(scope.view.path, [])):
        if f"_j{i}_o" not in df.columns:
            df = df.join(found, F.col("_owner_") == F.col(f"_j{i}_o"), "left")
    return df


def _geo(fn: Callable[[Column, Mapping], Column]) -> Callable[[Scope, Mapping], Compiled]:
    def made(scope: Scope, spec: Mapping) -> Compiled:
        field = _field(scope, spec, "primary")
        return _plain(_each(field, lambda p: fn(p, spec)))

    return made


def _polygons(p: Column, spec: Mapping) -> Column:
    shapes = spec.get("polygons") or [spec["polygon"]]
    return _any([geo.polygon(p, s if isinstance(s[0][0], (list, tuple)) else [s]) for s in shapes])


def _meters(d: Any) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*(km|mi|m|ft)?\s*", str(d))
    if not m:
        raise RequestError("bad_distance", f"not a distance: {d}")
    return float(m[1]) * {"km": 1000.0, "mi": 1609.344, "ft": 0.3048}.get(m[2], 1.0)


_ARMS: dict[str, Callable[[Scope, Any], Compiled]] = {
    "all": lambda scope, spec: _plain(F.lit(True)),
    "none": lambda scope, spec: _plain(F.lit(False)),
    "match": _match,
    "any_of": _any_of,
    "boolean": _boolean,
    "exists": _exists,
    "range": _range,
    "phrase": _phrase,
    "prefix": _prefix,
    "wildcard": _wildcard,
    "regex": _regex,
    "fuzzy": _fuzzy,
    "constant_score": _constant,
    "boost": _boost,
    "rescore": _rescore,
    "dis_max": _dis_max,
    "multi_match": _multi_match,
    "simple_query": lambda scope, spec: compile(scope, parse.simple(spec)),
    "expr": lambda scope, spec: compile(scope, parse.expression(spec["q"], {**scope.options.get("vars", {}), **spec.get("vars", {})}, [n for n in scope.view.columns.names if scope.kind(n) == "nested"])),
    "knn": _knn,
    "to_parent": _to_parent,
    "geo_box": _geo(lambda p, s: geo.box(p, s["top"], s["left"], s["bottom"], s["right"])),
    "geo_distance": _geo(lambda p, s: geo.near(p, *geo.point(s["center"]), _meters(s["distance"]))),
    "geo_polygon": _geo(_polygons),
}
#: Types that range() compares as numbers.
COMPARED = NUMERIC

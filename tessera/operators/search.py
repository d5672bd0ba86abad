"""Requests: a tree of named operations over the matches of a tree of queries, as DataFrames.

Every list and facet is a lazy DataFrame on `Result`; `to_dict()` runs them and nests them as documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..plans.errors import RequestError, only
from . import facets
from . import query as queries
from .collection import ORDER, Collection, Scope
from .output import FLAGS, decorated, documents, shaped

LIST = "query filter sort limit offset fields ops collapse diversify min_score get_scores count_limit row_ops top_docs name decorators "
REQUEST = "request_id freshness_ms min_commit time_zone vars profile explain max_parallel exact_norms now document_format date_iso date_ms date_ns date_native int64_str decimal_scaled estimate_count cache "
FACETS = ("field_facet", "range_facet", "query_facet")
#: Operations of one's own: name -> (list, frame, spec) -> DataFrame.
CUSTOM: dict[str, Callable[[Any, DataFrame, Any], DataFrame]] = {}


def register(name: str, op: Callable[[Any, DataFrame, Any], DataFrame]) -> None:
    CUSTOM[name] = op


@dataclass
class Result:
    """`docs` in order, `ops` by name; `matches` are all rows of the list, for further use."""

    docs: DataFrame | None = None
    matches: DataFrame | None = None
    count: Callable[[], dict[str, Any]] = dict
    ops: dict[str, Any] = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    row_ops: dict[str, DataFrame] = field(default_factory=dict)
    layout: str = "row"

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = dict(self.count())
        if self.docs is not None:
            out["docs"] = documents(self.docs, self.layout)
        if self.ops:
            out["ops"] = {n: o.to_dict() if hasattr(o, "to_dict") else o for n, o in self.ops.items()}
        if self.warnings:
            out["warnings"] = [vars(w) for w in self.warnings]
        return out

    def explain(self) -> str:
        return (self.docs if self.docs is not None else self.matches)._jdf.queryExecution().toString()


@dataclass
class Metric:
    frame: DataFrame
    name: str

    def to_dict(self) -> Any:
        return self.frame.first()[self.name]


@dataclass
class Facet:
    """`frame` has the parents' bucket columns, the own one by the facet's name, count and metrics; `inner` by name likewise."""

    frame: DataFrame
    name: str
    parents: tuple[str, ...] = ()
    missing: Callable[[], int] | None = None
    inner: dict[str, Any] = field(default_factory=dict)

    def to_dict(self, of: Mapping[str, Any] | None = None) -> dict[str, Any]:
        buckets = []
        for r in self.frame.collect():
            row = r.asDict(recursive=True)
            if of and any(row[p] != of[p] for p in self.parents):
                continue
            own = {p: row.pop(p) for p in self.parents}
            val = row.pop(self.name)
            row = {"val": val, **row}
            for n, x in self.inner.items():
                row[n] = x.to_dict({**own, self.name: val}) if isinstance(x, Facet) else [t.asDict(recursive=True) for t in x.where(_same({**own, self.name: val})).collect()]
            buckets.append(row)
        return {"buckets": buckets, **({"missing": self.missing()} if self.missing else {})}


def _same(of: Mapping[str, Any]) -> Column:
    out = F.lit(True)
    for k, v in of.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def orders(scope: Scope, spec: Any, score: bool = True) -> list[Column]:
    """Sort columns, missing values last both ways; the document's order settles ties."""
    out = []
    for s in [spec] if isinstance(spec, (str, Mapping)) else spec or []:
        if isinstance(s, Mapping):
            what, way, vars = s["expr"], s.get("dir"), s.get("vars")
        else:
            what, _, way = s.strip().rpartition(" ")
            what, way = (what, way) if way in ("asc", "desc") and what else (s.strip(), None)
            vars = None
        if what in ("score", "_score_"):
            way, c = way or "desc", F.col("_score_")
        elif what == ORDER:
            c = F.col(ORDER)
        elif what.replace("_", "").replace(".", "").isalnum() and not what[0].isdigit():
            c = scope.column(what)
            if scope.kind(f"[{what}]") == "many":
                c = (F.array_max if way == "desc" else F.array_min)(c)
        else:
            c = values.value(what, scope.expressions(F.col("_score_"), vars))
        out.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
    if not out and score:
        out.append(F.desc("_score_"))
    return [*out, F.asc(ORDER)]


class List:
    """One `top_docs`: query, filters, selections of its facets, and what is made of its matches."""

    def __init__(self, scope: Scope, spec: Mapping[str, Any], domain: DataFrame | None = None):
        only(spec, LIST + REQUEST + "domain", "a list")
        self.spec, self.domain = spec, domain
        filters = [f if isinstance(f, Mapping) and "except_ops" in f else {"q": f} for f in _listed(spec.get("filter"))]
        collapse = spec.get("collapse")
        names = facets.group_key(scope, collapse)[0] if collapse is not None else None
        self.scope = scope
        options = dict(scope.options)
        options["joins"] = {}
        options["domain"] = [f.get("q", f.get("query", f)) for f in filters]
        if names is not None:
            own = collapse if isinstance(collapse, (str, list)) else collapse["field"]
            options["collapse"] = own if isinstance(own, list) else [own]
        self.scope = Scope(scope.view, options)
        queries.foresee(self.scope, [spec.get("query", {"all": True}), *options["domain"]])
        self.query = queries.compile(self.scope, spec.get("query", {"all": True}))
        self.filters: list[tuple[Column, frozenset, str]] = []
        for f in filters:
            q = {k: v for k, v in f.items() if k not in ("except_ops", "q")} or f.get("q")
            q = q["query"] if isinstance(q, Mapping) and set(q) == {"query"} else q
            self.filters.append((queries.compile(self.scope, q).match, frozenset(f.get("except_ops", ())), ""))
        for name, op in (spec.get("ops") or {}).items():
            for kind in FACETS:
                own = op.get(kind) if isinstance(op, Mapping) else None
                if own and own.get("selected") is not None:
                    chosen = own["selected"] if isinstance(own["selected"], list) else [own["selected"]]
                    tests = [self._selection(kind, own, v) for v in chosen]
                    every = own.get("selection_mode", "any") == "all"
                    test = tests[0]
                    for t in tests[1:]:
                        test = (test & t) if every else (test | t)
                    self.filters.append((test, frozenset() if every else frozenset([name]), name))
        # Facets and sorts may need tokens too, so they register before the base is analysed.
        self.least = spec.get("min_score")

    def _selection(self, kind: str, own: Mapping, v: Any) -> Column:
        if kind == "query_facet":
            return queries.compile(self.scope, own["buckets"][v]).match
        if kind == "field_facet":
            return queries.compile(self.scope, {"any_of": {"field": own["field"], "vals": [v]}}).match
        return queries.compile(self.scope, {"range": {"field": own["field"], "gte": v[0], "lt": v[1]}}).match

    def rows(self, op: str = "", query: bool = True) -> DataFrame:
        """Matches as the named operation sees them, with `_score_`."""
        base = self.domain if self.domain is not None else self.scope.view.base
        keep = self.query.match if query else F.lit(True)
        for test, spared, _ in self.filters:
            if op in spared:
                continue
            # What needs neither tokens nor joins is settled first, at the scan.
            if "_tok_" in str(test) or "_j" in str(test):
                keep = keep & test
            else:
                base = base.where(test)
        base = queries.attach(self.scope, self.scope.view.analyse(base))
        out = base.where(keep).withColumn("_score_", self.query.score if query else F.lit(1.0))
        return out.where(F.col("_score_") >= float(self.least)) if self.least is not None and query else out

    # The page

    def grouped(self, rows: DataFrame) -> DataFrame:
        """The best row of each collapse key, with `_group_`."""
        spec = self.spec["collapse"]
        spec = {"field": spec} if isinstance(spec, (str, list)) else spec
        only(spec, "field missing sort head_sort get_count ops", "collapse")
        keys, missing = facets.group_key(self.scope, spec)
        lone = F.lit(False)
        for k in keys:
            lone = lone | k.isNull()
        rows = rows.withColumn("_group_", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
        if missing == "drop":
            rows = rows.where(~lone)
        rows = rows.withColumn("_lone_", F.when(lone, F.col(ORDER)) if missing == "expand" else F.lit(None))
        by = Window.partitionBy("_group_", "_lone_")
        rows = rows.withColumn("_best_", F.row_number().over(by.orderBy(*orders(self.scope, self.spec.get("sort")))))
        if spec.get("head_sort"):
            rows = rows.withColumn("_head_", F.row_number().over(by.orderBy(*orders(self.scope, spec["head_sort"]))))
        if spec.get("get_count"):
            rows = rows.withColumn("_count_", F.count("*").over(by))
        for name, op in (spec.get("ops") or {}).items():
            if isinstance(op, str):
                made = rows.groupBy("_group_", "_lone_").agg(values.metric(op, self.scope.expressions(F.col("_score_"))).alias(name))
                rows = rows.join(made.select(F.col("_group_").alias("_g"), F.col("_lone_").alias("_l"), name), F.col("_group_").eqNullSafe(F.col("_g")) & F.col("_lone_").eqNullSafe(F.col("_l"))).drop("_g", "_l")
        return rows

    @cached_property
    def page(self) -> DataFrame:
        spec = self.spec
        rows = self.rows()
        order = orders(self.scope, spec.get("sort"))
        if spec.get("diversify"):
            own = spec["diversify"]
            only(own, "field max_per_key missing", "diversify")
            keys, missing = facets.group_key(self.scope, own)
            lone = F.coalesce(*[F.when(k.isNull(), F.lit(True)) for k in keys], F.lit(False))
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            rows = rows.withColumn("_n", rank).where((F.col("_n") <= int(own.get("max_per_key", 1))) | (lone if missing == "expand" else F.lit(False)))
            rows = rows.where(~lone) if missing == "drop" else rows
        if spec.get("collapse") is not None:
            own = spec["collapse"] if isinstance(spec["collapse"], Mapping) else {}
            rows = self.grouped(rows)
            if own.get("sort"):
                order = [*[(F.col(s.split()[0]).desc_nulls_last() if s.endswith(" desc") else F.col(s.split()[0]).asc_nulls_last()) for s in _listed(own["sort"])], *order]
            if own.get("head_sort"):
                # The group keeps its best row's place; another member is shown.
                keep = [F.col("_group_"), F.col("_lone_")]
                places = Window.partitionBy(*keep)
                marks = [F.first(F.when(F.col("_best_") == 1, c), True).over(places).alias(f"_o{i}") for i, c in enumerate(self._plain(order))]
                rows = rows.select("*", *marks).where("_head_ = 1")
                order = [F.col(f"_o{i}").desc_nulls_last() if "DESC" in str(o) else F.col(f"_o{i}").asc_nulls_last() for i, o in enumerate(order)]
            else:
                rows = rows.where("_best_ = 1")
        rows = rows.orderBy(*order)
        if spec.get("offset"):
            rows = rows.offset(int(spec["offset"]))
        limit = int(spec.get("limit", 10))
        return rows.limit(limit) if limit >= 0 else rows

    def _plain(self, order: Sequence[Column]) -> list[Column]:
        sorts = [self.spec.get("sort")] if isinstance(self.spec.get("sort"), (str, Mapping)) else self.spec.get("sort") or ["score desc"]
        out = []
        for s in [*sorts, ORDER]:
            what = s["expr"] if isinstance(s, Mapping) else s.rsplit(" ", 1)[0] if s.endswith((" asc", " desc")) else s
            out.append(F.col("_score_") if what in ("score", "_score_") else F.col(ORDER) if what == ORDER else values.value(what, self.scope.expressions(F.col("_score_"))))
        return out[: len(order)]

    def projected(self, page: DataFrame) -> DataFrame:
        view, key = self.scope.view, self.scope.view.collection.key
        wanted = self.spec.get("fields") or [n for n in view.columns.names if view.path or n == key or _kind(self.scope, n) != "vector"]
        out, seen = [], set()
        for f in wanted:
            for n in view.names(f) if "*" in f else [f]:
                if n in seen:
                    continue
                seen.add(n)
                if n.startswith("../"):
                    up = n.count("../")
                    out.append(F.col(f"_up{up}")[n.replace("../", "")].alias(n))
                elif n.startswith("/"):
                    out.append(F.col(f"_up{len(view.path.split('.'))}")[n[1:]].alias(n))
                elif "." in n and n.partition(".")[0] in view.columns.names:
                    out.append(self.scope.column(n).alias(n))
                else:
                    out.append(F.col(view.field(n).source).alias(n))
        extra = ["_score_"] * bool(self.spec.get("get_scores"))
        own = self.spec.get("collapse")
        if own is not None:
            extra += ["_group_"]
            if isinstance(own, Mapping):
                extra += ["_count_"] * bool(own.get("get_count")) + [n for n, o in (own.get("ops") or {}).items() if isinstance(o, str)]
        return page.select(*out, *[F.col(e) for e in extra])

    def found(self) -> dict[str, Any]:
        # An estimate (-2) may always be exact.
        limit = int(self.spec.get("count_limit", -1))
        if limit == 0:
            return {}
        rows = self.rows()
        if self.spec.get("collapse") is not None:
            keyed = self.grouped(rows)
            return {"found": keyed.where("_best_ = 1").count(), "found_docs": rows.count()}
        if limit > 0:
            n = rows.limit(limit + 1).count()
            return {"found": min(n, limit), **({"found_gte": True} if n > limit else {})}
        return {"found": rows.count()}

    # What else is asked of the matches

    def result(self) -> Result:
        limit = int(self.spec.get("limit", 10))
        flags = {**self.scope.options.get("flags", {}), **{f: self.spec[f] for f in FLAGS if f in self.spec}}
        docs = self.projected(decorated(self.page, self.spec.get("decorators") or [])) if limit else None
        docs = shaped(docs, flags) if docs is not None and any(flags.values()) else docs
        out = Result(docs, self.rows(), self.found, self.ops(self.spec.get("ops") or {}), self.scope.warnings, layout=self.spec.get("document_format", "row"))
        for name, op in (self.spec.get("row_ops") or {}).items():
            out.row_ops[name] = self.children(op)
        return out

    def children(self, op: Mapping[str, Any]) -> DataFrame:
        """For each row of the page, the best of its own children: `_owner_` and the children's fields."""
        domain = op.get("domain", {})
        path, filters = domain.get("to", ""), _listed(domain.get("filter"))
        if "from_match" in domain:
            path, test = _named(self.spec.get("query"), domain["from_match"])
            filters = [*filters, test]
        own = op.get("top_docs", {})
        inner = List(self.scope.at(path), {**own, "filter": filters, "limit": -1})
        rank = F.row_number().over(Window.partitionBy("_owner_").orderBy(*orders(inner.scope, own.get("sort"))))
        rows = inner.rows().join(self.page.select(F.col("_owner_").alias("_p")), F.col("_owner_") == F.col("_p"), "left_semi")
        rows = rows.withColumn("_n", rank).where(F.col("_n") <= int(own.get("limit", 10)))
        shown = own.get("fields") or inner.scope.view.columns.names
        return rows.orderBy("_owner_", "_n").select("_owner_", *shown)

    def ops(self, ops: Mapping[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        metrics = {n: o for n, o in ops.items() if isinstance(o, str)}
        if metrics:
            made = self.rows().agg(*(values.metric(o, self.scope.expressions(F.col("_score_"))).alias(n) for n, o in metrics.items()))
            out |= {n: Metric(made, n) for n in metrics}
        for name, op in ops.items():
            if not isinstance(op, str):
                out[name] = self.op(name, op, self.rows(name), (), lambda df: df)
        return out

    def rescoped(self, name: str, op: Mapping[str, Any], rows: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> tuple[Scope, DataFrame]:
        """The rows of an operation's own domain: another view, another query, more filters; bucket identities stay."""
        domain, scope = op.get("domain") or {}, self.scope
        only(domain, "query filter to apply_parent_filters from_match", "domain")
        if domain.get("query") is not None:
            inner = List(Scope(scope.view, {**scope.options, "joins": {}}), {"query": domain["query"]})
            if domain.get("apply_parent_filters"):
                inner.filters = [f for f in self.filters]
            rows = keyed(inner.rows(name))
        if domain.get("to"):
            to = domain["to"]
            path = "" if to == "/" else scope.view.path.rpartition(".")[0] if to == ".." else f"{scope.view.path}.{to}" if scope.view.path else to
            scope = scope.at(path)
            base = scope.view.base
            if len(path) > len(self.scope.view.path):
                rows = base.join(rows.select(F.col("_owner_").alias("_p")).distinct(), F.col("_owner_") == F.col("_p"), "left_semi")
            else:
                rows = base.join(rows.select(F.col("_owner_").alias("_p")).distinct(), F.col("_owner_") == F.col("_p"), "left_semi") if not path else base.join(rows.select(F.col("_owner_").alias("_p"), F.slice("_at_", 1, len(path.split("."))).alias("_q")).distinct(), (F.col("_owner_") == F.col("_p")) & (F.col("_at_") == F.col("_q")), "left_semi")
            rows = rows.withColumn("_score_", F.lit(1.0))
        for f in _listed(domain.get("filter")):
            test = queries.compile(scope, f).match
            rows = queries.attach(scope, scope.view.analyse(rows)).where(test)
        return scope, rows

    def op(self, name: str, op: Mapping[str, Any], rows: DataFrame, parents: tuple[str, ...], keyed: Callable[[DataFrame], DataFrame]) -> Any:
        kinds = [k for k in op if k != "domain"]
        if len(kinds) != 1:
            raise RequestError("bad_op", f"{name} has one operation, not {kinds}")
        kind, spec = kinds[0], op[kinds[0]]
        scope, rows = self.rescoped(name, op, rows, keyed)
        if kind in FACETS:
            return self.facet(scope, name, kind, spec, rows, parents, keyed)
        if kind == "top_docs":
            if not parents:
                inner = List(Scope(scope.view, {**scope.options, "joins": {}}), spec, rows)
                return inner.result()
            rank = F.row_number().over(Window.partitionBy(*parents).orderBy(*orders(scope, spec.get("sort"))))
            if spec.get("query") is not None:
                rows = rows.where(queries.compile(scope, spec["query"]).match)
            top = rows.withColumn("_rank_", rank).where(F.col("_rank_") <= int(spec.get("limit", 10)))
            shown = spec.get("fields") or [scope.view.collection.key]
            return top.orderBy(*parents, "_rank_").select(*parents, "_rank_", *shown)
        if kind == "fusion":
            return fuse(scope, spec, rows)
        if kind in CUSTOM:
            return CUSTOM[kind](self, rows, spec)
        raise RequestError("unknown_op", f"no operation {kind}")

    def facet(self, scope: Scope, name: str, kind: str, spec: Mapping[str, Any], rows: DataFrame, parents: tuple[str, ...], keyed: Callable[[DataFrame], DataFrame]) -> Facet:
        def extent(c: Column) -> tuple:
            r = queries.attach(scope, scope.view.analyse(rows)).agg(F.min(c), F.max(c)).first()
            return r[0], r[1]

        add, known = facets.bucket(scope, kind, spec, name, lambda q: queries.compile(scope, q).match, extent)
        ready = lambda df: add(queries.attach(scope, scope.view.analyse(df)))
        ops = spec.get("ops") or {}
        metrics = {n: values.metric(o, scope.expressions(F.col("_score_"))) for n, o in ops.items() if isinstance(o, str)}
        own = ready(rows)
        frame = facets.counted(own, parents, name, facets.counter(scope, spec, self.spec.get("collapse")), metrics, kind, spec, known)
        missing = None
        if spec.get("missing"):
            field = scope.view.field(spec["field"], "value")
            c = F.col(field.source)
            empty = F.coalesce(F.size(c) == 0, F.lit(True)) if field.multi else c.isNull()
            missing = lambda: rows.where(empty).count()
        out = Facet(frame, name, parents, missing)
        deeper = {n: o for n, o in ops.items() if not isinstance(o, str)}
        if deeper:
            cols = (*parents, name)
            kept = frame.select(*cols)
            within = lambda df: df.join(kept, list(cols), "left_semi")
            for n, o in deeper.items():
                out.inner[n] = self.op(n, o, within(own), cols, lambda df: within(ready(keyed(df))))
        return out


def _kind(scope: Scope, name: str) -> str:
    try:
        return scope.view.field(name).type
    except RequestError:
        return ""


def _listed(x: Any) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def _named(q: Any, name: str) -> tuple[str, dict]:
    """(path, query on the children) of the clause of that name."""
    if isinstance(q, Mapping):
        if q.get("name") == name:
            arm = next(k for k in q if k != "name")
            spec = q[arm]
            if arm == "to_parent":
                return spec["path"], spec["query"]
            path, _, leaf = spec["field"].rpartition(".")
            return path, {arm: {**spec, "field": leaf}}
        for v in q.values():
            for x in v if isinstance(v, list) else [v]:
                try:
                    return _named(x, name)
                except RequestError:
                    continue
    raise RequestError("unknown_clause", f"no clause is named {name}")


def fuse(scope: Scope, spec: Mapping[str, Any], domain: DataFrame | None = None) -> Result:
    """Lists merged by reciprocal ranks, or by scores scaled to 0..1; ranks are over each list's page, which its limit bounds."""
    only(spec, "sources weights rrf linear limit offset fields collapse ops count_limit get_scores", "fusion")
    if ("rrf" in spec) == ("linear" in spec):
        raise RequestError("bad_fusion", "fusion is either rrf or linear")
    parts = []
    for name, source in spec["sources"].items():
        weight = float((spec.get("weights") or {}).get(name, 1.0))
        if weight == 0:
            continue
        inner = List(Scope(scope.view, {**scope.options, "joins": {}}), source, domain)
        page = inner.page
        if "rrf" in spec:
            by = Window.orderBy(*orders(inner.scope, source.get("sort")))
            made = F.lit(weight) / (F.lit(float((spec["rrf"] or {}).get("k", 60))) + F.row_number().over(by))
        else:
            whole = Window.partitionBy(F.lit(0))
            s = F.when(F.isnan("_score_"), F.lit(None)).otherwise(F.col("_score_"))
            bounded = F.when(F.abs(s) < math.inf, s)
            low, high = F.min(bounded).over(whole), F.max(bounded).over(whole)
            scaled = F.when(s == math.inf, 1.0).when(s == -math.inf, 0.0).when(s.isNull(), 0.0).when(high == low, 1.0).otherwise((s - low) / (high - low))
            made = scaled * weight
        parts.append(page.select(F.col("_owner_").alias("_f"), made.alias("_part_")))
    if not parts:
        raise RequestError("bad_fusion", "no source has a weight")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("_f").agg(F.sum("_part_").alias("_fused_"))
    base = scope.view.base
    rows = base.join(fused, F.col("_owner_") == F.col("_f")).drop("_f").withColumnRenamed("_fused_", "_score_")
    inner = List(Scope(scope.view, {**scope.options, "joins": {}}), {k: spec[k] for k in ("limit", "offset", "fields", "collapse", "ops", "count_limit") if k in spec} | {"get_scores": True})
    inner.rows = lambda op="", query=True: rows
    return inner.result()


def search(collection: Collection, request: Mapping[str, Any]) -> Result:
    """Runs nothing but pre-passes; the frames of the result are lazy."""
    options = {k: request[k] for k in ("time_zone", "vars", "exact_norms", "now") if k in request}
    if isinstance(options.get("now"), str):
        from ..functions import dates

        options["now"] = dates.window(options["now"], 0)[0]
    options["flags"] = {f: request[f] for f in FLAGS if f in request}
    scope = Scope(collection.view(), options)
    ops = request.get("ops")
    if ops is not None and not (set(request) & set("query filter sort limit collapse fields diversify".split())):
        own = List(scope, {})
        out = Result(warnings=scope.warnings)
        for name, op in ops.items():
            kind = next(iter(k for k in op if k != "domain"), "") if isinstance(op, Mapping) else ""
            if kind == "fusion":
                out.ops[name] = fuse(scope, op["fusion"])
            elif isinstance(op, str):
                out.ops |= own.ops({name: op})
            else:
                out.ops[name] = own.op(name, op, own.rows(), (), lambda df: df)
        return out
    return List(scope, request).result()

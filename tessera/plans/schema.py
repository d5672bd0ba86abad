"""Field types, suffix templates and variants: from a field's name to the column and analysis that serve it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import RequestError

NUMERIC = ("int", "float", "double", "decimal", "date", "boolean")
RANGES = ("long_range", "double_range", "date_range")


@dataclass(frozen=True)
class Field:
    """One representation of a value.

    `multi` is None, "set" (sorted, without repeats) or "array" (in source order). `analyzer` names a chain for texts.
    """

    name: str
    type: str
    multi: str | None = None
    analyzer: str | tuple = "standard"
    column: str = ""
    variants: Mapping[str, Field] = field(default_factory=dict)
    search: str = "self"
    value: str = "self"
    metric: str = "l2"
    dims: int = 0
    truncate_dims: int = 0
    scale: int = 0
    norms: bool = True
    normalizer: tuple = ()

    @property
    def source(self) -> str:
        return self.column or self.name


#: Suffix: (type, multi, analyzer). Fixed names of the data model.
SUFFIXES: dict[str, tuple[str, str | None, str]] = {
    "s": ("string", None, ""),
    "ss": ("string", "set", ""),
    "sc": ("string", None, ""),
    "ssc": ("string", "set", ""),
    "i": ("int", None, ""),
    "is": ("int", "set", ""),
    "f": ("float", None, ""),
    "fs": ("float", "set", ""),
    "d": ("double", None, ""),
    "ds": ("double", "set", ""),
    "b": ("boolean", None, ""),
    "bs": ("boolean", "set", ""),
    "ip": ("ip", None, ""),
    "ips": ("ip", "set", ""),
    "dt": ("date", None, ""),
    "dts": ("date", "set", ""),
    "p": ("geo_point", None, ""),
    "ps": ("geo_point", "array", ""),
    "w": ("text", None, "whitespace"),
    "wl": ("text", None, "whitespace_lower"),
    "u": ("text", None, "words"),
    "un": ("text", None, "standard"),
    "t": ("text", None, "english"),
    "v": ("vector", None, ""),
    "vs": ("vector", "array", ""),
    "nested": ("nested", "array", ""),
}


def from_suffix(name: str) -> Field | None:
    """The field that a suffix template makes of a name; `_name` is a text with a whole-value variant."""
    suffix = name.rpartition("_")[2]
    if suffix in ("name", "names"):
        multi = "array" if suffix == "names" else None
        return Field(name, "text", multi, "standard", variants={"s": Field(f"{name}__s", "string", "set" if multi else None, column=name)}, value="s")
    if suffix in SUFFIXES and "_" in name:
        kind, multi, analyzer = SUFFIXES[suffix]
        return Field(name, kind, multi, analyzer or "standard")
    return None


def of_type(name: str, kind: T.DataType) -> Field | None:
    """A field for a plain column, by its Spark type."""
    multi = None
    if isinstance(kind, T.ArrayType):
        kind, multi = kind.elementType, "array"
        if isinstance(kind, T.StructType):
            return Field(name, "geo_point" if {"lat", "lon"} == set(kind.names) else "nested", "array")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return Field(name, "vector")
        multi = "set"
    if isinstance(kind, T.StructType):
        if {"lat", "lon"} <= set(kind.names):
            return Field(name, "geo_point", multi)
        if {"lo", "hi"} <= set(kind.names):
            return Field(name, {"bigint": "long_range", "int": "long_range"}.get(kind["lo"].dataType.simpleString(), "double_range"), multi)
        return None
    names = {T.StringType: "string", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.TimestampType: "date", T.TimestampNTZType: "date", T.DateType: "date", T.DecimalType: "decimal", T.BinaryType: "ip"}
    return Field(name, names[type(kind)], multi) if type(kind) in names else None


class Schema:
    """Explicit fields first, then suffix templates, then the column's own type."""

    def __init__(self, fields: Mapping[str, Field | str | Mapping] | None = None):
        self.fields: dict[str, Field] = {}
        for n, f in (fields or {}).items():
            self.fields[n] = self._made(n, f)

    def _made(self, name: str, spec: Field | str | Mapping) -> Field:
        if isinstance(spec, Field):
            return spec
        spec = {"type": spec} if isinstance(spec, str) else dict(spec)
        variants = {label: self._made(f"{name}__{label}", {"column": name, **({"type": v} if isinstance(v, str) else v)}) for label, v in spec.pop("variants", {}).items()}
        parent = self.fields[spec.pop("parent")] if "parent" in spec else Field(name, "string")
        kinds = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}
        try:
            return replace(parent, name=name, variants=variants or parent.variants, **kinds)
        except TypeError as e:
            raise RequestError("unknown_key", f"field {name}: {e}") from None

    def set(self, fields: Mapping[str, Field | str | Mapping], replace_all: bool = False) -> Schema:
        out = Schema()
        out.fields = {} if replace_all else dict(self.fields)
        for n, f in fields.items():
            out.fields[n] = out._made(n, f)
        return out

    def find(self, name: str, columns: T.StructType, use: str = "primary") -> Field:
        """`use`: search (text operations), value (facets, sorts, ranges, metrics) or primary."""
        base, _, label = name.partition("__")
        found = self.fields.get(name) or self.fields.get(base)
        if found is None:
            found = from_suffix(base) if base in columns.names else None
            if found is None and base in columns.names:
                found = of_type(base, columns[base].dataType)
        if found is None:
            raise RequestError("unknown_field", f"no field {name}")
        if label and name not in self.fields:
            if label == "self":
                return found
            if label not in found.variants:
                raise RequestError("unknown_field", f"{base} has no variant {label}")
            return found.variants[label]
        binding = {"search": found.search, "value": found.value}.get(use, "self")
        return found.variants[binding] if binding != "self" else found

    def names(self, columns: T.StructType) -> Sequence[str]:
        return [c for c in columns.names if not c.startswith("_")]

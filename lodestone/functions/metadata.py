"""Typed predicates on JSON metadata, from a specification ``{field: {operator: value}}``.

All fields and operators must hold. A field that is missing fails every operator, the negated ones too; one
that is present as JSON null is compared as null. Two modes:

* ``coercing``: text that parses as a number compares as one; other kinds compare by their text, a list
  being ``<list>``. Objects count as null.
* ``strict``: values compare within their own kind only; text compares as text, numbers as numbers.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "not_in", "contains", "starts_with", "ends_with", "is_true", "is_false")
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"
_EPSILON = 2.220446049250313e-16


class Field:
    """One field of a variant column, with its kind."""

    def __init__(self, meta: Column, name: str):
        self.value = F.try_variant_get(meta, f'$["{name}"]' if not name.isidentifier() else f"$.{name}", "variant")
        schema = F.schema_of_variant(self.value)
        self.exists = self.value.isNotNull()
        self.is_list = schema.startswith("ARRAY")
        self.is_null = (schema == "VOID") | schema.startswith("OBJECT")
        self.is_bool = schema == "BOOLEAN"
        self.is_text = schema == "STRING"
        self.is_number = self.exists & ~(self.is_list | self.is_null | self.is_bool | self.is_text)
        self.raw = F.try_variant_get(self.value, "$", "string")
        self.text = F.when(self.is_list, "<list>").when(self.is_null, "null").otherwise(self.raw)
        self.number = F.when(self.is_number, F.try_variant_get(self.value, "$", "double")).when(self.is_text & self.raw.rlike(_NUMBER), self.raw.try_cast("double"))
        self.truth = F.when(self.is_bool, self.raw == "true").when(self.is_text, self.raw != "").when(self.is_number, self.number != 0).when(self.is_list, F.size(F.try_variant_get(self.value, "$", "array<variant>")) > 0).otherwise(F.lit(False))


def _text(x: Any) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else "<list>" if isinstance(x, (list, tuple, set)) else repr(x) if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)


def _number(x: Any) -> float | None:
    if isinstance(x, bool) or x is None or isinstance(x, (list, tuple, set, dict)):
        return None
    try:
        return float(x) if not isinstance(x, str) or x == x.strip() else None
    except ValueError:
        return None


def _equal(f: Field, x: Any, strict: bool) -> Column:
    if x is None:
        return f.is_null
    if isinstance(x, bool):
        return f.is_bool & (f.raw == _text(x))
    if isinstance(x, (list, tuple, set)):
        return F.lit(False)
    n = _number(x)
    if isinstance(x, str):
        same = f.is_text & (f.raw == x)
        return same if strict or n is None else same | (f.is_number & (F.abs(f.number - F.lit(n)) < _EPSILON))
    near = F.abs(f.number - F.lit(n)) < _EPSILON
    return f.is_number & near if strict else near


def _less(f: Field, x: Any, strict: bool, turned: bool = False) -> Column:
    n = _number(x)
    below = (lambda a, b: a > b) if turned else (lambda a, b: a < b)
    if strict:
        if isinstance(x, str):
            return f.is_text & below(f.raw, F.lit(x))
        return f.is_number & below(f.number, F.lit(n)) if n is not None else F.lit(False)
    by_text = below(f.text, F.lit(_text(x)))
    return by_text if n is None else F.when(f.number.isNotNull(), below(f.number, F.lit(n))).otherwise(by_text)


def _one(f: Field, op: str, x: Any, strict: bool) -> Column:
    text = f.text if not strict else F.when(f.is_list, F.to_json(f.value)).otherwise(f.text)
    if op == "==":
        return _equal(f, x, strict)
    if op == "!=":
        return ~F.coalesce(_equal(f, x, strict), F.lit(False))
    if op in ("<", "<="):
        low = _less(f, x, strict)
        return low if op == "<" else F.coalesce(low, F.lit(False)) | F.coalesce(_equal(f, x, strict), F.lit(False))
    if op in (">", ">="):
        high = _less(f, x, strict, True)
        return high if op == ">" else F.coalesce(high, F.lit(False)) | F.coalesce(_equal(f, x, strict), F.lit(False))
    if op in ("in", "not_in"):
        if not isinstance(x, (list, tuple, set)):
            return F.lit(op == "not_in" and not strict)
        found = F.lit(False)
        for one in x:
            found = found | F.coalesce(_equal(f, one, strict), F.lit(False))
        return found if op == "in" else ~found
    if op == "contains":
        return F.contains(text, F.lit(_text(x)))
    if op == "starts_with":
        return F.startswith(text, F.lit(_text(x)))
    if op == "ends_with":
        return F.endswith(text, F.lit(_text(x)))
    if op == "is_true":
        return f.truth
    if op == "is_false":
        return ~f.truth
    if strict:
        return F.lit(False)
    raise ValueError(f"operator {op!r} is none of {', '.join(OPERATORS)}")


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "byte", "short", "integer", "long")


def _native(c: Column, kind: str, op: str, x: Any, strict: bool) -> Column | None:
    """The operator on a column as it is, so that it can be pushed into a scan; None where only the variant's rules say what it means."""
    n = _number(x) if not (strict and isinstance(x, str)) else None
    many = isinstance(x, (list, tuple, set))
    if kind in _NUMBERS and kind not in ("float", "double") and n is not None and n == int(n):
        n = int(n)
    if op in ("in", "not_in") and many and x:
        parts = [_native(c, kind, "==", v, strict) for v in x]
        if any(p is None for p in parts):
            return None
        values = [_number(v) if kind in _NUMBERS else v for v in x]
        found = c.isin([int(v) if kind not in ("float", "double", "string") and v == int(v) else v for v in values])
        return found if op == "in" else c.isNull() | ~found
    whole = kind in _NUMBERS and kind not in ("float", "double") and n is not None and not isinstance(x, bool)
    words = kind == "string" and isinstance(x, str) and (strict or _number(x) is None)
    if not (whole or words):
        return None
    value = F.lit(n if whole else x)
    if op in ("==", "!="):
        return c == value if op == "==" else c.isNull() | (c != value)
    if op in ("<", "<=", ">", ">="):
        found = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        # a null has the text "null"
        return found if strict or not ("null" < _text(x) if op[0] == "<" else "null" > _text(x)) else found | c.isNull()
    if op in ("contains", "starts_with", "ends_with") and words and x not in "null":
        return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op](c, value)
    return None


def projected(meta: Column, fields: list[str] | None = None) -> Column:
    """Metadata for display: a map from the given fields to their text, absent ones left out; all of it as one JSON text if no fields are given."""
    if fields is None:
        return F.to_json(meta)
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), F.try_variant_get(meta, f'$["{f}"]' if not f.isidentifier() else f"$.{f}", "string").alias("v")) for f in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def predicate(meta: Column, spec: dict[str, dict[str, Any]], mode: str = "coercing", top_level: dict[str, Column | tuple[Column, str]] | None = None) -> Column:
    """The specification as one boolean column over a variant column; ``top_level`` columns come before metadata of that name.

    Such a column is given with its type, as ``(column, "bigint")``, to be compared as it is where that means the same: then scans can use the filter.
    """
    if mode not in ("coercing", "strict"):
        raise ValueError(f"mode {mode!r} is neither coercing nor strict")
    out = F.lit(True)
    for name, ops in spec.items():
        column = meta
        if top_level and name in top_level:
            own, kind = top_level[name] if isinstance(top_level[name], tuple) else (top_level[name], "")
            native = {op: _native(own, kind, op, x, mode == "strict") for op, x in ops.items()}
            for c in native.values():
                out = out if c is None else out & c
            ops = {op: x for op, x in ops.items() if native[op] is None}
            column, name = F.to_variant_object(F.struct(own.alias("x"))), "x"
            if not ops:
                continue
        f = Field(column, name)
        for op, x in ops.items():
            out = out & f.exists & F.coalesce(_one(f, op, x, mode == "strict"), F.lit(False))
    return out

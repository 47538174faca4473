"""Predicates over index rows, compiled to two-valued boolean columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.plans.project import null_mark, present, words
from tessera.plans.schema import Capability, Field, FieldType, IndexSpec, QueryError

#: Most values of an IN list.
MOST_VALUES = 64


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return And((self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Or((self, other))

    def __invert__(self) -> "Predicate":
        return Not(self)


@dataclass(frozen=True)
class All(Predicate):
    """Every row."""


@dataclass(frozen=True)
class Equal(Predicate):
    field: str
    value: object


@dataclass(frozen=True)
class In(Predicate):
    field: str
    values: tuple


@dataclass(frozen=True)
class Prefix(Predicate):
    field: str
    prefix: str


@dataclass(frozen=True)
class Compare(Predicate):
    """op: one of <, <=, >, >=."""

    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Range(Predicate):
    """Both bounds on the same element."""

    field: str
    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = True


@dataclass(frozen=True)
class Exists(Predicate):
    field: str


@dataclass(frozen=True)
class FullText(Predicate):
    """Every token of the text stands in the field."""

    field: str
    text: str


@dataclass(frozen=True)
class Phrase(Predicate):
    """The tokens stand next to each other, in order, within one value."""

    field: str
    text: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def coerce(f: Field, value: object) -> object:
    """A literal of the field's type, without loss."""
    t = f.type
    wrong = QueryError(f"{value!r} is no {t.value} for field {f.name}")
    if t is FieldType.BOOLEAN:
        if not isinstance(value, bool):
            raise wrong
        return value
    if t in (FieldType.KEYWORD, FieldType.TEXT):
        if not isinstance(value, str):
            raise wrong
        return value
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        raise wrong
    if t is FieldType.FLOAT:
        out = float(value)
        if not math.isfinite(out) or isinstance(value, int) and int(out) != value:
            raise wrong
        return out + 0.0
    if not isinstance(value, int):
        raise wrong
    low, high = (-(1 << 63), (1 << 63) - 1) if t is FieldType.SIGNED else (0, (1 << 64) - 1)
    if not low <= value <= high:
        raise wrong
    return value if t is FieldType.SIGNED else Decimal(value)


def decode_literal(f: Field, text: str) -> object:
    """A literal given as a canonical JSON scalar; null is None."""
    value = json.loads(text)
    if isinstance(value, dict | list) or json.dumps(value, ensure_ascii=False) != text.strip() and not isinstance(value, float):
        raise QueryError(f"not a canonical JSON scalar: {text}")
    return None if value is None else coerce(f, value)


def _need(f: Field, capability: Capability) -> None:
    if not f.can(capability):
        raise QueryError(f"field {f.name} wasn't declared {capability.value}")


def _lit(f: Field, value: object) -> Column:
    return F.lit(coerce(f, value)).cast(f.type.spark)


def _element(f: Field, test) -> Column:
    """Whether the value, or any of them, passes."""
    return F.exists(f.name, test) if f.multi else test(F.col(f.name))


def _equal(f: Field, value: object) -> Column:
    if value is None:
        if not f.allow_null:
            raise QueryError(f"field {f.name} never holds null")
        return F.col(null_mark(f.name)) if f.multi else F.col(present(f.name)) & F.col(f.name).isNull()
    return F.array_contains(f.name, _lit(f, value)) if f.multi else F.col(f.name) == _lit(f, value)


def compile_predicate(p: Predicate, spec: IndexSpec) -> Column:
    """A boolean column that is never null, so that NOT is the complement."""
    return F.coalesce(_compile(p, spec), F.lit(False))


def _compile(p: Predicate, spec: IndexSpec) -> Column:
    if isinstance(p, All):
        return F.lit(True)
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (_compile(x, spec) for x in p.parts), F.lit(True))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (compile_predicate(x, spec) for x in p.parts), F.lit(False))
    if isinstance(p, Not):
        return ~compile_predicate(p.part, spec)
    f = spec.field(p.field)
    if isinstance(p, Equal):
        _need(f, Capability.EXACT)
        return _equal(f, p.value)
    if isinstance(p, In):
        _need(f, Capability.EXACT)
        if not 1 <= len(p.values) <= MOST_VALUES:
            raise QueryError(f"IN takes 1 to {MOST_VALUES} values")
        some = [v for v in p.values if v is not None]
        out = _equal(f, None) if len(some) < len(p.values) else F.lit(False)
        if some:
            out = out | (F.arrays_overlap(f.name, F.array(*[_lit(f, v) for v in some])) if f.multi else F.col(f.name).isin(*[coerce(f, v) for v in some]))
        return out
    if isinstance(p, Prefix):
        _need(f, Capability.PREFIX)
        if not p.prefix:
            raise QueryError("a prefix has a character at least")
        return _element(f, lambda x: x.startswith(p.prefix))
    if isinstance(p, Compare):
        _need(f, Capability.RANGE)
        if p.value is None or p.op not in _OPS:
            raise QueryError(f"bad bound {p.op} {p.value!r}")
        return _element(f, lambda x: _OPS[p.op](x, _lit(f, p.value)))
    if isinstance(p, Range):
        _need(f, Capability.RANGE)
        if p.low is None and p.high is None:
            raise QueryError("a range has a bound at least")

        def inside(x: Column) -> Column:
            out = F.lit(True)
            if p.low is not None:
                out = out & _OPS[">" if p.low_open else ">="](x, _lit(f, p.low))
            return out if p.high is None else out & _OPS["<" if p.high_open else "<="](x, _lit(f, p.high))

        return _element(f, inside)
    if isinstance(p, Exists):
        return F.col(present(f.name))
    if isinstance(p, FullText | Phrase):
        _need(f, Capability.FULL_TEXT)
        wanted = analysis.query_tokens(p.text)
        if not wanted:
            raise QueryError("the text holds no token")
        maybe = F.lit(True) if f.multi else analysis.may_hold(F.col(f.name), wanted)
        if isinstance(p, Phrase):
            return maybe & F.exists(words(f.name), lambda w: analysis.has_phrase(w, wanted))
        return maybe & analysis.has_all(F.flatten(words(f.name)), wanted)
    raise QueryError(f"unknown predicate {p!r}")

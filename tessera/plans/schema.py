"""Declared index schemas: field types, capabilities, the eight index kinds, and their validation.

Nothing is inferred. A capability that was not declared is not there, capabilities never imply one another, and an
illegal combination is an error when the definition is made, before any data is read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import Column

NAME_BYTES = 4096
#: Name of the path segment that no index ever shows.
SYSTEM_SEGMENT = "_system"


class DefinitionError(ValueError):
    """The definition, or data under it, breaks the declared schema."""


class QueryError(ValueError):
    """The query doesn't fit the definition."""


class FieldType(Enum):
    BOOLEAN = "boolean"
    SIGNED = "signed"
    UNSIGNED = "unsigned"
    FLOAT = "float"
    KEYWORD = "keyword"
    TEXT = "text"

    @property
    def spark(self) -> str:
        return {"boolean": "boolean", "signed": "long", "unsigned": "decimal(20,0)", "float": "double"}.get(self.value, "string")


class Capability(Enum):
    EXACT = "exact"
    PREFIX = "prefix"
    RANGE = "range"
    ORDER = "order"
    FACET = "facet"
    AGGREGATE = "aggregate"
    FULL_TEXT = "full_text"


_C = Capability
_NUMBER = frozenset({_C.EXACT, _C.RANGE, _C.ORDER, _C.FACET, _C.AGGREGATE})
LEGAL: dict[FieldType, frozenset[Capability]] = {
    FieldType.BOOLEAN: frozenset({_C.EXACT, _C.FACET}),
    FieldType.SIGNED: _NUMBER,
    FieldType.UNSIGNED: _NUMBER,
    FieldType.FLOAT: _NUMBER,
    FieldType.KEYWORD: frozenset({_C.EXACT, _C.PREFIX, _C.RANGE, _C.ORDER, _C.FACET}),
    FieldType.TEXT: frozenset({_C.FULL_TEXT}),
}


class Expr(str):
    """A SQL expression over the source table, as a field's source."""


@dataclass(frozen=True)
class Field:
    """A typed field. source: a JSON pointer into the payload, or an Expr or Column over the source table."""

    name: str
    type: FieldType
    capabilities: tuple[Capability, ...]
    source: str | Column | None = None
    multi: bool = False
    allow_missing: bool = True
    allow_null: bool = True

    def __post_init__(self) -> None:
        if not self.name or "\0" in self.name or len(self.name.encode()) > NAME_BYTES:
            raise DefinitionError(f"bad field name {self.name!r}")
        if not self.capabilities or len(set(self.capabilities)) != len(self.capabilities):
            raise DefinitionError(f"{self.name}: capabilities must be given, each once")
        if wrong := set(self.capabilities) - LEGAL[self.type]:
            raise DefinitionError(f"{self.name}: {self.type.value} can't have {sorted(c.value for c in wrong)}")
        if self.multi and _C.ORDER in self.capabilities:
            raise DefinitionError(f"{self.name}: only a single-valued field can be ordered by")

    def can(self, capability: Capability) -> bool:
        return capability in self.capabilities


def keyword(name: str, *capabilities: Capability, **more) -> Field:
    return Field(name, FieldType.KEYWORD, capabilities, **more)


def signed(name: str, *capabilities: Capability, **more) -> Field:
    return Field(name, FieldType.SIGNED, capabilities, **more)


def unsigned(name: str, *capabilities: Capability, **more) -> Field:
    return Field(name, FieldType.UNSIGNED, capabilities, **more)


def double(name: str, *capabilities: Capability, **more) -> Field:
    return Field(name, FieldType.FLOAT, capabilities, **more)


def boolean(name: str, *capabilities: Capability, **more) -> Field:
    return Field(name, FieldType.BOOLEAN, capabilities, **more)


def text(name: str, **more) -> Field:
    return Field(name, FieldType.TEXT, (Capability.FULL_TEXT,), **more)


@dataclass(frozen=True)
class Scope:
    """What an index looks at: a segment-aware path prefix and, if given, one exact content type."""

    prefix: str = ""
    content_type: str | None = None


@dataclass(frozen=True)
class IndexSpec:
    """Common part of the kinds; ``fields`` are the queryable ones."""

    name: str
    scope: Scope = field(default_factory=Scope)

    @property
    def kind(self) -> str:
        return type(self).__name__.removesuffix("Index").lower()

    @property
    def fields(self) -> tuple[Field, ...]:
        return ()

    @property
    def default_order(self) -> tuple[tuple[str, bool], ...]:
        """(field, descending) where the query names no order."""
        return ()

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise QueryError(f"index {self.name} has no field {name!r}")

    def validate(self) -> "IndexSpec":
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise DefinitionError(f"{self.name}: field names must differ")
        return self

    def fingerprint(self) -> str:
        """Changes with every setting that can change a result."""
        plain = asdict(self) | {"kind": self.kind, "fields": [asdict(f) for f in self.fields]}
        return hashlib.sha256(json.dumps(plain, sort_keys=True, default=lambda x: x.value if isinstance(x, Enum) else str(x)).encode()).hexdigest()


@dataclass(frozen=True)
class PathIndex(IndexSpec):
    @property
    def fields(self):
        return (keyword("path", _C.EXACT, _C.PREFIX, _C.ORDER),)

    @property
    def default_order(self):
        return (("path", False),)


#: Metadata fields and what each can do.
METADATA = {
    "path": keyword("path", _C.EXACT, _C.PREFIX, _C.RANGE, _C.ORDER),
    "version": unsigned("version", _C.EXACT, _C.RANGE, _C.ORDER),
    "content_type": keyword("content_type", _C.EXACT, _C.PREFIX, _C.ORDER, _C.FACET),
    "content_length": unsigned("content_length", _C.EXACT, _C.RANGE, _C.ORDER, _C.FACET, _C.AGGREGATE),
    "content_hash": keyword("content_hash", _C.EXACT),
    "committed_at_unix_millis": unsigned("committed_at_unix_millis", _C.EXACT, _C.RANGE, _C.ORDER),
}


@dataclass(frozen=True)
class MetadataIndex(IndexSpec):
    names: tuple[str, ...] = tuple(METADATA)

    @property
    def fields(self):
        if wrong := set(self.names) - METADATA.keys():
            raise DefinitionError(f"no such metadata: {sorted(wrong)}")
        return tuple(METADATA[n] for n in self.names)


@dataclass(frozen=True)
class TypedJsonIndex(IndexSpec):
    declared: tuple[Field, ...] = ()
    physical_order: tuple[tuple[str, bool], ...] = ()

    @property
    def fields(self):
        return self.declared

    @property
    def default_order(self):
        return self.physical_order

    def validate(self):
        super().validate()
        if not self.declared:
            raise DefinitionError(f"{self.name}: a typed index needs a field")
        if len({n for n, _ in self.physical_order}) != len(self.physical_order):
            raise DefinitionError(f"{self.name}: order fields must differ")
        for n, _ in self.physical_order:
            if not self.field(n).can(_C.ORDER):
                raise DefinitionError(f"{self.name}: {n} can't be ordered by")
        return self


@dataclass(frozen=True)
class FullTextIndex(IndexSpec):
    declared: tuple[Field, ...] = ()
    k1: float = 1.2
    b: float = 0.75

    @property
    def fields(self):
        return self.declared

    def validate(self):
        super().validate()
        if not self.declared or any(f.type is not FieldType.TEXT for f in self.declared):
            raise DefinitionError(f"{self.name}: a full-text index has text fields only")
        if not (self.k1 >= 0 and 0 <= self.b <= 1):
            raise DefinitionError(f"{self.name}: k1 must be at least 0 and b within [0, 1]")
        return self


class Metric(Enum):
    COSINE = "cosine"
    DOT = "dot"
    EUCLID = "euclid"


@dataclass(frozen=True)
class VectorIndex(IndexSpec):
    source: str | Column = "/embedding"
    dims: int = 0
    metric: Metric = Metric.COSINE
    normalize: bool = False

    def validate(self):
        super().validate()
        if self.dims <= 0:
            raise DefinitionError(f"{self.name}: a vector has at least one dimension")
        return self


@dataclass(frozen=True)
class HybridIndex(VectorIndex):
    declared: tuple[Field, ...] = ()
    text_weight: float = 0.0
    vector_weight: float = 0.0
    k1: float = 1.2
    b: float = 0.75

    @property
    def fields(self):
        return self.declared

    @property
    def weights(self) -> tuple[float, float]:
        """A weight of 0 means the default, 1."""
        return self.text_weight or 1.0, self.vector_weight or 1.0

    def validate(self):
        super().validate()
        if not self.declared or any(f.type is not FieldType.TEXT for f in self.declared):
            raise DefinitionError(f"{self.name}: a hybrid index has text fields")
        if any(not 0 <= w < float("inf") for w in (self.text_weight, self.vector_weight)):
            raise DefinitionError(f"{self.name}: weights are finite and not negative")
        return self


@dataclass(frozen=True)
class GitIndex(IndexSpec):
    repository: str = ""

    @property
    def fields(self):
        return (keyword("repository_id", _C.EXACT), keyword("commit_id", _C.EXACT), keyword("tree_path", _C.EXACT, _C.PREFIX, _C.ORDER), keyword("object_id", _C.EXACT))

    @property
    def default_order(self):
        return (("tree_path", False),)


@dataclass(frozen=True)
class TensorIndex(IndexSpec):
    model: str = ""

    @property
    def fields(self):
        return (keyword("model_id", _C.EXACT), keyword("tensor_name", _C.EXACT, _C.ORDER))

    @property
    def default_order(self):
        return (("tensor_name", False),)

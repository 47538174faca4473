"""Ordering with three-state cells, keyset pagination, and signed page tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.plans.project import IDENTITY, present
from tessera.plans.schema import Capability, IndexSpec, QueryError


@dataclass(frozen=True)
class Key:
    """One column to order by. Ascending: null, values, missing; descending: missing, values, null."""

    column: str
    descending: bool = False
    state: str | None = None  # column that says if the cell is there

    def columns(self) -> list[Column]:
        c = F.col(self.column)
        value = c.desc_nulls_last() if self.descending else c.asc_nulls_first()
        if self.state is None:
            return [value]
        gone = ~F.col(self.state)
        return [gone.desc() if self.descending else gone.asc(), value]

    def after(self, row: dict) -> Column:
        """Strictly behind the row's cell."""
        c, v = F.col(self.column), row[self.column]
        if self.descending:
            behind = c.isNull() | (c < F.lit(v)) if v is not None else F.lit(False)
        else:
            behind = c > F.lit(v) if v is not None else c.isNotNull()
        behind = F.coalesce(behind, F.lit(False))
        if self.state is None:
            return behind
        there = F.col(self.state)
        if not row[self.state]:
            return there if self.descending else F.lit(False)
        return there & behind if self.descending else ~there | (there & behind)

    def same(self, row: dict) -> Column:
        out = F.col(self.column).eqNullSafe(F.lit(row[self.column]))
        return out if self.state is None else out & (F.col(self.state) == F.lit(bool(row[self.state])))


def keys(spec: IndexSpec, order: tuple[tuple[str, bool], ...]) -> list[Key]:
    """The wanted fields, then the identity, always ascending."""
    if len({n for n, _ in order}) != len(order):
        raise QueryError("a field is ordered by once")
    out = []
    for name, descending in order:
        f = spec.field(name)
        if not f.can(Capability.ORDER):
            raise QueryError(f"field {name} wasn't declared order")
        out.append(Key(name, descending, present(name)))
    return out + [Key(c) for c in IDENTITY]


def sort_columns(ks: list[Key]) -> list[Column]:
    return [c for k in ks for c in k.columns()]


def after(ks: list[Key], row: dict) -> Column:
    """Rows strictly behind the cursor in the whole composite order."""
    out, same = F.lit(False), F.lit(True)
    for k in ks:
        out = out | (same & k.after(row))
        same = same & k.same(row)
    return out


def page(rows: DataFrame, ks: list[Key], limit: int, cursor: dict | None = None) -> DataFrame:
    """A bounded top-k, which Spark runs as a heap in every task and one merge."""
    if cursor is not None:
        rows = rows.filter(after(ks, cursor))
    return rows.orderBy(*sort_columns(ks)).limit(limit)


def cursor_of(ks: list[Key], row: Row) -> dict:
    return {c: row[c] for k in ks for c in (k.column, k.state) if c}


def _plain(v: object) -> object:
    return {"decimal": str(v)} if isinstance(v, Decimal) else {"float": v.hex()} if isinstance(v, float) else v


def _typed(v: object) -> object:
    if isinstance(v, dict):
        return Decimal(v["decimal"]) if "decimal" in v else float.fromhex(v["float"])
    return v


@dataclass(frozen=True)
class Claims:
    """What a page token is bound to; all of it must be the same when it comes back."""

    tenant: str
    subject: str
    index: str
    fingerprint: str
    generation: int
    query: str
    revision: int


def query_hash(query: object) -> str:
    return hashlib.sha256(repr(query).encode()).hexdigest()


def seal(cursor: dict, claims: Claims, secret: bytes) -> str:
    body = json.dumps({"v": 1, "cursor": {k: _plain(v) for k, v in cursor.items()}, "claims": asdict(claims)}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def unseal(token: str, claims: Claims, secret: bytes) -> dict:
    try:
        raw = base64.urlsafe_b64decode(token.encode())
        mac, body = raw[:32], raw[32:]
        if not hmac.compare_digest(mac, hmac.new(secret, body, hashlib.sha256).digest()):
            raise ValueError("signature")
        found = json.loads(body)
        if found["v"] != 1 or found["claims"] != asdict(claims):
            raise ValueError("claims")
        return {k: _typed(v) for k, v in found["cursor"].items()}
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError("the page token is not valid for this query") from e

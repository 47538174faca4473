"""Index definitions: create, update (by version), get, list, delete, rebuild and query, persisted as JSON."""

from __future__ import annotations

import dataclasses
import json
import time
from enum import Enum
from pathlib import Path

from tessera.plans import schema as S

KINDS = {c.__name__: c for c in (S.PathIndex, S.MetadataIndex, S.TypedJsonIndex, S.FullTextIndex, S.VectorIndex, S.HybridIndex, S.GitIndex, S.TensorIndex)}
REBUILD_SECONDS = 3600


def to_json(spec: S.IndexSpec) -> dict:
    """A definition as plain JSON; Column sources can't be persisted."""

    def plain(x):
        if isinstance(x, Enum):
            return x.value
        if isinstance(x, S.Field | S.Scope):
            return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        if isinstance(x, tuple | list):
            return [plain(y) for y in x]
        if isinstance(x, S.Expr):
            return {"expr": str(x)}
        if x is None or isinstance(x, str | int | float | bool):
            return x
        raise S.DefinitionError("only JSON pointers and expressions can be persisted as sources")

    return {"kind": type(spec).__name__} | {f.name: plain(getattr(spec, f.name)) for f in dataclasses.fields(spec)}


def _source(x):
    return S.Expr(x["expr"]) if isinstance(x, dict) else x


def from_json(d: dict) -> S.IndexSpec:
    kind = KINDS[d["kind"]]
    more = {k: v for k, v in d.items() if k != "kind"}
    more["scope"] = S.Scope(**more["scope"])
    if "declared" in more:
        more["declared"] = tuple(S.Field(**f | {"source": _source(f["source"]), "type": S.FieldType(f["type"]), "capabilities": tuple(map(S.Capability, f["capabilities"]))}) for f in more["declared"])
    if "source" in more:
        more["source"] = _source(more["source"])
    if "physical_order" in more:
        more["physical_order"] = tuple(map(tuple, more["physical_order"]))
    if "metric" in more:
        more["metric"] = S.Metric(more["metric"])
    if "names" in more:
        more["names"] = tuple(more["names"])
    return kind(**more).validate()


class Catalog:
    """Definitions of one bucket, in one JSON file of the driver."""

    def __init__(self, file: str):
        self.file = Path(file)

    def _load(self) -> dict:
        return json.loads(self.file.read_text()) if self.file.exists() else {}

    def _store(self, all_: dict) -> None:
        draft = self.file.with_suffix(".draft")
        draft.write_text(json.dumps(all_, sort_keys=True))
        draft.rename(self.file)

    def create(self, spec: S.IndexSpec) -> int:
        found = self._load()
        if spec.name in found:
            raise S.DefinitionError(f"{spec.name} is there already")
        found[spec.name] = {"version": 1, "spec": to_json(spec.validate()), "rebuilt": 0}
        self._store(found)
        return 1

    def update(self, spec: S.IndexSpec, version: int) -> int:
        found = self._load()
        if spec.name not in found or found[spec.name]["version"] != version:
            raise S.DefinitionError(f"{spec.name} isn't at version {version}")
        found[spec.name] |= {"version": version + 1, "spec": to_json(spec.validate())}
        self._store(found)
        return version + 1

    def get(self, name: str) -> tuple[S.IndexSpec, int]:
        found = self._load()
        if name not in found:
            raise S.QueryError(f"no index {name!r}")
        return from_json(found[name]["spec"]), found[name]["version"]

    def list(self, after: str = "", limit: int = 100) -> list[str]:
        return [n for n in sorted(self._load()) if n > after][:limit]

    def delete(self, name: str, version: int) -> None:
        found = self._load()
        if name not in found or found[name]["version"] != version:
            raise S.DefinitionError(f"{name} isn't at version {version}")
        del found[name]
        self._store(found)

    def rebuild(self, name: str, build) -> object:
        """Run ``build(spec)``; at most once an hour."""
        found = self._load()
        spec, _ = self.get(name)
        if time.time() - found[name]["rebuilt"] < REBUILD_SECONDS:
            raise S.QueryError(f"{name} was rebuilt less than an hour ago")
        out = build(spec)
        found[name]["rebuilt"] = time.time()
        self._store(found)
        return out

    def query(self, name: str, kind: str, run) -> object:
        """Run ``run(spec)`` if the index is of the kind that the query is for."""
        spec, _ = self.get(name)
        if spec.kind != kind:
            raise S.QueryError(f"{name} is a {spec.kind} index")
        return run(spec)

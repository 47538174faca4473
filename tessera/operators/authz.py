"""Relation-tuple permissions: subjects reach objects through direct grants, usersets and parents.

Tuples are (namespace, object_id, relation, subject_namespace, subject_id, subject_relation); the last is empty for a
plain subject. A permission is a union of relations of the object (inherit) and of permissions of the objects that one
of its relations names (tuple to userset). ``expand`` answers for all objects at once by joins from the subjects on;
a pair that is known is never followed again, so cycles end, and ``Limits.depth`` rounds without an end are an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import written

TUPLE = "namespace string, object_id string, relation string, subject_namespace string, subject_id string, subject_relation string"
KEY = TUPLE.replace(" string", "").split(", ")
PUBLIC = ("public", "*", "")


class AuthzError(ValueError):
    """The schema is wrong, or a limit was passed: never a silent denial."""


@dataclass(frozen=True)
class Inherit:
    """All who have this relation or permission of the same object."""

    name: str


@dataclass(frozen=True)
class Through:
    """All who have ``permission`` of the objects that ``relation`` names."""

    relation: str
    permission: str


@dataclass(frozen=True)
class Namespace:
    """relations: for each, what its subjects may be: (namespace, "") any object, (namespace, relation) that userset of any
    object, ("public", "") everyone; with a third part only that object id, or with "=" only the id of the object itself."""

    relations: dict[str, list[tuple[str, ...]]]
    permissions: dict[str, list[Inherit | Through]] = field(default_factory=dict)


@dataclass(frozen=True)
class Limits:
    depth: int = 32
    steps: int = 16_384
    items: int = 256


@dataclass(frozen=True)
class AuthzSchema:
    namespaces: dict[str, Namespace]
    limits: Limits = Limits()

    def __post_init__(self) -> None:
        if len(self.namespaces) > self.limits.items:
            raise AuthzError("too many namespaces")
        for name, ns in self.namespaces.items():
            if len(ns.relations) + len(ns.permissions) > self.limits.items or ns.relations.keys() & ns.permissions.keys():
                raise AuthzError(f"{name}: too many names, or one used twice")
            for relation, subjects in ns.relations.items():
                for other, of, *_ in subjects:
                    known = self.namespaces.get(other)
                    if of and (known is None or of not in known.relations.keys() | known.permissions.keys()):
                        raise AuthzError(f"{name}.{relation}: no {other}#{of}")
            for permission, rules in ns.permissions.items():
                for rule in rules:
                    if isinstance(rule, Inherit) and rule.name not in ns.relations.keys() | ns.permissions.keys():
                        raise AuthzError(f"{name}.{permission}: no {rule.name}")
                    if isinstance(rule, Through):
                        targets = [self.namespaces.get(o) for o, *_ in ns.relations.get(rule.relation, [])]
                        if not any(t and rule.permission in t.relations.keys() | t.permissions.keys() for t in targets):
                            raise AuthzError(f"{name}.{permission}: nothing behind {rule.relation}->{rule.permission}")

    def allows(self, t: tuple) -> bool:
        """Whether a tuple may be written."""
        ns = self.namespaces.get(t[0])
        if ns is None or t[3] == PUBLIC[0] and t[4] != PUBLIC[1]:
            return False
        wanted = lambda only: not only or t[4] == (t[1] if only[0] == "=" else only[0])
        return any((other, of) == (t[3], t[5]) and wanted(only) for other, of, *only in ns.relations.get(t[2], []))


def check(schema: AuthzSchema, tuples: set[tuple], namespace: str, object_id: str, name: str, subject: tuple[str, str]) -> bool:
    """One question, depth first on the driver. A cycle denies on its path; too deep or too long is an error."""
    by_relation: dict[tuple, list[tuple]] = {}
    for t in tuples:
        by_relation.setdefault(t[:3], []).append(t[3:])
    steps = 0

    def ask(ns: str, oid: str, rel: str, path: tuple) -> bool:
        nonlocal steps
        steps += 1
        if len(path) > schema.limits.depth or steps > schema.limits.steps:
            raise AuthzError("permission check went too deep")
        if (ns, oid, rel) in path:
            return False
        path = (*path, (ns, oid, rel))
        for s_ns, s_id, s_rel in by_relation.get((ns, oid, rel), ()):
            if not s_rel and (s_ns, s_id) == subject or (s_ns, s_id, s_rel) == PUBLIC:
                return True
            if s_rel and ask(s_ns, s_id, s_rel, path):
                return True
        for rule in schema.namespaces[ns].permissions.get(rel, ()) if ns in schema.namespaces else ():
            if isinstance(rule, Inherit):
                if ask(ns, oid, rule.name, path):
                    return True
            elif any(not r and ask(n, i, rule.permission, path) for n, i, r in by_relation.get((ns, oid, rule.relation), ())):
                return True
        return False

    return ask(namespace, object_id, name, ())


def _rules(spark: SparkSession, schema: AuthzSchema) -> tuple[DataFrame, DataFrame]:
    inherit = [(n, r.name, p) for n, ns in schema.namespaces.items() for p, rules in ns.permissions.items() for r in rules if isinstance(r, Inherit)]
    through = [(n, r.relation, r.permission, p) for n, ns in schema.namespaces.items() for p, rules in ns.permissions.items() for r in rules if isinstance(r, Through)]
    return spark.createDataFrame(inherit, "namespace string, name string, gives string"), spark.createDataFrame(through, "namespace string, relation string, permission string, gives string")


def expand(schema: AuthzSchema, tuples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Everything that the subjects (subject_namespace, subject_id) have: (namespace, object_id, name, s_ns, s_id).

    What everyone has comes once, with the public subject: it joins as a subject of its own, since permissions are unions.
    """
    spark = tuples.sparkSession
    inherit, through = _rules(spark, schema)
    who = subjects.select(F.col("subject_namespace").alias("s_ns"), F.col("subject_id").alias("s_id"))
    who = who.union(spark.createDataFrame([PUBLIC[:2]], "s_ns string, s_id string")).distinct()
    plain = tuples.filter("subject_relation = ''")
    direct = plain.join(who, (F.col("subject_namespace") == F.col("s_ns")) & (F.col("subject_id") == F.col("s_id")))
    known = new = written(direct.select("namespace", "object_id", F.col("relation").alias("name"), "s_ns", "s_id").distinct())
    for _ in range(schema.limits.depth):
        f = new.alias("f")
        up = f.join(inherit.alias("r"), (F.col("f.namespace") == F.col("r.namespace")) & (F.col("f.name") == F.col("r.name"))).select("f.namespace", "f.object_id", F.col("r.gives").alias("name"), "f.s_ns", "f.s_id")
        sets = tuples.filter("subject_relation <> ''").alias("t")
        member = f.join(sets, (F.col("t.subject_namespace") == F.col("f.namespace")) & (F.col("t.subject_id") == F.col("f.object_id")) & (F.col("t.subject_relation") == F.col("f.name")))
        member = member.select("t.namespace", "t.object_id", F.col("t.relation").alias("name"), "f.s_ns", "f.s_id")
        parents = plain.alias("t").join(through.alias("r"), (F.col("t.namespace") == F.col("r.namespace")) & (F.col("t.relation") == F.col("r.relation")))
        child = f.join(parents, (F.col("t.subject_namespace") == F.col("f.namespace")) & (F.col("t.subject_id") == F.col("f.object_id")) & (F.col("r.permission") == F.col("f.name")))
        child = child.select("t.namespace", "t.object_id", F.col("r.gives").alias("name"), "f.s_ns", "f.s_id")
        fresh = up.union(member).union(child).distinct().join(known, ["namespace", "object_id", "name", "s_ns", "s_id"], "left_anti")
        fresh = written(fresh)
        if fresh.isEmpty():
            return known
        known, new = known.union(fresh), fresh
    raise AuthzError(f"permissions are not settled after {schema.limits.depth} rounds")


def check_many(schema: AuthzSchema, tuples: DataFrame, asked: DataFrame) -> DataFrame:
    """(ordinal, allowed) for questions (ordinal, namespace, object_id, name, subject_namespace, subject_id), in order."""
    have = written(expand(schema, tuples, asked))
    public = (F.col("s_ns") == PUBLIC[0]) & (F.col("s_id") == PUBLIC[1])
    key = ["namespace", "object_id", "name", "subject_namespace", "subject_id"]
    own = have.filter(~public).select("namespace", "object_id", "name", F.col("s_ns").alias("subject_namespace"), F.col("s_id").alias("subject_id"), F.lit(True).alias("_own"))
    everyone = have.filter(public).select("namespace", "object_id", "name", F.lit(True).alias("_all"))
    out = asked.join(own, key, "left").join(everyone, key[:3], "left")
    return out.select("ordinal", (F.coalesce("_own", F.lit(False)) | F.coalesce("_all", F.lit(False))).alias("allowed")).orderBy("ordinal")


def read_tuples(tuples: DataFrame, after: tuple | None = None, limit: int = 1000, **wanted: str) -> DataFrame:
    """Tuples by any of their columns, in key order behind a cursor."""
    out = tuples
    for c, v in wanted.items():
        out = out.filter(F.col(c) == v)
    if after is not None:
        out = out.filter(F.struct(*KEY) > F.struct(*[F.lit(x).alias(c) for c, x in zip(KEY, after)]))
    return out.orderBy(*KEY).limit(limit)


def mutate_tuples(schema: AuthzSchema, tuples: DataFrame, add: list[tuple], remove: list[tuple], revision: int, expected: int | None = None) -> tuple[DataFrame, int]:
    """All or nothing, and idempotent; the revision moves on."""
    if len(add) + len(remove) > 1000:
        raise AuthzError("at most 1000 tuples")
    if expected is not None and expected != revision:
        raise AuthzError(f"the revision is {revision}")
    if wrong := [t for t in add if not schema.allows(t)]:
        raise AuthzError(f"not allowed by the schema: {wrong[0]}")
    spark = tuples.sparkSession
    out = tuples.select(*KEY)
    if remove:
        out = out.join(F.broadcast(spark.createDataFrame(remove, TUPLE)), KEY, "left_anti")
    if add:
        out = out.union(spark.createDataFrame(add, TUPLE))
    return out.distinct(), revision + 1


class SchemaStore:
    """Schemas by name and revision, and which of them a bucket is bound to, as JSON files in a shared folder."""

    def __init__(self, where: str, spark: SparkSession):
        self.where, self.spark = where.rstrip("/"), spark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        """A file appears whole, by a rename that only one writer wins."""
        draft, target = self._path(f"{self.where}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.where}/{name}")
        out = self._fs.create(draft)
        out.write(text.encode())
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise AuthzError(f"{name} is there already")

    def _read(self, name: str) -> dict:
        if not self._fs.exists(self._path(f"{self.where}/{name}")):
            raise AuthzError(f"no {name}")
        return json.loads(self.spark.read.text(f"{self.where}/{name}", wholetext=True).first()[0])

    def _revisions(self, name: str) -> list[int]:
        at = self._path(f"{self.where}/{name}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def put(self, name: str, schema: AuthzSchema, expected: int) -> int:
        """A new revision, if the last one is the expected one (0: none)."""
        if (self._revisions(f"schemas/{name}") or [0])[-1] != expected:
            raise AuthzError(f"{name} isn't at revision {expected}")
        plain = lambda r: {"inherit": r.name} if isinstance(r, Inherit) else {"relation": r.relation, "permission": r.permission}
        body = {n: {"relations": ns.relations, "permissions": {p: [plain(r) for r in rules] for p, rules in ns.permissions.items()}} for n, ns in schema.namespaces.items()}
        self._write(f"schemas/{name}/{expected + 1}", json.dumps(body, sort_keys=True))
        return expected + 1

    def get(self, name: str, revision: int | None = None) -> AuthzSchema:
        known = self._revisions(f"schemas/{name}")
        if not known:
            raise AuthzError(f"no schema {name}")
        body = self._read(f"schemas/{name}/{revision or known[-1]}")
        rule = lambda r: Inherit(r["inherit"]) if "inherit" in r else Through(r["relation"], r["permission"])
        return AuthzSchema({n: Namespace({k: [tuple(x) for x in v] for k, v in ns["relations"].items()}, {p: [rule(r) for r in rules] for p, rules in ns["permissions"].items()}) for n, ns in body.items()})

    def bind(self, bucket: str, name: str, revision: int) -> None:
        """The schema that a bucket's tuples follow from now on; its last binding counts."""
        self.get(name, revision)
        self._write(f"bindings/{bucket}/{len(self._revisions(f'bindings/{bucket}')) + 1}", json.dumps([name, revision]))

    def of_bucket(self, bucket: str) -> AuthzSchema:
        known = self._revisions(f"bindings/{bucket}")
        if not known:
            raise AuthzError(f"{bucket} is not bound")
        return self.get(*self._read(f"bindings/{bucket}/{known[-1]}"))

"""From source objects to index rows.

A row has five identity columns and, per field, its value and whether it was present. A single-valued field is a
plain column, so filters on it reach the scan; a multi-valued one is an array, with a mark for an explicit null.
Missing, null and empty stay three things: not present; present without a value; present with an empty array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import analysis, paths, vectors
from tessera.plans.schema import SYSTEM_SEGMENT, DefinitionError, Expr, Field, FieldType, FullTextIndex, GitIndex, HybridIndex, IndexSpec, MetadataIndex, PathIndex, TensorIndex, TypedJsonIndex, VectorIndex

IDENTITY = ["result_path", "result_version", "source_path", "source_version", "source_record"]
LIVE, GONE = "live", "gone"


def present(name: str) -> str:
    return f"{name}__present"


def null_mark(name: str) -> str:
    return f"{name}__null"


def words(name: str) -> str:
    """Column of a text field's tokens, an array for each value."""
    return f"{name}__words"


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a path into a VARIANT."""
    if pointer and not pointer.startswith("/"):
        raise DefinitionError(f"bad JSON pointer {pointer!r}")
    out = "$"
    for token in pointer.split("/")[1:]:
        if re.search(r"~(?![01])", token):
            raise DefinitionError(f"bad escape in JSON pointer {pointer!r}")
        token = token.replace("~1", "/").replace("~0", "~")
        out += f"[{token}]" if re.fullmatch(r"0|[1-9]\d*", token) else "['" + token.replace("'", "\\'") + "']"
    return out


def in_scope(spec: IndexSpec, path: Column, content_type: Column) -> Column:
    """The scope, and no path through the system segment."""
    out = paths.in_scope(path, spec.scope.prefix) & ~paths.has_segment(path, SYSTEM_SEGMENT)
    return out if spec.scope.content_type is None else out & F.coalesce(content_type == spec.scope.content_type, F.lit(False))


def _checked(value: Column, f: Field) -> Column:
    """A scalar of the declared type; a value that isn't one breaks the definition. value: a VARIANT, not null."""
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    wrong = F.raise_error(F.concat(F.lit(f"field {f.name}: expected {f.type.value}, found "), kind))
    if f.type is FieldType.BOOLEAN:
        return F.when(kind == "BOOLEAN", value.cast("boolean")).otherwise(wrong.cast("boolean"))
    if f.type in (FieldType.KEYWORD, FieldType.TEXT):
        return F.when(kind == "STRING", text).otherwise(wrong.cast("string"))
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    if f.type is FieldType.SIGNED:
        return F.when(whole, F.coalesce(text.try_cast("long"), wrong.cast("long"))).otherwise(wrong.cast("long"))
    if f.type is FieldType.UNSIGNED:
        n = text.try_cast("decimal(20,0)")
        return F.when(whole & (n >= 0) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), n).otherwise(wrong.cast("decimal(20,0)"))
    d = text.try_cast("double")
    exact = ~whole | (d.cast("decimal(38,0)") == text.try_cast("decimal(38,0)"))
    number = whole | kind.isin("DOUBLE", "FLOAT") | kind.rlike(r"^DECIMAL")
    return F.when(number & (F.abs(d) < float("inf")) & exact, d + 0.0).otherwise(wrong.cast("double"))


def _json_cell(f: Field, doc: Column) -> dict[str, Column]:
    """Columns of a field that a pointer selects from a VARIANT."""
    at = F.try_variant_get(doc, pointer_path(f.source), "variant")
    kind = F.schema_of_variant(at)
    is_array, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    items = F.try_variant_get(doc, pointer_path(f.source), "array<variant>")
    nested = F.exists(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("ARRAY") | F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    # an object, or one inside the array, makes the field missing
    there = at.isNotNull() & ~F.coalesce(is_object, F.lit(False)) & ~F.coalesce(is_array & nested, F.lit(False))
    null = F.is_variant_null(at)
    if not f.multi:
        value = F.when(there & ~null, F.when(is_array, F.raise_error(f"field {f.name} holds one value, and the object an array").cast(f.type.spark)).otherwise(_checked(at, f)))
        return {f.name: value, present(f.name): F.coalesce(there, F.lit(False))}
    some = F.filter(items, lambda x: ~F.is_variant_null(x))
    values = F.when(is_array, F.transform(some, lambda x: _checked(x, f))).when(there & ~null, F.array(_checked(at, f)))
    any_null = F.when(is_array, F.exists(items, F.is_variant_null)).otherwise(null)
    return {f.name: F.when(there, F.coalesce(values, F.array().cast(f"array<{f.type.spark}>"))), present(f.name): F.coalesce(there, F.lit(False)), null_mark(f.name): F.coalesce(there & any_null, F.lit(False))}


def _is_pointer(source: object) -> bool:
    return isinstance(source, str) and not isinstance(source, Expr)


def _column(source: Expr | Column) -> Column:
    return F.expr(str(source)) if isinstance(source, Expr) else source


def cell(f: Field, doc: Column | None = None) -> dict[str, Column]:
    """Value, presence and (multi-valued) null mark of a field. A Column source is present wherever the object is."""
    if _is_pointer(f.source):
        out = _json_cell(f, doc)
    else:
        value = F.col(f.name) if f.source is None else _column(f.source)
        if not f.multi:
            # the column itself, so that filters on it reach the scan; ``checked`` looks at its values when rows are stored
            out = {f.name: value.cast(f.type.spark), present(f.name): F.lit(True)}
        else:
            value = value.cast(f"array<{f.type.spark}>")
            out = {f.name: F.filter(value, lambda x: x.isNotNull()), present(f.name): value.isNotNull(), null_mark(f.name): F.coalesce(F.exists(value, lambda x: x.isNull()), F.lit(False))}
    if f.multi and f.type is FieldType.KEYWORD:
        out[f.name] = F.array_sort(F.array_distinct(out[f.name]))  # other types keep their order and repeats
    if f.type is FieldType.TEXT:
        values = out[f.name] if f.multi else F.array_compact(F.array(out[f.name]))
        # values are analysed one by one, so a phrase never runs from one into the next
        out[words(f.name)] = F.transform(F.coalesce(values, F.array().cast("array<string>")), analysis.tokens)
    return out


def checked(spec: IndexSpec, rows: DataFrame) -> DataFrame:
    """The rows, or an error where a float field isn't finite; -0.0 becomes 0.0."""
    fine = {}
    for f in spec.fields:
        if f.type is FieldType.FLOAT:
            bad = F.raise_error(f"field {f.name}: not finite").cast("double")
            one = lambda x, bad=bad: F.when(F.isnan(x) | (F.abs(x) == float("inf")), bad).otherwise(x + 0.0)
            fine[f.name] = F.transform(f.name, one) if f.multi else one(F.col(f.name))
    return rows.withColumns(fine) if fine else rows


def _identity(df: DataFrame) -> dict[str, Column]:
    version = F.col("version") if "version" in df.columns else F.lit(1)
    return {"result_path": F.col("path"), "result_version": version.cast("decimal(20,0)"), "source_path": F.col("path"), "source_version": version.cast("decimal(20,0)"), "source_record": F.lit(0)}


def project(spec: IndexSpec, objects: DataFrame) -> DataFrame:
    """Index rows of the live objects in scope. objects: path, and what the kind needs of version, content_type, deleted and payload."""
    spec.validate()
    content_type = F.col("content_type") if "content_type" in objects.columns else F.lit(None).cast("string")
    own = objects.filter(in_scope(spec, F.col("path"), content_type))
    if "deleted" in own.columns:
        own = own.filter(~F.col("deleted"))
    if isinstance(spec, (GitIndex, TensorIndex)):
        return _manifest(spec, own)
    ids = _identity(own)
    if isinstance(spec, (PathIndex, MetadataIndex)):
        value = {"content_hash": lambda: F.lower(F.hex("content_hash")) if dict(own.dtypes)["content_hash"] == "binary" else F.lower("content_hash")}
        cells = {}
        for f in spec.fields:
            cells |= {f.name: value.get(f.name, lambda f=f: F.col(f.name))().cast(f.type.spark), present(f.name): F.lit(True)}
        return own.select(*[c.alias(n) for n, c in {**ids, **cells}.items()])
    doc = None
    if any(_is_pointer(f.source) for f in spec.fields) or isinstance(spec, VectorIndex) and _is_pointer(spec.source):
        own = own.withColumn("_doc", F.try_parse_json("payload")).filter(F.col("_doc").isNotNull())  # malformed sources leave no row
        doc = F.col("_doc")
    cells = {n: c for f in spec.fields for n, c in cell(f, doc).items()}
    if isinstance(spec, VectorIndex):
        cells["vector"] = F.try_variant_get(doc, pointer_path(spec.source), "array<float>") if _is_pointer(spec.source) else _column(spec.source).cast("array<float>")
    rows = own.select(*[c.alias(n) for n, c in {**ids, **cells}.items()])
    if isinstance(spec, VectorIndex):
        rows = rows.filter(vectors.valid(F.col("vector"), spec.dims))
        if spec.normalize:
            rows = rows.withColumn("vector", vectors.unit(F.col("vector"))).filter("vector is not null")
    if isinstance(spec, (FullTextIndex, HybridIndex)):
        some = [F.size(F.col(words(f.name))) > 0 for f in spec.fields]
        any_text = some[0]
        for s in some[1:]:
            any_text = any_text | s
        rows = rows.filter(any_text)
    return rows


GIT_RECORD = "repository_id string, commit_id string, tree_path string, object_id string, pack_path string, pack_version decimal(20,0), offset decimal(20,0), length decimal(20,0)"
TENSOR_RECORD = "model_id string, tensor_name string, source_path string, source_version decimal(20,0), offset decimal(20,0), length decimal(20,0), dtype string, shape array<decimal(20,0)>"


def _manifest(spec: GitIndex | TensorIndex, own: DataFrame) -> DataFrame:
    """Rows of manifests: one JSON record or an array of them. A source with a repeated key leaves no row."""
    git = isinstance(spec, GitIndex)
    record = "array<struct<" + ",".join(":".join(p.split(" ", 1)) for p in (GIT_RECORD if git else TENSOR_RECORD).split(", ")) + ">>"
    body = F.when(F.ltrim("payload").startswith("["), F.col("payload")).otherwise(F.concat(F.lit("["), "payload", F.lit("]")))
    ids = _identity(own)
    rows = own.select(
        ids["source_path"].alias("source_path"), ids["source_version"].alias("source_version"), F.posexplode(F.from_json(body, record)).alias("source_record", "r")
    )
    key = ["repository_id", "commit_id", "tree_path"] if git else ["model_id", "tensor_name"]
    result = ("r.pack_path", "r.pack_version") if git else ("r.source_path", "r.source_version")
    fields = [f.name for f in spec.fields]
    rows = rows.select("source_path", "source_version", "source_record", F.col(result[0]).alias("result_path"), F.col(result[1]).alias("result_version"), *[F.col(f"r.{n}").alias(n) for n in fields])
    mine = F.col(key[0]) == (spec.repository if git else spec.model)
    full = [F.coalesce(F.col(c) != "", F.lit(False)) for c in [*fields, "result_path"]]
    good = mine & F.coalesce(F.col("result_version") > 0, F.lit(False))
    for c in full:
        good = good & c
    rows = rows.filter(good)
    twice = rows.groupBy("source_path", "source_version", *key).count().filter("count > 1").select("source_path", "source_version")
    rows = rows.join(twice, ["source_path", "source_version"], "left_anti")
    return rows.select(*IDENTITY, *fields, *[F.lit(True).alias(present(n)) for n in fields])

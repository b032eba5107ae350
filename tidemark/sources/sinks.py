"""Writers: JSON documents with an envelope, manifests, collections by id, and their description."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slug


def json_document(rows: DataFrame, path: str, ident: str, version: str, note: str, name: str) -> None:
    """One JSON document {id, version, note, count, <name>: [...]} for lists that fit one document.

    The list is gathered in one task, as one document demands; large tables
    are written by collections().
    """
    body = rows.agg(F.count("*").alias("count"), F.collect_list(F.struct(*rows.columns)).alias(name))
    body.select(F.lit(ident).alias("id"), F.lit(version).alias("version"), F.lit(note).alias("note"), "count", name).coalesce(1).write.mode("overwrite").json(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files with content."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def collections(rows: DataFrame, name: str, path: str, key: str = "id", buckets: int = 16) -> None:
    """A collection as JSON lines below <path>/<name>/bucket=k/, each item under its slug; the first of a slug wins.

    Items lie in hash buckets instead of a file each, so a million items are
    no million files; item() reads one bucket.
    """
    keyed = rows.withColumn("_slug", slug(F.col(key), "sem-id"))
    first = keyed.groupBy("_slug").agg(F.min(F.struct(key, *[c for c in rows.columns if c != key])).alias("r")).select("_slug", "r.*")
    first.withColumn("bucket", F.pmod(F.xxhash64("_slug"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(os.path.join(path, name))


def item(spark, path: str, name: str, ident: str, buckets: int = 16) -> DataFrame:
    """The item of a collection with this slug (no row if there is none)."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(ident)), F.lit(buckets)).alias("b")).first().b
    return spark.read.json(os.path.join(path, name)).where((F.col("bucket") == bucket) & (F.col("_slug") == ident))


def openapi(tables: dict[str, DataFrame], title: str, version: str) -> str:
    """OpenAPI 3.1 description of the collections and their items."""
    paths, schemas = {}, {}
    for name, df in sorted(tables.items()):
        ref = {"$ref": f"#/components/schemas/{name}"}
        ok = lambda s: {"200": {"description": "OK", "content": {"application/json": {"schema": s}}}}
        paths[f"/{name}.json"] = {"get": {"operationId": f"list_{name}", "responses": ok({"type": "array", "items": ref})}}
        paths[f"/{name}/{{id}}.json"] = {"get": {"operationId": f"get_{name}", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": ok(ref)}}
        kinds = {"bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean"}
        schemas[name] = {"type": "object", "properties": {c: {"type": kinds.get(k, "string")} for c, k in df.dtypes}}
    return json.dumps({"openapi": "3.1.0", "info": {"title": title, "version": version}, "paths": paths, "components": {"schemas": schemas}}, ensure_ascii=False, indent=1)

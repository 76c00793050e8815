"""Queries that write tables in each format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from banyan.plans.base import query
from banyan.session import scratch_dir
from banyan.sources import files


def _path(t, name: str) -> str:
    return f"{scratch_dir(t.documents.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, replace(text, chr(13), '') AS text, lang, NULL::VARCHAR AS missing FROM documents WHERE trim(text) <> ''")
def csv_round_trip(t):
    """Texts with quotes and line breaks to CSV and back, with a column that the table lacks and without one that it has; CSV does not tell blank from missing."""
    at, d = _path(t, "csv"), t.documents.filter("trim(text) <> ''").withColumn("text", F.translate("text", "\r", ""))
    files.write_csv(d, at, ["doc_id", "text", "lang", "missing"])
    return files.read_csv(d.sparkSession, at, "doc_id bigint, text string, lang string, missing string")


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(t):
    """Texts to lines of JSON and back, nulls and blanks told apart."""
    at, d = _path(t, "jsonl"), t.documents.select("doc_id", "text", "lang")
    files.write_json(d, at)
    return files.read_jsonl(d.sparkSession, at, "doc_id bigint, text string, lang string")


@query("SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def partitioned_round_trip(t):
    """A directory for each source; a read of it finds the sources from the directories."""
    at, d = _path(t, "parts"), t.documents.filter("source is not null").select("doc_id", "n_chars", "source")
    files.write_partitioned(d, at, "source")
    back = d.sparkSession.read.schema("doc_id bigint, n_chars bigint, source string").parquet(at)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS note FROM nation")
def optional_source(t):
    """A table beside an optional one that is not there."""
    spark = t.nation.sparkSession
    notes = files.read_optional(spark, _path(t, "none"), "k bigint, note string")
    return t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")).join(notes, "k", "left")


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, label::BIGINT AS label FROM embeddings")
def collection_upsert(t):
    """A collection of vectors with payload, written, then upserted by id from the same table, and read back."""
    at, e = _path(t, "vectors"), t.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    old = e.filter("vec_id % 2 = 0").withColumn("label", F.lit(-1).cast("bigint"))
    files.upsert(old, e.withColumn("ord", F.lit(1).cast("bigint")), ["vec_id"], "ord").write.mode("overwrite").parquet(at)
    return e.sparkSession.read.schema(e.schema).parquet(at).select("vec_id", F.col("embedding")[0].cast("double").alias("first"), "label")

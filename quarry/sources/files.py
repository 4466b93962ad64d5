"""File sources and sinks.

Native form: Parquet partitioned by domain with dynamic partition overwrite (rewriting one
domain leaves the others). JSON sinks write one line per entry under a folder per group (the
folder is the group's document), so no group is gathered into one row; readers also accept
the single-document layouts (a domain document with an `entries` array, an object
domain → list of feedback). Readers take explicit schemas (no inference pass over the data).
"""
from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWLEDGE_ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("concepts", T.ArrayType(T.StringType())),
    T.StructField("importance_score", T.DoubleType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("version", T.LongType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
KNOWLEDGE_DOC = T.StructType([T.StructField("domain", T.StringType()),
                              T.StructField("entries", T.ArrayType(KNOWLEDGE_ENTRY))])

FEEDBACK_ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("model_id", T.StringType()), T.StructField("feedback_type", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("rating", T.DoubleType()),
    T.StructField("user_input", T.StringType()), T.StructField("model_output", T.StringType()),
    T.StructField("expected_output", T.StringType()), T.StructField("correction", T.StringType()),
    T.StructField("user_comment", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("concepts", T.ArrayType(T.StringType())), T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("processed", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
FEEDBACK_TYPES = ["rating", "correction", "suggestion", "complaint", "praise", "clarification"]


# ----------------------------------------------------------------------------- S1, S2
def write_knowledge(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Knowledge partitioned by domain; only the domains present in `df` are rewritten."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("domain").format(fmt).save(path))


def read_knowledge(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S1 (native form): the partitioned table; filters on domain prune partitions."""
    return spark.read.format(fmt).load(path)


def write_knowledge_json(df: DataFrame, path: str) -> None:
    """S2 (JSON form): one folder per domain holding its entries as JSON lines (the folder is
    the domain's document). Nothing is gathered per domain, so a domain holding a third of all
    entries is written by many tasks; only that domain's folder is replaced."""
    (df.select(*[F.col(f.name) for f in KNOWLEDGE_ENTRY.fields]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("domain").json(path))


def read_knowledge_json(spark: SparkSession, path: str) -> DataFrame:
    """S1 (JSON form written by `write_knowledge_json`): entries as rows, domain from the folder."""
    return spark.read.schema(KNOWLEDGE_ENTRY).json(path)


def read_knowledge_documents(spark: SparkSession, path: str) -> DataFrame:
    """S1 (the reference's file layout): one JSON document per domain `{domain, entries: [...]}`,
    entries exploded to rows."""
    d = spark.read.schema(KNOWLEDGE_DOC).option("multiLine", True).json(path)
    return d.select(F.explode("entries").alias("e")).select("e.*")


# ----------------------------------------------------------------------------- S3, S21
def read_text_documents(spark: SparkSession, glob: str) -> DataFrame:
    """S3: every file is one document (whole text) with its path."""
    return (spark.read.text(glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")))


# ----------------------------------------------------------------------------- S6, S7
def write_feedback(df: DataFrame, path: str) -> None:
    """Feedback rows partitioned by domain (dynamic overwrite keeps the other domains)."""
    write_knowledge(df, path, "json")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback rows with the M6 schema; rows with an unknown type get `type_valid` false
    (a quarantine column instead of a failed load)."""
    d = spark.read.schema(FEEDBACK_ENTRY).json(path)
    return d.withColumn("type_valid", F.col("feedback_type").isin(*FEEDBACK_TYPES))


def read_feedback_document(spark: SparkSession, path: str) -> DataFrame:
    """S6 (document form): a JSON object domain → list of entries, exploded twice."""
    schema = T.MapType(T.StringType(), T.ArrayType(FEEDBACK_ENTRY))
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", schema)).alias("domain_key", "entries"))
    x = m.select(F.explode("entries").alias("e")).select("e.*")
    return x.withColumn("type_valid", F.col("feedback_type").isin(*FEEDBACK_TYPES))


# ----------------------------------------------------------------------------- S14, S16, S17
SESSION_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("adapter_id", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("start_time", T.TimestampType()),
    T.StructField("feedback_records", T.ArrayType(T.StructType([
        T.StructField("feedback_id", T.StringType()), T.StructField("feedback_type", T.StringType()),
        T.StructField("feedback_text", T.StringType()), T.StructField("rating", T.DoubleType()),
        T.StructField("applied", T.BooleanType()), T.StructField("timestamp", T.TimestampType())]))),
])


def read_sessions(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """One JSON document per session with nested feedback; one row per record (sessions
    without records kept with nulls); only active sessions by default."""
    s = spark.read.schema(SESSION_SCHEMA).option("multiLine", True).json(path)
    if active_only:
        s = s.filter(F.col("status") == "active")
    return s.select("session_id", "adapter_id", "domain", "phase", "status", "start_time",
                    F.explode_outer("feedback_records").alias("r")).select("*", "r.*").drop("r")


def write_sessions(records: DataFrame, path: str) -> None:
    """Records grouped back into one document per session (bounded by the session)."""
    rec = F.struct("feedback_id", "feedback_type", "feedback_text", "rating", "applied", "timestamp")
    doc = records.groupBy("session_id", "adapter_id", "domain", "phase", "status", "start_time").agg(
        F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("_t"), rec.alias("_r")))).alias("_x"))
    doc = doc.withColumn("feedback_records", F.transform("_x", lambda x: x["_r"])).drop("_x")
    doc.write.mode("overwrite").json(path)


def write_doc_summary(segments: DataFrame, path: str, key: str = "source_file") -> None:
    """The summary of each source as a folder of JSON lines, one per segment with its
    ordinal (read back in ordinal order); no source is gathered into one row."""
    (segments.select(key, "ordinal", "segment_id", "original_text", "summary", "word_count")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path))


def read_jsonl(spark: SparkSession, path: str,
               schema: str = "prompt string, response string, _corrupt_record string") -> DataFrame:
    """JSONL with a fixed schema; malformed lines kept in `_corrupt_record`."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


# ----------------------------------------------------------------------------- S19
def named_files(spark: SparkSession, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """The files below a folder: name (path from the folder), length, content. A file that vanished
    meanwhile or can't be read has a null content instead of ending the job; so has one longer than
    `max_bytes`, which isn't read. Listing and contents are two scans: the first reads no bytes. Spark's
    readers don't list files without a byte, so these count as not there."""
    def scan():
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder))
    base = re.sub("^[a-z0-9]+:/*|^/*", "", folder.rstrip("/"))
    name = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    listed = scan().select(name.alias("name"), "length")
    content = scan().filter(F.col("length") <= max_bytes).select(name.alias("name"), "content")
    return listed.join(content, "name", "left")


# ----------------------------------------------------------------------------- S12
PROFILE_SCHEMA = ("name string, domain string, description string, decision_patterns array<string>, case_studies array<string>, "
                  "communication_style string, metadata map<string,string>")


def read_profiles(spark: SparkSession, folder: str, builtin: DataFrame | None = None, schema: T.StructType | str = PROFILE_SCHEMA) -> DataFrame:
    """One JSON document per profile in a folder, over the built-in ones: the later file (by name)
    wins for a name, any file over a built-in profile. Documents without a name are left out."""
    read = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
            .filter(F.col("name").isNotNull()).withColumn("_file", F.col("_metadata.file_path")))
    payload = [c for c in read.columns if c not in ("name", "_file")]
    last = read.groupBy("name").agg(F.max_by(F.struct(*payload), "_file").alias("_p")).select("name", "_p.*")
    if builtin is None:
        return last
    rest = builtin.join(last.select("name"), "name", "left_anti")
    return last.unionByName(rest, allowMissingColumns=True)


# ----------------------------------------------------------------------------- S14 history and metrics
PERFORMANCE_SCHEMA = "domain string, model_id string, recorded_at timestamp, overall_score double, metrics map<string,double>"


def write_performance(history: DataFrame, path: str) -> None:
    """Append rows of the performance history, one folder per domain."""
    (history.select("domain", "model_id", "recorded_at", "overall_score", "metrics")
     .write.mode("append").partitionBy("domain").json(path))


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    """The history with its schema; a filter on domain reads that domain's folder alone."""
    return spark.read.schema(PERFORMANCE_SCHEMA).json(path)


def latest_metrics(history: DataFrame) -> DataFrame:
    """The current metrics per domain and model: for each name, the latest value recorded."""
    one = history.select("domain", "model_id", "recorded_at", F.explode("metrics").alias("metric", "value"))
    last = one.groupBy("domain", "model_id", "metric").agg(F.max_by("value", F.struct("recorded_at", "value")).alias("value"))
    return last.groupBy("domain", "model_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


# ----------------------------------------------------------------------------- S8, S10
def write_registry(tables: dict[str, DataFrame], path: str) -> None:
    """S8 export: one folder per kind (models, deployments, configs, templates, adapters)."""
    for kind, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{kind}")


def read_registry(spark: SparkSession, path: str, kinds: Sequence[str]) -> dict[str, DataFrame]:
    """S8 import: the tables of `write_registry`."""
    return {k: spark.read.parquet(f"{path.rstrip('/')}/{k}") for k in kinds}


def read_registry_document(spark: SparkSession, *paths: str) -> DataFrame:
    """Registry documents as entries (section, key, body): each member of a section that is an object is
    an entry, other members of the document have no key. `body` is JSON text, whatever it holds. Of several
    documents the later ones are merged into the earlier."""
    from quarry.operators.registry import merge_entries
    found = None
    for path in paths:
        # values stay variants until their JSON text is taken, so strings keep their quotes
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,variant>")).alias("section", "_b"))
        text = F.to_json("_b")
        is_object = text.startswith("{")
        members = raw.filter(is_object).select("section", F.explode(F.from_json(text, "map<string,variant>")).alias("key", "_v"))
        alone = raw.filter(~is_object | F.col("_b").isNull()).select("section", F.lit(None).cast("string").alias("key"), F.col("_b").alias("_v"))
        one = members.unionByName(alone).select("section", "key", F.coalesce(F.to_json("_v"), F.lit("null")).alias("body"))
        found = one if found is None else merge_entries(found, one)
    return found


def write_registry_document(entries: DataFrame, path: str) -> None:
    """One JSON document of all entries, as one text file in the folder `path`."""
    from quarry.operators.registry import registry_document
    registry_document(entries).write.mode("overwrite").text(path)


def write_cycles(cycles: DataFrame, path: str) -> None:
    """Append learning cycles to the history, which is kept whole."""
    cycles.write.mode("append").json(path)


def read_cycles(spark: SparkSession, path: str, schema: T.StructType | str, keep: int | None = None) -> DataFrame:
    """The history with its schema (not inferred), or its `keep` most recent cycles."""
    from quarry.operators.registry import last_cycles
    cycles = spark.read.schema(schema).json(path)
    return cycles if keep is None else last_cycles(cycles, keep)

"""Image folders with caption sidecars, label tables, JSON dimensions, header tables; and sinks for captions and logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import masked, redacted
from tagloom.operators.versions import latest

# Endings of image files.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")

# Headers whose values are secrets, besides those whose names hold token or secret.
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "api-key", "apikey", "x-goog-api-key", "x-auth-token")


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, modified of all files of a folder; contents are not read. Spark itself hides names that begin with . or _."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scanned(files: DataFrame, root: str, endings: tuple[str, ...] = IMAGES, recursive: bool = True) -> DataFrame:
    """The files(path, ...) below a folder with one of the endings, in any case, one for each path without regard to case.

    A recursive scan leaves out everything below a name with a dot in front; a flat one takes the folder's own files only.
    """
    inner = F.substr("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    below = F.startswith("path", F.lit(root.rstrip("/") + "/")) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings)
    there = files.where(below & (~inner.rlike(r"(^|/)\.") if recursive else ~inner.contains("/")))
    return latest(there.withColumn("__low", F.lower("path")), "__low", F.col("path")).drop("__low")


def image_paths(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, modified of the images of a folder. Order isn't a property of a table: sort by lower(path) to show it."""
    files = listing(spark, root, recursive)
    at = root if "://" in root or root.startswith("file:") else f"file:{root}"
    return scanned(files, at, recursive=recursive)


def text_paths(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    at = root if "://" in root or root.startswith("file:") else f"file:{root}"
    return scanned(listing(spark, root, recursive), at, ("txt",), recursive)


@F.pandas_udf(T.StringType())
def gb18030(contents: pd.Series) -> pd.Series:
    """Bytes that aren't UTF-8 in the second encoding; what it can't read becomes the replacement character."""
    return contents.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decoded(content: Column) -> Column:
    """UTF-8 without marks at the beginning, or else GB18030; missing content is an empty text."""
    plain = F.regexp_replace(content.cast("string"), "^\ufeff+", "")
    return F.when(content.isNull(), "").when(F.is_valid_utf8(content.cast("string")), plain).otherwise(gb18030(content))


def text_error(path: Column, content: Column) -> Column:
    """Why a file can't be edited as text, or null."""
    return (
        F.when(content.isNull(), "missing").when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) != "txt", "not a .txt file")
        .when(F.hex(content).rlike("^(?:..)*?00"), "binary content").when(~F.is_valid_utf8(content.cast("string")) & decoded(content).contains("\ufffd"), "unknown encoding")
    )


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """caption_path, caption, error: the text files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(root)
    return files.select(F.col("path").alias("caption_path"), decoded(F.col("content")).alias("caption"), text_error(F.col("path"), F.col("content")).alias("error"))


def read_texts(rows: DataFrame) -> DataFrame:
    """rows(caption_path, content, ...) with caption and unreadable: what can't be edited as text is empty and says why."""
    why = text_error(F.col("caption_path"), F.col("content"))
    return rows.withColumn("unreadable", why).withColumn("caption", F.when(F.col("unreadable").isNull(), decoded(F.col("content"))).otherwise("")).drop("content")


def stem(path: Column) -> Column:
    """The caption path of an image: the same with txt for the ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".txt"))


def paired(images: DataFrame, captions: DataFrame, reviewed: DataFrame | None = None, revisions: DataFrame | None = None) -> DataFrame:
    """Images with their captions: missing ones are empty and pending. reviewed(caption_path), revisions(caption_path, revisions)
    are matched without regard to case."""
    texts = captions.select("caption_path", F.coalesce("caption", F.lit("")).alias("caption"), F.lit(True).alias("there"))
    jobs = images.withColumn("caption_path", stem(F.col("path"))).join(texts, "caption_path", "left")
    jobs = jobs.withColumn("caption", F.coalesce("caption", F.lit(""))).withColumn("status", F.when(F.col("there"), "succeeded").otherwise("pending")).drop("there")
    jobs = with_reviewed(jobs, reviewed) if reviewed is not None else jobs.withColumn("reviewed", F.lit(False))
    if revisions is None:
        return jobs.withColumn("revision_count", F.lit(0).cast("long"))
    counts = revisions.groupBy(F.lower("caption_path").alias("__p")).agg(F.sum("revisions").alias("n"))
    return jobs.join(counts, F.lower("caption_path") == F.col("__p"), "left").withColumn("revision_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n", "__p")


def with_reviewed(jobs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """reviewed: whether a job's caption path is in a set of paths, without regard to case."""
    known = reviewed.select(F.lower("caption_path").alias("__r")).distinct()
    return jobs.join(known, F.lower("caption_path") == F.col("__r"), "left").withColumn("reviewed", F.col("__r").isNotNull()).drop("__r")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """index, name: rows of a label file in order; only categories 0 and 4 name a tag."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("tag_id", "name", "category", "count")])
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)
    # one file is read in one piece, so that an increasing id numbers its rows in order and without gaps
    numbered = rows.where("tag_id is not null").coalesce(1).withColumn("index", F.monotonically_increasing_id())
    return numbered.select("index", F.when(F.col("category").isin("0", "4"), F.col("name")).alias("name"), "category")


def rating_count(labels: DataFrame) -> DataFrame:
    """ratings: how many rows at the head of a label table are ratings (category 9)."""
    first = labels.where("category <> '9'").agg(F.min("index").alias("first"))
    return labels.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first)).select(F.coalesce("first", "n").alias("ratings"))  # one row each


def json_dimension(rows: DataFrame, schema: str) -> DataFrame:
    """rows(id, json, updated_at) parsed; malformed documents are left out."""
    parsed = F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.withColumn("doc", parsed).where(F.col("doc").isNotNull() & F.get_json_object("json", "$").isNotNull()).select("id", "doc.*", "updated_at")


def sensitive(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*SENSITIVE_HEADERS) | low.contains("token") | low.contains("secret")


def masked_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(sensitive(k), masked(v)).otherwise(v))


def header_entries(header: Column) -> Column:
    """The top-level keys of a JSON header with their values as written, null if it isn't an object."""
    return F.from_json(header, "map<string,string>")


def header_error(header: Column) -> Column:
    """Why a header isn't valid, or null: besides the metadata it holds only tensors, each with dtype, shape and two offsets."""
    entries = header_entries(header)

    def tensor(value: Column) -> Column:
        v = F.try_parse_json(value)
        kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
        offsets = F.try_variant_get(v, "$.data_offsets", "array<bigint>")
        whole = kind("$.data_offsets").isin("ARRAY<BIGINT>") & (F.size(offsets) == 2) & F.forall(offsets, lambda o: o >= 0)
        return F.coalesce((kind("$.dtype") == "STRING") & F.startswith(kind("$.shape"), F.lit("ARRAY<")) & whole, F.lit(False))

    bad = F.map_filter(entries, lambda k, v: (k != "__metadata__") & ~tensor(v))
    return F.when(entries.isNull(), "malformed header").when(F.size(bad) > 0, "not a tensor")


def metadata_report(headers: DataFrame) -> DataFrame:
    """headers(path, header): whether metadata is there, its keys without regard to case in order, their number, how many
    tensors; for an invalid header the reason alone."""
    keys = F.json_object_keys("header")
    inner = F.coalesce(F.json_object_keys(F.get_json_object("header", "$.__metadata__")), F.array().cast("array<string>"))
    ordered = F.transform(F.array_sort(F.transform(inner, lambda k: F.struct(F.lower(k).alias("low"), k.alias("key")))), lambda k: k["key"])
    told = headers.select("path", header_error(F.col("header")).alias("error"), keys.alias("keys"), ordered.alias("inner"))
    good = F.col("error").isNull()
    return told.select(
        "path", (good & F.array_contains("keys", "__metadata__")).alias("metadata_present"), F.when(good, F.array_join("inner", ",")).otherwise("").alias("keys"),
        F.when(good, F.size("inner")).otherwise(0).cast("long").alias("metadata_count"), F.when(good, F.size(F.filter("keys", lambda k: k != "__metadata__"))).otherwise(0).cast("long").alias("tensors"), "error",
    )


def stripped(headers: DataFrame) -> DataFrame:
    """headers(path, header, payload): path, header without metadata, status (sanitized, already_clean, error), removed keys,
    verified: every tensor is described as before and the payload has its old hash. Values are kept as they were written."""
    entries = header_entries(F.col("header"))
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    kept = F.transform(F.map_entries(F.map_filter(entries, lambda k, _: k != "__metadata__")), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    status = F.when(F.col("error").isNotNull(), "error").when(F.map_contains_key(entries, "__metadata__"), "sanitized").otherwise("already_clean")
    rows = headers.withColumn("error", header_error(F.col("header"))).withColumn("status", status)
    clean = F.when(F.col("status") == "sanitized", F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))).otherwise(F.col("header"))
    removed = F.coalesce(F.size(F.json_object_keys(F.get_json_object("header", "$.__metadata__"))), F.lit(0))
    out = rows.withColumn("clean", clean).withColumn("removed", F.when(F.col("status") == "sanitized", removed).otherwise(0).cast("long"))
    tensors = lambda h: F.array_sort(F.map_entries(F.map_filter(header_entries(h), lambda k, _: k != "__metadata__")))
    same = (tensors(F.col("header")) == tensors(F.col("clean"))) & ~F.map_contains_key(header_entries(F.col("clean")), "__metadata__")
    return out.select("path", F.col("clean").alias("header"), "status", "removed", F.when(F.col("status") == "error", False).otherwise(same).alias("verified"), F.sha2("payload", 256).alias("payload_sha256"))


def log_lines(entries: DataFrame) -> Column:
    """One redacted line for each log entry(timestamp, level, scope, message)."""
    return F.format_string("[%s] [%s] [%s] %s", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.upper("level"), "scope", redacted(F.col("message")))


def export_captions(captions: DataFrame, path: str, partition: str | None = None) -> None:
    """The final captions as Parquet, in folders by one column if named; the target must be a new folder."""
    writer = captions.write
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def changed_captions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The captions(caption_path, caption) that a sink has to write: new ones and those whose text isn't the old one."""
    old = before.select(F.col("caption_path").alias("__p"), F.col("caption").alias("__c"), F.lit(True).alias("__there"))
    rows = after.join(old, F.col("caption_path") == F.col("__p"), "left")
    return rows.where(F.col("__there").isNull() | ~F.col("caption").eqNullSafe(F.col("__c"))).drop("__p", "__c", "__there")

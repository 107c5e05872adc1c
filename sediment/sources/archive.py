"""Archives of messages as JSON lines with checksums: write, read and verify, restore; files of a folder as messages; export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's name and the fields of an archived message, in their order.
FORMAT = "sediment-archive-1"
FIELDS = ("content", "id", "metadata", "role", "session_id", "timestamp")
SCHEMA = "content string, id string, metadata string, role string, session_id string, timestamp double, archive_format string, checksum_sha256 string"


def encode(messages: DataFrame) -> DataFrame:
    """``id``, ``value``: one JSON line for each message, keys sorted, nulls left out, with the SHA-256 of its content part."""
    body = F.to_json(F.struct(*FIELDS))
    whole = F.struct(*FIELDS, F.lit(FORMAT).alias("archive_format"), F.sha2(body, 256).alias("checksum_sha256"))
    return messages.select("id", F.to_json(whole).alias("value"))


def write_archive(messages: DataFrame, path: str) -> None:
    """Fails if the path exists: an archive is never overwritten."""
    encode(messages).select("value").write.mode("error").text(path)


def decode(lines: DataFrame) -> DataFrame:
    """``value`` to message fields, ``ok`` and ``error`` (``json``, ``format``, ``field`` or ``checksum``); bad lines are kept for a quarantine."""
    j = lines.withColumn("_j", F.from_json("value", SCHEMA))
    body = F.to_json(F.struct(*(F.col(f"_j.{f}").alias(f) for f in FIELDS)))
    error = (
        F.when(F.col("_j").isNull() | (F.col("_j.id").isNull() & F.col("_j.archive_format").isNull()), "json")
        .when(~F.col("_j.archive_format").eqNullSafe(F.lit(FORMAT)), "format")
        .when(F.col("_j.id").isNull() | F.col("_j.timestamp").isNull(), "field")
        .when(~F.col("_j.checksum_sha256").eqNullSafe(F.sha2(body, 256)), "checksum")
    )
    return j.select(*(F.col(f"_j.{f}").alias(f) for f in FIELDS), error.isNull().alias("ok"), error.alias("error"), "value")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))


def restore(current: DataFrame, archived: DataFrame) -> DataFrame:
    """``current`` with the archived messages whose id it lacks; an id archived twice comes back once."""
    good = archived.where("ok").select(*FIELDS).dropDuplicates(["id"])
    return current.unionByName(good.join(current.select("id"), "id", "left_anti").select(current.columns))


def retention(messages: DataFrame, before: float | None = None, keep_latest: int | None = None) -> DataFrame:
    """Messages to archive: older than ``before`` and not among the ``keep_latest`` newest (ties: larger id is newer). One of the two must be given."""
    if before is None and keep_latest is None:
        raise ValueError("give before, keep_latest or both")
    out = messages
    if before is not None:
        out = out.where(F.col("timestamp") < before)
    if keep_latest is not None:
        newest = messages.orderBy(F.desc("timestamp"), F.desc("id")).limit(keep_latest).select("id")
        out = out.join(newest, "id", "left_anti")
    return out


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{txt,md,json}") -> DataFrame:
    """Whole files of a folder and its subfolders as messages: ``path``, ``session_id`` (the file's stem), ``content``. Blank files are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace(F.url_decode(name), r"\.[^.]+$", "").alias("session_id"), F.col("value").alias("content")).where(F.trim("content") != "")


def markdown(messages: DataFrame) -> DataFrame:
    """``session_id``, ``markdown``: each session's messages in order under their roles."""
    part = F.concat(F.lit("**"), F.coalesce("role", F.lit("unknown")), F.lit("**: "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id", part.alias("p"))))
    return messages.where("session_id is not null").groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("markdown"))

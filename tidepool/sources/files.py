"""Bulk import: files of records as DataFrames (content, created_at, status).

``status`` is ``imported``, ``skipped`` or ``error``; ``counters`` sums it up. A file that is too large to be read is one record with status ``error``. Nothing is read on
the driver but path names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.constants import MOST_BYTES
from tidepool.functions.dates import iso_ms
from tidepool.functions.text import chunks, column
from tidepool.operators.tables import secret_kind

#: Larger files are not read, nor folders more levels down.
MOST_FILE_BYTES, MOST_LEVELS = 100 << 20, 16


def file_format(path: str | Column) -> Column:
    """By the ending of the name, as written: jsonl, csv, mbox, markdown or text."""
    ending = F.regexp_extract(column(path), r"(\.[^./]*)$", 1)
    return (
        F.when(ending == ".jsonl", "jsonl").when(ending == ".csv", "csv").when(ending.isin(".mbox", ".mbx"), "mbox").when(ending.isin(".md", ".markdown"), "markdown").otherwise("text")
    )


def path_allowed(path: str, roots: list[str]) -> bool:
    """Whether a path, links resolved, is one of the roots or below one."""
    own = os.path.realpath(path)
    return any(own == r or own.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots))


def read_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, text) of the files of a folder; ``text`` is null for files that are too large, whose content is not read.

    Files and folders whose names begin with a dot are left out, and so is what lies more than ``MOST_LEVELS`` folders down.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    below = F.when(F.startswith("path", F.lit(base + "/")), F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    found = reader.load(folder).where(~below.rlike(r"(^|/)\.") & (F.size(F.split(below, "/")) <= MOST_LEVELS + 1))
    small = found.where(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("text"))
    return small.unionByName(found.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("text")))


def unread(files: DataFrame, text: str = "text") -> DataFrame:
    """A record with status ``error`` for each file that was not read."""
    return files.where(F.col(text).isNull()).select(F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("created_at"), F.lit("error").alias("status"))


def jsonl_records(lines: DataFrame, line: str = "value", preserve: bool = True) -> DataFrame:
    """One object a line with a string ``content``; empty lines are passed over, others without it are skipped."""
    own = lines.where(F.length(F.col(line)) > 0)
    parsed = F.from_json(F.col(line), "content string, created_at string")
    good = F.col("r.content").isNotNull() & F.get_json_object(line, "$.content").isNotNull() & F.col(line).rlike(r'"content"\s*:\s*"')
    made = iso_ms("r.created_at") if preserve else F.lit(0).cast("long")
    return own.withColumn("r", parsed).select(
        F.when(good, F.col("r.content")).alias("content"), F.when(good, made).otherwise(0).alias("created_at"), F.when(good, "imported").otherwise("skipped").alias("status")
    )


def csv_records(files: DataFrame, text: str = "text") -> DataFrame:
    """Every line but a file's first is a record as it stands; empty lines are passed over, a file of one line is an error."""
    own = files.withColumn("lines", F.split(F.col(text), "\n", -1))
    rows = own.where(F.size("lines") > 1).select(F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("content")).where(F.length("content") > 0)
    bad = own.where(F.coalesce(F.size("lines"), F.lit(-1)) <= 1).select(F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("created_at"), F.lit("error").alias("status"))
    return rows.select("content", F.lit(0).cast("long").alias("created_at"), F.lit("imported").alias("status")).unionByName(bad)


def csv_mapped(spark: SparkSession, path: str, content: str) -> DataFrame:
    """A CSV file read by its header, one column being the content."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select(F.col(content).alias("content"), F.lit(0).cast("long").alias("created_at"), F.lit("imported").alias("status"))


def text_records(files: DataFrame, text: str = "text", strategy: str = "paragraph", size: int = 4096) -> DataFrame:
    """A text's chunks; those of white space alone are skipped."""
    each = files.select(F.explode(chunks(text, strategy, size)).alias("content"))
    made = each.select("content", F.lit(0).cast("long").alias("created_at"), F.when(F.col("content").rlike(r"[^ \t\r\n\f]"), "imported").otherwise("skipped").alias("status"))
    return made.where(F.col("content").isNotNull()).unionByName(unread(files, text))


def mbox_records(files: DataFrame, text: str = "text", preserve: bool = True) -> DataFrame:
    """The messages of mailboxes: body from the first empty line to the next line that begins with ``From ``."""
    from collections.abc import Iterator

    import pandas as pd

    from tidepool.functions.dates import rfc2822_ms

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(body, rfc2822_ms(date) if preserve else 0, "imported") for own in part["text"] for body, date in messages(own or "")]
            yield pd.DataFrame(rows, columns=["content", "created_at", "status"]).astype({"created_at": "int64"})

    read = files.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(run, "content string, created_at long, status string")
    return read.unionByName(unread(files, text))


def messages(text: str):
    """(body, date header or None) of each message of a mailbox."""
    lines, at = text.splitlines(keepends=True), 0
    while at < len(lines):
        if not lines[at].startswith("From "):
            at += 1
            continue
        at, date, found = at + 1, None, False
        while at < len(lines) and lines[at].endswith("\n"):
            line = lines[at].rstrip("\r\n")
            at += 1
            if not line:
                found = True
                break
            if line[:5].lower() == "date:":
                date = line[5:].strip()
        start = at
        while at < len(lines) and (at == start or not lines[at].startswith("From ")):
            at += 1
        body = "".join(lines[start:at])
        if found and body:
            yield body, date


def batch_records(items: DataFrame) -> DataFrame:
    """Items (content, ...) of one request with ``status``: skipped without content, over 64 KB or with a secret. A request of any length is taken whole."""
    content = F.col("content")
    skipped = content.isNull() | (F.octet_length(content) > MOST_BYTES) | secret_kind(content).isNotNull()
    return items.withColumn("status", F.when(skipped, "skipped").otherwise("imported"))


def counters(records: DataFrame) -> DataFrame:
    """(imported, skipped, errors): one row."""
    number = lambda s: F.count(F.when(F.col("status") == s, 1))
    return records.agg(number("imported").alias("imported"), number("skipped").alias("skipped"), number("error").alias("errors"))

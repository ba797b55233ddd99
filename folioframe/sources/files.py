"""Files of any kind: an inventory by content, text with fallback encodings, and text written per document."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.session import cut_lineage

IMAGE_ENDINGS = ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"]
TEXT_ENDINGS = ["txt", "csv", "md"]
OFFICE_MEMBERS = [("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")]


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_kind(path: Column, content: Column) -> Column:
    """pdf, ole, docx, pptx, xlsx, image, text or unknown: by signature first, then by the ending of the name.

    Member names stand uncompressed in a zip file, so looking for them in the bytes is enough.
    """
    def bytes_of(hexed):
        return F.unhex(F.lit(hexed))

    zipped = F.lit("unknown")
    for member, kind in reversed(OFFICE_MEMBERS):
        zipped = F.when(F.contains(content, bytes_of(member.encode().hex())), kind).otherwise(zipped)
    ending = _extension(path)
    return (F.when(F.startswith(content, bytes_of("25504446")), "pdf")
            .when(F.startswith(content, bytes_of("D0CF11E0A1B11AE1")), "ole")
            .when(F.startswith(content, bytes_of("504B")), zipped)
            .when(ending.isin(IMAGE_ENDINGS), "image").when(ending.isin(TEXT_ENDINGS), "text").otherwise("unknown"))


def inventory(files: DataFrame) -> DataFrame:
    """One row per file with its kind and whether it can be converted, instead of a batch that stops on errors."""
    kind = file_kind(F.col("path"), F.col("content"))
    return files.select("path", "length", kind.alias("kind")).withColumn(
        "convertible", F.col("kind").isin("docx", "pptx", "xlsx", "text", "pdf", "image"))


def decode_text(content: Column) -> Column:
    """Text of bytes as UTF-8 (with or without mark), else cp932, else UTF-16, else UTF-8 with replacement signs."""
    bad = F.lit("�")
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    japanese = F.decode(content, "windows-31j")
    little, big = F.startswith(content, F.unhex(F.lit("FFFE"))), F.startswith(content, F.unhex(F.lit("FEFF")))
    rest = F.substring(content, F.lit(3), F.length(content))
    wide = F.when(little, F.decode(rest, "UTF-16LE")).when(big, F.decode(rest, "UTF-16BE")).otherwise(F.decode(content, "UTF-16LE"))
    even = F.length(content) % 2 == 0
    return (F.when(F.is_valid_utf8(content), utf8).when(~F.contains(japanese, bad), japanese)
            .when(even & ~F.contains(wide, bad), wide).otherwise(utf8))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return read_binary(spark, path).select("path", decode_text(F.col("content")).alias("text"))


def write_lines(lines: DataFrame, path: str, order: list[str], key: str = "doc_id", mark: bool = False, whole: bool = False) -> None:
    """Write report lines as text files, one folder per document.

    The lines are range-partitioned by document and order: a long document becomes several part files whose
    names sort in the right order, and no task holds a whole one. ``mark`` puts a byte order mark in front of
    the first line of every document, as spreadsheet programs want it. ``whole`` never cuts a document, for short
    ones whose readers need all of it in one file, such as XML under its root.
    """
    if mark:
        first = lines.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
        lines = lines.join(first, key).withColumn("line", F.when(
            F.struct(*order) == F.col("_first"), F.concat(F.lit("﻿"), "line")).otherwise(F.col("line")))
    ranged = lines.repartitionByRange(key, *([] if whole else order)).sortWithinPartitions(key, *order)
    folder = _local_folder(lines.sparkSession, path)
    if folder:
        _write_local(ranged, folder, key)
    else:
        ranged.select(key, F.col("line").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of a path in a file system that all machines have mounted; null for any other store."""
    home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    found = re.fullmatch(r"(?:file:(?://[^/]*)?)?(/.*)", path, re.DOTALL)
    return found[1].rstrip("/") if found and (path.startswith("file:") or home.startswith("file:")) else None


def _write_local(ranged: DataFrame, folder: str, key: str) -> None:
    """The layout of Spark's own writer, ``<key>=<value>/part-<range>.txt``, with one folder and one file made a document.

    Hadoop's local file system starts a process ``chmod`` for each folder, file and checksum file. Here the tasks write their
    sorted rows to files themselves, beside the folder; it gets its name when all tasks are done. A task that runs again
    writes the same files anew.
    """
    making = f"{folder}.{uuid.uuid4().hex[:12]}.making"

    def write(batches):
        task, files = TaskContext.get(), 0

        def folder_of(value):
            return f"{key}=" + re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda c: f"%{ord(c[0]):02X}", value or "__HIVE_DEFAULT_PARTITION__")

        def runs():
            for batch in batches:
                start, encoded = 0, pc.run_end_encode(batch.column(0))
                for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
                    yield folder_of(value), batch.column(1).slice(start, end - start).to_pylist()
                    start = end

        for name, held in groupby(runs(), lambda run: run[0]):
            own = f"{making}/{name}"
            os.makedirs(own, exist_ok=True)
            with open(f"{own}/.{task.taskAttemptId()}", "wb") as out:
                for _, texts in held:
                    out.writelines(texts)
            os.replace(out.name, f"{own}/part-{task.partitionId():05d}.txt")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    line = F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).cast("binary")
    os.makedirs(making)
    try:
        ranged.select(F.col(key).cast("string"), line).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
        open(f"{making}/_SUCCESS", "w").close()
        shutil.rmtree(folder, ignore_errors=True)
        os.rename(making, folder)
    except BaseException:
        shutil.rmtree(making, ignore_errors=True)
        raise


def write_shards(lines: DataFrame, path: str, order: list[str], shards: int, key: str = "doc_id") -> DataFrame:
    """Write report lines into a bounded number of files, whatever the number of documents, and where each is: the index.

    The lines are cut into ``shards`` ranges of about equal length; each is one sorted file in ``shard=<n>``. The index
    (``key``, shard, first_line, lines) is written to ``_index`` beside them and returned: a document may go on in the next shard.
    """
    ranged = lines.repartitionByRange(shards, key, *order).withColumn("shard", F.spark_partition_id())
    held = cut_lineage(ranged.sortWithinPartitions("shard", key, *order))
    height = F.length("line") - F.length(F.replace("line", F.lit("\n"))) + 1  # a value may hold line feeds
    upto = F.sum(height).over(Window.partitionBy("shard").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held.sortWithinPartitions("shard", key, *order).select("shard", F.col("line").alias("value")).write.mode("overwrite").partitionBy("shard").text(path)
    (held.withColumns({"_at": upto - height, "_n": height}).groupBy(key, "shard").agg(F.min("_at").alias("first_line"), F.sum("_n").alias("lines"))
     .write.mode("overwrite").parquet(f"{path}/_index"))
    return held.sparkSession.read.parquet(f"{path}/_index")

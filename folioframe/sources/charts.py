"""Chart series from the cached points of chart parts (XML files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CACHE = "struct<ptCount:struct<_val:int>,pt:array<struct<_idx:int,v:string>>>"
_REF = f"struct<strRef:struct<strCache:{_CACHE}>,numRef:struct<numCache:{_CACHE}>,numLit:{_CACHE},strLit:{_CACHE}>"
SCHEMA = f"idx struct<_val:int>, tx {_REF}, cat {_REF}, val {_REF}, xVal {_REF}, yVal {_REF}"


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, series, name, idx, cat, val, x): a row for every position of a series, null where a point is missing."""
    rows = (spark.read.format("xml").option("rowTag", "ser").option("ignoreNamespace", "true").option("attributePrefix", "_")
            .schema(SCHEMA).load(path).withColumn("path", F.input_file_name()))
    return series_points(rows)


def series_points(rows: DataFrame) -> DataFrame:
    def cache(name):
        c = F.col(name)
        return F.coalesce(c["numRef"]["numCache"], c["strRef"]["strCache"], c["numLit"], c["strLit"])

    value = F.when(cache("val").isNotNull(), cache("val")).otherwise(cache("yVal"))
    caches = {"_v": value, "_c": cache("cat"), "_x": cache("xVal"), "_n": cache("tx")}
    ready = rows.withColumns(caches)

    def at(name, i):
        kept = F.filter(F.col(name)["pt"], lambda p: F.coalesce(p["_idx"], F.lit(0)) == i)
        return F.when(i < F.coalesce(F.col(name)["ptCount"]["_val"], F.lit(0)), F.get(F.transform(kept, lambda p: p["v"]), F.lit(0)))

    count = F.greatest(*[F.coalesce(F.col(n)["ptCount"]["_val"], F.lit(0)) for n in ("_v", "_c", "_x")])
    spread = ready.withColumn("i", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    i = F.col("i")
    return spread.select(
        "path", F.col("idx._val").alias("series"), F.coalesce(at("_n", F.lit(0)), F.lit("")).alias("name"), i.alias("idx"),
        at("_c", i).alias("cat"), at("_v", i).try_cast("double").alias("val"), at("_x", i).try_cast("double").alias("x"))

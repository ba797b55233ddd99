"""Quantity take-off: measurements and counts grouped by subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.labels import MEASURE_LABELS, lookup, measure_unit
from folioframe.functions.text import csv_line, number_text


def _keep(items: DataFrame) -> DataFrame:
    return items.where(F.col("measure").isNotNull() | (F.coalesce("tool", F.lit("")) == "count"))


def summarise(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per label: count, total, pages, and colour / kind / unit of the first mark (by ``seq``).

    Everything combines inside the tasks first: pages are counted per page before they are gathered.
    """
    by = list(keys or [])
    kind = F.when(F.col("tool") == "count", "count").otherwise(F.coalesce("measure.kind", F.lit("")))
    named = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise(
        F.coalesce(lookup(MEASURE_LABELS, kind), kind))
    first = F.struct(F.coalesce("style.stroke", F.lit("#888888")).alias("colour"), kind.alias("kind"),
                     measure_unit(kind, F.col("measure.unit")).alias("unit"))
    marked = _keep(items).select(*by, named.alias("label"), "page", "seq", first.alias("first"),
                                 F.coalesce("measure.value", F.lit(0.0)).alias("value"))
    per_page = marked.groupBy(*by, "label", "page").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(30,6)")).alias("v"),
        F.min_by("first", "seq").alias("f"), F.min("seq").alias("s"))
    rows = per_page.groupBy(*by, "label").agg(
        F.sum("n").alias("count"), F.round(F.sum("v").cast("double"), 4).alias("total"),
        F.array_sort(F.collect_set(F.col("page") + 1)).alias("pages"), F.min_by("f", "s").alias("f"))
    return rows.select(*by, "label", "f.colour", "f.kind", "f.unit",
                       (~F.col("f.kind").isin("count", "angle")).alias("summable"), "count", "total", "pages")


def totals(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of groups and of items."""
    return summary.groupBy(*(keys or [])).agg(F.count("*").alias("groups"), F.sum("count").alias("items"))


def panel_order(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``place``: where a label stands in the live panel, which sorts by Japanese collation."""
    order = Window.partitionBy(*(keys or [])).orderBy(F.collate("label", "ja"), "label")
    return summary.withColumn("place", F.row_number().over(order))


def summary_csv(summary: DataFrame) -> DataFrame:
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), " ")
    return summary.select("*", csv_line(*[F.col(c) for c in ("label", "kind", "count")], number_text(F.col("total")), F.col("unit"), pages,
                                        F.col("colour")).alias("line"))


def detail_csv(items: DataFrame) -> DataFrame:
    """The detail rows, with the keys (doc_id, page, y, seq) to sort by."""
    m = F.col("measure")
    return _keep(items).select(
        "doc_id", "page", F.coalesce(F.col("rect")[1], F.lit(0.0)).alias("y"), "seq",
        csv_line(F.col("page") + 1, F.coalesce("subject", F.lit("")), F.coalesce(m["kind"], F.lit("count")),
                 number_text(F.coalesce(m["value"], F.lit(1.0))), F.coalesce(m["unit"], F.lit("")), F.coalesce(m["label"], F.lit("")),
                 F.coalesce("contents", F.lit(""))).alias("line"))


# Fixed values.
SUMMARY_HEADER = ["分類", "種別", "個数", "合計", "単位", "ページ", "色"]
DETAIL_HEADER = ["ページ", "分類", "種別", "値", "単位", "表示", "コメント"]


def report_csv(items: DataFrame) -> DataFrame:
    """The take-off file of each document as sorted lines (doc_id, part, label, page, y, seq, line).

    Parts: 0 header, 1 summary, 2 blank line and second header, 3 details.
    """
    kept = _keep(items)
    blank = F.lit("")
    no_row = [F.lit(0).alias("page"), F.lit(0.0).alias("y"), blank.alias("seq")]
    rows = summary_csv(summarise(items, ["doc_id"])).select("doc_id", F.lit(1).alias("part"), "label", *no_row, "line")
    heads = kept.select("doc_id").distinct().select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("0").alias("label"), F.lit(",".join(SUMMARY_HEADER)).alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("0").alias("label"), blank.alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("1").alias("label"), F.lit(",".join(DETAIL_HEADER)).alias("line")))).alias("h"))
    details = detail_csv(items).select("doc_id", F.lit(3).alias("part"), blank.alias("label"), "page", "y", F.col("seq").cast("string").alias("seq"), "line")
    return heads.select("doc_id", "h.part", "h.label", *no_row, "h.line").unionByName(rows).unionByName(details)

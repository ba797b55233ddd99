"""Form fields: filling, collating, import and export, detection of fields on ruled paper, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import csv_field, csv_line, escape_fdf, unescape_fdf
from folioframe.operators.scale import running_through
from folioframe.session import cut_lineage


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Set values by (doc_id, name); every widget of a name is filled. Adds ``filled``."""
    incoming = values.select("doc_id", "name", F.col("value").alias("_new"), F.lit(True).alias("filled"))
    return (fields.join(incoming, ["doc_id", "name"], "left")
            .withColumn("value", F.when(F.col("filled"), F.col("_new")).otherwise(F.col("value")))
            .withColumn("filled", F.coalesce("filled", F.lit(False))).drop("_new"))


def upsert_fields(fields: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Add or replace field rows and take others out, by (doc_id, page, seq)."""
    keys = ["doc_id", "page", "seq"]
    gone = changed.select(*keys).unionByName(removed.select(*keys))
    return fields.join(gone, keys, "left_anti").unionByName(changed)


def name_order(fields: DataFrame) -> DataFrame:
    """(name, position): field names in the order they are first seen, from one; ranked range by range, none collected."""
    seen = _named(fields).groupBy("name").agg(F.min(F.struct("doc_id", "page", "seq")).alias("at"))
    return running_through(seen, "at", F.lit(1), "position").select("name", F.col("position").cast("int").alias("position"))


def _named(fields: DataFrame) -> DataFrame:
    return fields.where(F.coalesce("name", F.lit("")) != "")


def collate_cells(fields: DataFrame) -> DataFrame:
    """(doc_id, position, name, value): the answers of all forms, a row each. The last value of a repeated name wins."""
    value = F.coalesce("value", F.lit(""))
    last = _named(fields).groupBy("doc_id", "name").agg(F.max_by(value, F.struct("page", "seq")).alias("value"))
    return last.join(name_order(fields), "name").select("doc_id", "position", "name", "value")


def collate_lines(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """The collation as CSV lines (part, doc_id, line): the header, then one line a form, missing answers empty.

    ``labels`` is (doc_id, name), the first column. A line is as long as there are names; no task holds two at once.
    """
    cells = cut_lineage(collate_cells(fields))
    names = cells.select("position", "name").distinct()
    head = names.agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("ns"))
    title = head.select(F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("doc_id"), F.concat_ws(
        ",", F.lit("ファイル"), F.transform("ns", lambda n: csv_field(n["name"]))).alias("line"))
    answers = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("vs"))
    wide = labels.join(answers, "doc_id", "left").crossJoin(F.broadcast(head.select(F.size("ns").alias("n"))))
    value = F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: csv_field(F.coalesce(F.col("vs")[p], F.lit(""))))
    rows = wide.select(F.lit(1).alias("part"), "doc_id", F.concat_ws(",", csv_field(F.col("name")), F.when(F.col("n") > 0, value)).alias("line"))
    return title.unionByName(rows)


def collate(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per form, one column for each of the given names, missing as empty; ``collate_cells`` takes any names."""
    value = F.coalesce("value", F.lit(""))
    last = _named(fields).groupBy("doc_id", "name").agg(F.max_by(value, F.struct("page", "seq")).alias("value"))
    return last.groupBy("doc_id").pivot("name", names).agg(F.first("value")).na.fill("", names)


# Fixed values.
CSV_HEADER = ["フィールド名", "種別", "値", "ページ", "必須", "読み取り専用"]


def csv_lines(fields: DataFrame) -> DataFrame:
    """The form data CSV: a header per document and one line per field, with the keys to sort by."""
    head = fields.select("doc_id").distinct().select(
        "doc_id", F.lit(-1).alias("page"), F.lit(-1).alias("seq"), F.lit(",".join(CSV_HEADER)).alias("line"))
    flag = {c: F.when(F.col(c), "○").otherwise("") for c in ("required", "read_only")}
    return head.unionByName(fields.select("doc_id", "page", "seq", csv_line(
        F.col("name"), F.col("type"), F.coalesce("value", F.lit("")), F.col("page") + 1, flag["required"],
        flag["read_only"]).alias("line")))


def fdf_lines(fields: DataFrame, names: DataFrame) -> DataFrame:
    """FDF as sorted lines (doc_id, part, page, seq, line); buttons and signatures stay out."""
    body = fields.where(~F.col("type").isin("button", "signature")).select(
        "doc_id", F.lit(1).alias("part"), "page", "seq",
        F.concat(F.lit("<< /T ("), escape_fdf(F.col("name")), F.lit(") /V ("),
                 escape_fdf(F.coalesce("value", F.lit(""))), F.lit(") >>")).alias("line"))
    head = names.select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("page"), F.posexplode(F.array(
        F.lit("%FDF-1.2"), F.lit("1 0 obj"), F.lit("<< /FDF << /Fields ["))).alias("seq", "line"))
    tail = names.select("doc_id", F.lit(2).alias("part"), F.lit(0).alias("page"), F.posexplode(F.array(
        F.concat(F.lit("] /F ("), escape_fdf(F.col("name")), F.lit(") >> >>")), F.lit("endobj"), F.lit("trailer"),
        F.lit("<< /Root 1 0 R >>"), F.lit("%%EOF"))).alias("seq", "line"))
    return head.unionByName(body).unionByName(tail)


def json_values(fields: DataFrame) -> DataFrame:
    """The last value of every name, as (doc_id, at, line): a JSON member a row, in order of first sight."""
    named = fields.where(F.coalesce("name", F.lit("")) != "")
    at = F.struct("page", "seq")
    rows = named.groupBy("doc_id", "name").agg(
        F.max_by(F.struct("value"), at).alias("v"), F.min(at).alias("at"))
    return rows.select("doc_id", "at.page", "at.seq", F.regexp_extract(
        F.to_json(F.create_map("name", F.col("v.value"))), r"(?s)^\{(.*)\}$", 1).alias("line"))


def read_values(texts: DataFrame) -> DataFrame:
    """(doc_id, text) of FDF or JSON to (doc_id, name, value); JSON where the text starts with a brace.

    An FDF string ends at its first closing parenthesis, even an escaped one; the last value of a name wins.
    """
    json = F.ltrim("text").startswith("{")
    pairs = F.when(json, F.map_entries(F.from_json("text", "map<string,string>")))
    from_json = texts.where(json).select("doc_id", F.posexplode(pairs).alias("at", "p")).select(
        "doc_id", "at", "p.key", "p.value")
    chunks = F.slice(F.split("text", r"/T \("), 2, 2147483647)
    name = F.substring_index("chunk", ")", 1)
    rest = F.substring(F.col("chunk"), F.length(name) + 2, F.length("chunk"))
    from_fdf = (texts.where(~json).select("doc_id", F.posexplode(chunks).alias("at", "chunk"))
                .select("doc_id", "at", unescape_fdf(name).alias("key"), rest.alias("rest"))
                .where(F.contains("rest", F.lit("/V (")))
                .select("doc_id", "at", "key", unescape_fdf(F.substring_index(F.element_at(F.split("rest", r"/V \("), 2), ")", 1)
                                                            ).alias("value")))
    return from_json.unionByName(from_fdf).groupBy("doc_id", F.col("key").alias("name")).agg(
        F.max_by("value", "at").alias("value"))


def detect(drawings: DataFrame, height: float = 18.0) -> DataFrame:
    """Fields on ruled paper: rules to write above, boxes to write in; of two that overlap the upper left stays.

    The greedy choice runs inside a page, over its candidate boxes only.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rule, box = h <= 2, h.between(12, 40) & (w > 60)
    found = drawings.where((w >= 40) & (rule | box)).select("doc_id", "page", F.struct(
        F.bround(F.when(rule, F.col("y0") - height).otherwise(F.col("y0"))).alias("ry"), F.col("x0"),
        F.when(rule, F.col("y0") - height).otherwise(F.col("y0")).alias("y0"), F.col("x1"),
        F.when(rule, F.col("y0")).otherwise(F.col("y1")).alias("y1")).alias("b"))
    kind = "array<struct<ry:double,x0:double,y0:double,x1:double,y1:double>>"

    def take(kept, b):
        clash = F.exists(kept, lambda k: ~((b["x1"] < k["x0"]) | (b["x0"] > k["x1"]) | (b["y1"] < k["y0"]) | (b["y0"] > k["y1"])))
        return F.when(clash, kept).otherwise(F.array_append(kept, b))

    pages = found.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return pages.select("doc_id", "page", F.posexplode(F.aggregate("bs", F.array().cast(kind), take)).alias("seq", "b")).select(
        "doc_id", "page", "seq", F.lit("text").alias("type"), "b.x0", "b.y0", "b.x1", "b.y1")


def signature_state(fields: DataFrame) -> DataFrame:
    """Signature fields and how many of them are signed, per document."""
    return fields.where(F.col("type") == "signature").groupBy("doc_id").agg(
        F.count("*").alias("fields"), F.count_if(F.coalesce("value", F.lit("")) != "").alias("signed"))

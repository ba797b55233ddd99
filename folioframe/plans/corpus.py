"""Layout tables derived from the given tables, in Spark and as SQL text for the check.

Text is set 80 characters to a line and 20 lines to a page. Every wrapped line keeps its whole text, so the
layout grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import let
from folioframe.operators.scale import by_key, spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


# Declared, so that opening a table starts no job.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    table = reader.parquet(f"{folder}/{name}.parquet")
    return spread(table, "l_orderkey", "l_linenumber") if name == "lineitem" else table


def i32(column):
    return column.cast("int")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(load(spark, folder, "documents").select("doc_id", *(columns or ("text",))), "doc_id")


# ---------------------------------------------------------------- lines and spans

def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ln, text): one row per text line of a document."""
    return documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text"))


LINES = """
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS ln, unnest(parts) AS text
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def wrapped(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n, ln, piece, text): every line cut into pieces of 80 characters, numbered through the document and the line."""
    def pieces(line, ln):
        cut = F.when(line == "", F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(r"(?s).{1,80}"), F.lit(0)))
        return F.transform(cut, lambda piece, i: F.struct(ln.alias("ln"), i.alias("piece"), piece.alias("text")))

    return (documents(spark, folder)
            .select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n"), pieces))).alias("n", "piece"))
            .select("doc_id", "n", "piece.ln", "piece.piece", "piece.text"))


WRAPPED = LINES + """,
wrapped AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, piece) - 1 AS n, ln, piece,
                   substr(text, piece * 80 + 1, 80) AS text
            FROM (SELECT doc_id, ln, text,
                         unnest(generate_series(0, greatest((length(text) + 79) // 80, 1) - 1)) AS piece FROM lines))"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """One span per visual line, blank lines left out (they keep their place on the page)."""
    n = F.col("n")
    k = n % 20
    size = F.when(k == 0, 18.0).when(n % 7 == 3, 12.5).otherwise(11.0)
    bold = (size > 11) | (n % 9 == 5)
    placed = wrapped(spark, folder).where(F.col("text") != "").select(
        "doc_id", i32(F.floor(n / 20)).alias("page"), i32(F.floor(k / 4)).alias("block"), k.alias("line"),
        F.lit(0).alias("span"), "text", size.alias("size"),
        F.when(bold, F.lit("NOTOAA+NotoSans-Bold")).otherwise(F.lit("NOTOAA+NotoSans")).alias("font"),
        F.when(bold, 16).otherwise(0).alias("flags"), F.lit(0).alias("color"),
        (60.0 + 10 * (n % 3)).alias("x0"), (40.0 + 183 * F.floor(k / 4) + 14 * (k % 4)).alias("y0"),
        F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"), F.lit(None).cast("string").alias("link"))
    return placed.withColumns({"x1": F.col("x0") + F.col("size") * 0.5 * F.length("text"),
                               "y1": F.col("y0") + F.col("size")})


SPANS = WRAPPED + """,
span0 AS (SELECT doc_id, CAST(n // 20 AS INTEGER) AS page, CAST((n % 20) // 4 AS INTEGER) AS block,
                 CAST(n % 20 AS INTEGER) AS line, 0 AS span, text,
                 CAST(CASE WHEN n % 20 = 0 THEN 18.0 WHEN n % 7 = 3 THEN 12.5 ELSE 11.0 END AS DOUBLE) AS size,
                 n % 9 = 5 AS b9, CAST(60 + 10 * (n % 3) AS DOUBLE) AS x0,
                 CAST(40 + 183 * ((n % 20) // 4) + 14 * ((n % 20) % 4) AS DOUBLE) AS y0
          FROM wrapped WHERE text <> ''),
span AS MATERIALIZED (SELECT *, CASE WHEN size > 11 OR b9 THEN 16 ELSE 0 END AS flags, x0 + size * 0.5 * length(text) AS x1,
                y0 + size AS y1 FROM span0)"""


def chars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per character of every span, with its box."""
    return span_chars(spans(spark, folder))


def span_chars(placed: DataFrame) -> DataFrame:
    half = F.col("size") * 0.5
    return (placed
            .select("doc_id", "page", "block", "line", "size", "x0", "y0", "y1",
                    F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("seq", "c"))
            .select("doc_id", "page", "block", "line", "seq", "c", (F.col("x0") + half * F.col("seq")).alias("x0"),
                    "y0", (F.col("x0") + half * (F.col("seq") + 1)).alias("x1"), "y1"))


def runs(placed: DataFrame) -> DataFrame:
    """The spans as runs of characters, for ``centres``."""
    return placed.select("doc_id", "page", "block", "line", F.lit(0).alias("seq"), "text", ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "size",
                         F.col("x0").alias("left"))


def centres():
    """Centres of the characters of ``runs``."""
    half = F.col("size") * 0.5
    return F.transform(F.sequence(F.lit(0), F.length("text") - 1),
                       lambda i: ((F.col("left") + half * i) + (F.col("left") + half * (i + 1))) / 2)


CHARS = SPANS + """,
chars AS (SELECT doc_id, page, block, line, seq, substr(text, seq + 1, 1) AS c,
                 bx + size * 0.5 * seq AS x0, y0, bx + size * 0.5 * (seq + 1) AS x1, y1
          FROM (SELECT doc_id, page, block, line, text, size, x0 AS bx, y0, y1,
                       CAST(unnest(generate_series(0, length(text) - 1)) AS INTEGER) AS seq FROM span))"""


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Every visual line cut at its spaces into word spans; a wide gap before each sixth word makes columns.

    Lines go to the task of their page before they are cut: a line is far shorter than the spans of its words.
    """
    cut = by_key(spans(spark, folder), "doc_id", "page").select(
        "doc_id", "page", "block", "line", "size", "font", "flags", "color", "y0", "y1", F.col("x0").alias("left"), F.col("text").alias("whole"),
        F.posexplode(F.split("text", " ")).alias("span", "text"))
    i = F.col("span")
    before = F.when(i > 0, F.length(F.call_function("substring_index", "whole", F.lit(" "), i)) + 1).otherwise(0)
    x0 = F.col("left") + F.col("size") * 0.5 * before + 20.0 * F.floor(i / 6)
    return (cut.where(F.col("text") != "").withColumn("x0", x0).withColumn("x1", F.col("x0") + F.col("size") * 0.5 * F.length("text"))
            .select("doc_id", "page", "block", "line", "span", "text", "font", "size", "flags", "color", "x0", "y0", "x1", "y1"))


def word_blocks(spark: SparkSession, folder: str, many: int) -> DataFrame:
    """(doc_id, page, block, spans): so many words of a visual line are a block, and each word of it a line of its own.

    Lines of documents that come twice share their blocks, as their words do where they are rows.
    """
    def word(line, text, i):
        before = F.when(i > 0, F.length(F.call_function("substring_index", line["text"], F.lit(" "), i)) + 1).otherwise(0)
        x0 = line["x0"] + line["size"] * 0.5 * before + 20.0 * F.floor(i / 6)
        return let(x0, lambda x: F.struct(i.alias("line"), i.alias("span"), text.alias("text"), line["size"].alias("size"), x.alias("x0"), line["y0"].alias("y0"),
                                          (x + line["size"] * 0.5 * F.length(text)).alias("x1"), line["y1"].alias("y1")))

    lines = by_key(spans(spark, folder), "doc_id", "page").groupBy("doc_id", "page", "line").agg(F.collect_list(F.struct("text", "size", "x0", "y0", "y1")).alias("ls"))
    split = F.transform("ls", lambda r: F.struct(F.split(r["text"], " ").alias("parts"), *[r[c].alias(c) for c in ("text", "size", "x0", "y0", "y1")]))
    cut = lines.select("doc_id", "page", "line", F.explode(F.array(split)).alias("ls"))
    last = F.floor((F.array_max(F.transform("ls", lambda r: F.size(r["parts"]))) - 1) / many).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda g: F.struct((F.col("line") * 100 + g).alias("block"), F.flatten(F.transform("ls", lambda r: F.transform(
        F.slice(r["parts"], g * many + 1, many), lambda text, i: word(r, text, g * many + i)))).alias("spans")))
    return cut.select("doc_id", "page", F.explode(blocks).alias("b")).select("doc_id", "page", "b.block", "b.spans")


WORDS = SPANS + """,
word0 AS (SELECT doc_id, page, block, line, size, flags, bx, y0, y1, unnest(parts) AS text,
                 CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS span
          FROM (SELECT doc_id, page, block, line, size, flags, x0 AS bx, y0, y1, string_split(text, ' ') AS parts
                FROM span)),
word1 AS (SELECT *, bx + size * 0.5 * (coalesce(sum(length(text) + 1) OVER (
                        PARTITION BY doc_id, page, line ORDER BY span
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) + 20.0 * (span // 6) AS x0 FROM word0),
word AS (SELECT doc_id, page, block, line, span, text, size, flags, CAST(x0 AS DOUBLE) AS x0, y0,
                CAST(x0 + size * 0.5 * length(text) AS DOUBLE) AS x1, y1 FROM word1 WHERE text <> '')"""


def page_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of a document, also pages whose lines are all blank."""
    total = F.octet_length("text")
    return (wrapped(spark, folder)
            .groupBy("doc_id", i32(F.floor(F.col("n") / 20)).alias("page")).agg(F.sum(total).alias("bytes"))
            .select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
                    i32(90 * (F.col("doc_id") % 4)).alias("rotation"), "bytes"))


PAGE = WRAPPED + """,
page AS (SELECT doc_id, CAST(n // 20 AS INTEGER) AS page, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height,
                CAST(90 * (doc_id % 4) AS INTEGER) AS rotation, CAST(sum(strlen(text)) AS BIGINT) AS bytes
         FROM wrapped GROUP BY 1, 2, 5)"""


def mixed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same pages on mixed paper: every third one landscape, every seventh small."""
    m = F.col("doc_id") + F.col("page")
    return page_table(spark, folder).withColumns({
        "width": F.when(m % 7 == 2, 300.0).when(m % 3 == 1, 842.0).otherwise(595.0),
        "height": F.when(m % 7 == 2, 400.0).when(m % 3 == 1, 595.0).otherwise(842.0)})


MIXED = PAGE + """,
mixed AS (SELECT doc_id, page, rotation, bytes,
                 CASE WHEN (doc_id + page) % 7 = 2 THEN 300.0::DOUBLE WHEN (doc_id + page) % 3 = 1 THEN 842.0 ELSE 595.0 END AS width,
                 CASE WHEN (doc_id + page) % 7 = 2 THEN 400.0::DOUBLE WHEN (doc_id + page) % 3 = 1 THEN 595.0 ELSE 842.0 END AS height,
                 count(*) OVER (PARTITION BY doc_id) AS n FROM page)"""


# ---------------------------------------------------------------- annotations, replies, measures

STATE_OF_EVENT = {"purchase": "accepted", "error": "rejected", "signup": "completed", "view": "cancelled"}
TYPE_OF_NUMBER = ["highlight", "freetext", "note", "square", "ink", "polygon", "stamp", "redact", "popup", "underline"]


def annots(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    x0, y0 = (e % 50) * 10.0, (e % 37) * 20.0
    state = F.create_map(*[F.lit(v) for kv in STATE_OF_EVENT.items() for v in kv])
    kind = F.array(*[F.lit(t) for t in TYPE_OF_NUMBER])
    return load(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), e.cast("string").alias("id"), i32(e % 30).alias("page"),
        F.element_at(kind, i32(e % 10 + 1)).alias("type"),
        F.array(x0, y0, x0 + 40.0, y0 + 12.0).alias("rect"),
        F.when(e % 10 == 1, F.concat(F.lit("Box "), e.cast("string"))).otherwise(F.lit("")).alias("text"),
        F.col("props").alias("contents"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("author"),
        F.when(e % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("topic "), (e % 11).cast("string"))).alias("subject"),
        F.col("ts").cast("timestamp_ntz").alias("created"), state[F.col("event_type")].alias("state"),
        (e % 3 == 0).alias("checked"),
        F.when(e % 5 == 0, "#ffeb3b").when(e % 5 == 1, "#E0403A").otherwise("#4d8dff").alias("stroke"),
        F.col("value"), F.col("event_type"), e.alias("event_id"))


ANNOT = """
annot AS (SELECT user_id AS doc_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id % 30 AS INTEGER) AS page,
                 (['highlight','freetext','note','square','ink','polygon','stamp','redact','popup','underline'])[event_id % 10 + 1] AS type,
                 (event_id % 50) * 10.0::DOUBLE AS x0, (event_id % 37) * 20.0::DOUBLE AS y0,
                 CASE WHEN event_id % 10 = 1 THEN 'Box ' || event_id ELSE '' END AS text, props AS contents,
                 'u' || (user_id % 7) AS author,
                 CASE WHEN event_id % 4 = 0 THEN '' ELSE 'topic ' || (event_id % 11) END AS subject, ts AS created,
                 CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected'
                      WHEN 'signup' THEN 'completed' WHEN 'view' THEN 'cancelled' END AS state,
                 event_id % 3 = 0 AS checked,
                 CASE event_id % 5 WHEN 0 THEN '#ffeb3b' WHEN 1 THEN '#E0403A' ELSE '#4d8dff' END AS stroke,
                 value, event_type, event_id
          FROM events)"""


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement marks: lineitem rows by order, kind by return flag."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "area").when(flag == "N", "distance").otherwise("count")
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("S-"), F.col("l_linestatus")))
        .alias("subject"),
        F.when(kind == "count", "count").otherwise("measure").alias("tool"),
        F.struct(kind.alias("kind"), F.col("l_quantity").alias("value"), F.lit("m").alias("unit"),
                 F.concat(F.col("l_quantity").cast("string"), F.lit(" m")).alias("label")).alias("measure"),
        F.lit("").alias("contents"), F.array(F.col("l_tax"), F.col("l_discount")).alias("rect"),
        F.struct(F.concat(F.lit("#00"), flag).alias("stroke")).alias("style"),
        F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"),
                    F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
                    F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("seq"),
        "l_partkey", "l_suppkey", "l_shipdate")


MEASURE = """
meas AS (SELECT l_orderkey AS doc_id, l_linenumber AS page,
                CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'S-' || l_linestatus END AS subject,
                CASE l_returnflag WHEN 'A' THEN 'area' WHEN 'N' THEN 'distance' ELSE 'count' END AS kind,
                l_quantity AS value, '#00' || l_returnflag AS stroke, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || l_linenumber || '/' || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
                || '/' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS seq,
                l_tax, l_discount FROM lineitem)"""


def fields(spark: SparkSession, folder: str) -> DataFrame:
    """Form fields: part rows unpivoted, four widgets per form."""
    return load(spark, folder, "part").selectExpr(
        "p_partkey AS doc_id",
        "stack(4, 0, 'brand', 'text', p_brand, 1, 'type', 'dropdown', p_type, "
        "2, 'size', 'text', cast(p_size AS string), 3, 'seal', 'signature', "
        "CASE WHEN p_size % 2 = 0 THEN p_name END) AS (seq, name, type, value)",
        "p_size", "cast(p_partkey % 3 AS int) AS page").selectExpr(
        "doc_id", "page", "cast(seq AS int) AS seq", "name", "type", "value", "p_size % 5 = 0 AS required",
        "p_size % 7 = 0 AS read_only")


FIELD = """
field AS (SELECT p_partkey AS doc_id, CAST(p_partkey % 3 AS INTEGER) AS page, seq, name, type, value,
                 p_size % 5 = 0 AS required, p_size % 7 = 0 AS read_only
          FROM (SELECT p_partkey, p_size, 0 AS seq, 'brand' AS name, 'text' AS type, p_brand AS value FROM part
                UNION ALL SELECT p_partkey, p_size, 1, 'type', 'dropdown', p_type FROM part
                UNION ALL SELECT p_partkey, p_size, 2, 'size', 'text', CAST(p_size AS VARCHAR) FROM part
                UNION ALL SELECT p_partkey, p_size, 3, 'seal', 'signature',
                                 CASE WHEN p_size % 2 = 0 THEN p_name END FROM part))"""


def edit_events(spark: SparkSession, folder: str) -> DataFrame:
    """The edit log: events of a user in order of their id."""
    return load(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        (F.col("event_id") % 20).cast("string").alias("annot_id"),
        F.when(F.col("value") > 20, F.col("event_type")).alias("merge_token"),
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("before"),
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("after"))


EDIT = """
edit AS (SELECT user_id AS doc_id, event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
                CAST(event_id % 20 AS VARCHAR) AS annot_id, CASE WHEN value > 20 THEN event_type END AS merge_token,
                'b' || event_id AS before, 'a' || event_id AS after FROM events)"""

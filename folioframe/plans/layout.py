"""Registered queries of layout reconstruction."""

from pyspark.sql import functions as F

from folioframe.operators import documents as D
from folioframe.operators import layout as Y
from folioframe.plans import corpus
from folioframe.plans.registry import query, sql


def _spans(spark, folder):
    return corpus.spans(spark, folder)


def _line_blocks(spark, folder):
    """Every visual line as a block of its own, as many producers write them."""
    return _spans(spark, folder).withColumn("block", F.col("line"))


# ---------------------------------------------------------------- runs and rows

@query("style_runs", sql(corpus.WORDS, """
SELECT doc_id, page, line, run - 1 AS span, string_agg(text, '' ORDER BY span) AS text, min(x0) AS x0, max(x1) AS x1 FROM (
 SELECT *, CAST(sum(CASE WHEN abs(x0 - px) < size * 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line ORDER BY span) AS BIGINT) AS run FROM (
  SELECT *, lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY span) AS px FROM word)) GROUP BY 1, 2, 3, 4"""))
def style_runs(spark, folder):
    words = corpus.words(spark, folder).withColumn("link", F.lit(None).cast("string"))
    return Y.merge_runs(words).select("doc_id", "page", "line", "span", "text", "x0", "x1")


_FILL = """
gapped AS (SELECT *, lag(x1) OVER w AS px, lag(size) OVER w AS ps, lag(text) OVER w AS pt FROM word WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, span)),
filled AS (SELECT *, CASE WHEN px IS NULL THEN '' WHEN x0 - px > greatest(size, ps) * 1.5 THEN chr(9) WHEN x0 - px > greatest(size, ps) * 0.8 THEN '　'
                  WHEN x0 - px > greatest(size, ps) * 0.3 THEN ' ' ELSE '' END AS filler FROM gapped)"""


def _single_words(spark, folder):
    """Every word a line of its own, so that the rows have to be found again."""
    return corpus.words(spark, folder).withColumn("line", F.col("line") * 100 + F.col("span"))


def _rows(spark, folder):
    return Y.merge_baselines(_single_words(spark, folder))


def _whole_rows(spark, folder):
    return Y.gapped_rows(Y.joined_baselines(_single_words(spark, folder)))


@query("baseline_rows", sql(corpus.WORDS + "," + _FILL, """
SELECT doc_id, page, block, dense_rank() OVER (PARTITION BY doc_id, page, block ORDER BY line) - 1 AS row, text, x0, x1 FROM (
 SELECT doc_id, page, block, line, string_agg(filler || text, '' ORDER BY x0, span) AS text, min(x0) AS x0, max(x1) AS x1 FROM filled GROUP BY 1, 2, 3, 4)"""))
def baseline_rows(spark, folder):
    return Y.row_texts(_rows(spark, folder)).select("doc_id", "page", "block", "row", "text", "x0", "x1")


@query("row_blocks", sql(corpus.WORDS, """
SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS row, words, x0, x1 FROM (
 SELECT doc_id, page, line, count(*) AS words, min(x0) AS x0, max(x1) AS x1 FROM word GROUP BY 1, 2, 3)"""))
def row_blocks(spark, folder):
    words = corpus.words(spark, folder)
    blocks = Y.blocks_of(Y.lines_of(words.withColumn("block", F.col("line") * 100 + F.col("span"))))
    return Y.merge_row_blocks(blocks).select("doc_id", "page", "row", F.size("blocks").alias("words"), "x0", "x1")


_ITEM = r"^(?:[・•●○▪■◆◇★☆※\-–—‣◦▶▷]|[（(]?[0-9]+[.)）．、]|[①-⑳]|[（(][0-9a-zA-Zぁ-んァ-ン一-龥０-９]+[）)])"


@query("paragraphs", sql(corpus.SPANS, f"""
SELECT doc_id, page, CAST(para - 1 AS BIGINT) AS para, count(*) AS lines, min(y0) AS y0, max(y1) AS y1, max(x1) AS x1 FROM (
 SELECT *, sum(CASE WHEN ps IS NOT NULL AND abs(ps - size) <= 0.6 AND y0 - py BETWEEN -0.3 * ps AND 0.7 * ps AND px >= edge - 1.5 * ps
   AND NOT regexp_matches(ltrim(text), '{_ITEM}') AND x0 >= round(plx) - 2 AND (pb > 0) = (flags > 0) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS para FROM (
  SELECT *, lag(size) OVER w AS ps, lag(y1) OVER w AS py, lag(x1) OVER w AS px, lag(x0) OVER w AS plx, lag(CASE WHEN trim(text) = '' THEN 0 ELSE flags END) OVER w AS pb,
         max(CASE WHEN length(trim(text)) >= 15 THEN x1 END) OVER (PARTITION BY doc_id, page) AS edge FROM span WINDOW w AS (PARTITION BY doc_id, page ORDER BY line))) GROUP BY 1, 2, 3"""))
def paragraphs(spark, folder):
    blocks = Y.blocks_of(Y.lines_of(_line_blocks(spark, folder)))
    return Y.merge_paragraphs(blocks).select("doc_id", "page", "para", F.size("blocks").cast("bigint").alias("lines"), "y0", "y1", "x1")


_BULLET = r"^(?:[・•●○▪■◆◇★☆※\-–—‣◦▶▷]|[（(]?[0-9]+[.)）．、]|[①-⑳]|[（(][0-9a-zA-Zぁ-んァ-ン一-龥０-９]+[）)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.．、]?)"


@query("block_texts", sql(corpus.SPANS, f"""
SELECT doc_id, page, block, string_agg(CASE WHEN nt IS NULL THEN text WHEN hard THEN text || chr(10)
   WHEN rtrim(text) LIKE '%-' AND regexp_matches(nt, '^\\p{{Ll}}') THEN substr(rtrim(text), 1, length(rtrim(text)) - 1)
   WHEN rtrim(text) <> '' AND nt <> '' THEN text || ' ' ELSE text END, '' ORDER BY line) AS text FROM (
 SELECT *, regexp_matches(nt, '{_BULLET}') OR (rgt - x1 >= ww + size * 0.3 AND rgt - x1 > size * 1.2) AS hard FROM (
  SELECT *, CASE WHEN nt = '' THEN 0 WHEN w <> '' THEN length(w) * size * 0.55 ELSE size END AS ww FROM (
   SELECT *, regexp_extract(nt, '^[A-Za-z0-9’''\\-.,:;/%$#@&+=_()\\[\\]]+') AS w FROM (
    SELECT doc_id, page, block, line, text, x1, CASE WHEN trim(text) = '' THEN 10.0 ELSE size END AS size, max(x1) OVER (PARTITION BY doc_id, page, block) AS rgt,
           ltrim(lead(text) OVER (PARTITION BY doc_id, page, block ORDER BY line)) AS nt FROM span)))) GROUP BY 1, 2, 3"""))
def block_texts(spark, folder):
    return Y.join_block_lines(Y.blocks_of(Y.lines_of(_spans(spark, folder))))


@query("block_alignment", sql(corpus.SPANS, """
SELECT doc_id, page, block, CASE WHEN count(*) < 2 OR max(x0) - min(x0) < 2 THEN 'l' WHEN max((x0 + x1) / 2) - min((x0 + x1) / 2) < 2.5 THEN 'ctr'
       WHEN max(x1) - min(x1) < 2.5 THEN 'r' ELSE 'l' END AS align FROM span GROUP BY 1, 2, 3"""))
def block_alignment(spark, folder):
    return Y.block_alignment(Y.blocks_of(Y.lines_of(_spans(spark, folder))))


@query("selection_boxes", sql(corpus.WORDS, """
SELECT doc_id, page, line, CAST(run - 1 AS BIGINT) AS part, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM (
 SELECT *, sum(CASE WHEN x0 - px < size * 0.9 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line ORDER BY x0) AS run FROM (
  SELECT *, lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0) AS px FROM word)) GROUP BY 1, 2, 3, 4"""))
def selection_boxes(spark, folder):
    """Word boxes of each visual line joined the way a selection is drawn."""
    words = corpus.words(spark, folder).select("doc_id", "page", "line", "x0", "y0", "x1", "y1")
    return Y.merge_line_rects(words, ["doc_id", "page", "line"]).select("doc_id", "page", "line", "part", "x0", "x1", "y1")


# ---------------------------------------------------------------- reading order

_TWO = corpus.SPANS + """,
el AS (SELECT doc_id, page, line AS element, CASE WHEN doc_id % 3 = 0 THEN x0 WHEN line % 9 = 4 THEN 50 WHEN line % 2 = 0 THEN 50 ELSE 320 END AS x0, y0,
              CASE WHEN doc_id % 3 = 0 THEN x1 WHEN line % 9 = 4 THEN 540 WHEN line % 2 = 0 THEN 270 ELSE 540 END AS x1, y1 FROM span)"""


def _elements(spark, folder):
    """Two documents of three set in two columns, with wide lines between."""
    d, k = F.col("doc_id") % 3 == 0, F.col("line")
    return _spans(spark, folder).select(
        "doc_id", "page", k.alias("element"), F.when(d, F.col("x0")).when((k % 9 == 4) | (k % 2 == 0), 50.0).otherwise(320.0).alias("x0"), "y0",
        F.when(d, F.col("x1")).when(k % 9 == 4, 540.0).when(k % 2 == 0, 270.0).otherwise(540.0).alias("x1"), "y1")


@query("reading_order", sql(_TWO, """,
nar AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS nn FROM el WHERE x1 - x0 < 595 * 0.55),
gut AS (SELECT doc_id, page, min(x) AS g FROM (
  SELECT doc_id, page, x FROM nar, (SELECT unnest(generate_series(178, 415, 3)) AS x) WHERE nn >= 4
  GROUP BY doc_id, page, x, nn HAVING count(*) FILTER (WHERE x1 <= x) >= 2 AND count(*) FILTER (WHERE x0 >= x) >= 2
     AND count(*) FILTER (WHERE x0 < x AND x < x1) = 0) GROUP BY 1, 2),
cls AS (SELECT el.*, g, x1 - x0 >= 595 * 0.55 OR coalesce(x0 < g AND g < x1, false) AS wide FROM el LEFT JOIN gut USING (doc_id, page)),
col AS (SELECT *, CASE WHEN wide THEN 2 WHEN x1 <= g + 1 THEN 0 ELSE 1 END AS c FROM cls),
ext AS (SELECT *, min(CASE WHEN NOT wide THEN y0 END) OVER p AS top, max(CASE WHEN NOT wide THEN y1 END) OVER p AS bottom,
               g IS NOT NULL AND bool_or(c = 0) OVER p AND bool_or(c = 1) OVER p AS two FROM col WINDOW p AS (PARTITION BY doc_id, page)),
prt AS (SELECT *, CASE WHEN wide AND y1 <= top + 2 THEN 0 WHEN wide AND y0 >= bottom - 2 THEN 2 ELSE 1 END AS part FROM ext),
bnd AS (SELECT *, (SELECT count(*) FROM prt q WHERE q.doc_id = p.doc_id AND q.page = p.page AND q.wide AND q.part = 1 AND q.two
                   AND CASE WHEN p.wide THEN (q.y0, q.element) < (p.y0, p.element) ELSE q.y0 <= p.y0 END) AS band FROM prt p)
SELECT doc_id, page, element, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN part ELSE 0 END, CASE WHEN two AND part = 1 THEN band ELSE 0 END,
       CASE WHEN two THEN c ELSE 0 END, CASE WHEN two THEN y0 ELSE round_even(y0 / 3, 0) END, CASE WHEN two THEN 0 ELSE x0 END, element) - 1 AS position FROM bnd""").replace("\n,\nnar", ",\nnar"))
def reading_order(spark, folder):
    return Y.reading_order(_elements(spark, folder), corpus.page_table(spark, folder))


@query("block_order", sql(corpus.SPANS, """
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS "order", trim(text) AS text FROM span
QUALIFY trim(text) <> ''"""))
def block_order(spark, folder):
    return Y.block_order(_line_blocks(spark, folder).select("doc_id", "page", "block", "text"))


# ---------------------------------------------------------------- body size, headings, outline

_BODY = corpus.SPANS + """,
solid AS (SELECT *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sq, length(trim(text)) AS st FROM span WHERE trim(text) <> ''),
b1 AS (SELECT doc_id, arg_max(size, (n, -size)) AS body FROM (SELECT doc_id, size, count(*) AS n FROM solid GROUP BY 1, 2) GROUP BY 1),
b2 AS (SELECT doc_id, arg_max(size, (n, -pos)) AS body FROM (SELECT doc_id, size, sum(sq) AS n, min(page * 100 + line) AS pos FROM solid GROUP BY 1, 2) GROUP BY 1),
b3 AS (SELECT doc_id, page, arg_max(size, (n, -pos)) AS body FROM (SELECT doc_id, page, size, sum(st) AS n, min(line) AS pos FROM solid GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("body_sizes", sql(_BODY, "SELECT doc_id, b1.body AS by_spans, b2.body AS by_lines FROM b1 JOIN b2 USING (doc_id)"))
def body_sizes(spark, folder):
    spans = _spans(spark, folder)
    return Y.body_size_by_spans(spans).withColumnRenamed("body", "by_spans").join(
        Y.body_size_by_lines(Y.lines_of(spans)).withColumnRenamed("body", "by_lines"), "doc_id")


@query("page_body_sizes", sql(_BODY, "SELECT doc_id, page, body FROM b3"))
def page_body_sizes(spark, folder):
    return Y.body_size_by_page(_spans(spark, folder))


@query("structure_tags", sql(_BODY, """
SELECT doc_id, tag, count(*) AS elements, CAST(sum(length(text)) AS BIGINT) AS signs FROM (
 SELECT doc_id, CASE WHEN size >= body * 1.4 THEN 'H1' WHEN size >= body * 1.15 THEN 'H2' ELSE 'P' END AS tag, trim(text) AS text FROM (
  SELECT doc_id, page, block, string_agg(text, '' ORDER BY line) AS text, max(size) AS size FROM span GROUP BY 1, 2, 3) JOIN b1 USING (doc_id) WHERE trim(text) <> '') GROUP BY 1, 2"""))
def structure_tags(spark, folder):
    spans = _spans(spark, folder)
    tags = Y.structure_tags(Y.blocks_of(Y.lines_of(spans)), Y.body_size_by_spans(spans))
    return tags.groupBy("doc_id", "tag").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("signs"))


@query("heading_levels", sql(_BODY, """,
rk AS (SELECT doc_id, page, size, row_number() OVER (PARTITION BY doc_id, page ORDER BY size DESC) AS r FROM (
       SELECT DISTINCT doc_id, page, CASE WHEN trim(text) = '' THEN 10.0 ELSE size END AS size FROM span) JOIN b3 USING (doc_id, page) WHERE size >= body * 1.1)
SELECT s.doc_id, s.page, s.line AS block, CASE WHEN trim(text) = '' THEN 0 WHEN s.size >= body * 1.25 AND r <= 3 THEN r
       WHEN s.size >= body * 1.12 AND flags > 0 AND r <= 3 THEN r ELSE 0 END AS level
FROM span s JOIN b3 USING (doc_id, page) LEFT JOIN rk ON rk.doc_id = s.doc_id AND rk.page = s.page AND rk.size = s.size""").replace("\n,\nrk", ",\nrk"))
def heading_levels(spark, folder):
    spans = _line_blocks(spark, folder)
    return Y.heading_levels(Y.blocks_of(Y.lines_of(spans)), Y.body_size_by_page(spans)).select("doc_id", "page", "block", "level")


@query("page_titles", sql(_BODY, """
SELECT doc_id, page, arg_min(line, (-size, y0)) AS block, arg_min(trim(text), (-size, y0)) AS text FROM solid JOIN b3 USING (doc_id, page)
WHERE y0 <= 842 * 0.4 AND st <= 100 AND size >= body * 1.2 GROUP BY 1, 2"""))
def page_titles(spark, folder):
    spans = _line_blocks(spark, folder)
    return Y.pick_titles(Y.blocks_of(Y.lines_of(spans)), Y.body_size_by_page(spans), corpus.page_table(spark, folder))


_OUTLINE = _BODY + r""",
pgs AS (SELECT doc_id, count(DISTINCT n // 20) AS pages FROM wrapped GROUP BY 1),
ol AS (SELECT s.doc_id, page, line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, size, flags > 0 AS bold, y0, y1, body FROM solid s JOIN b2 USING (doc_id)),
pl AS (SELECT *, length(t) BETWEEN 2 AND 80 AND NOT regexp_matches(replace(t, ' ', ''), '^[0-9]+$') AND NOT regexp_matches(t, '[。、,;]$') AS ok FROM ol),
al AS (SELECT *, ok AND bold AND abs(size - body) <= body * 0.04 AND length(t) BETWEEN 2 AND 30 AND NOT regexp_matches(t, '^[A-Za-z]{0,2}[\s.:]*[0-9]{1,4}[\s.)]*$')
              AND NOT EXISTS (SELECT 1 FROM pl o WHERE o.doc_id = p.doc_id AND o.page = p.page AND o.line <> p.line AND abs(o.y0 - p.y0) < p.size * 0.5)
              AND y0 - coalesce((SELECT max(o.y1) FROM pl o WHERE o.doc_id = p.doc_id AND o.page = p.page AND o.y1 <= p.y0 + 1), 0) >= size * 0.9 AS alone FROM pl p),
hd AS (SELECT * FROM al WHERE ok AND (size >= body * 1.18 OR (bold AND size >= body * 1.04 AND length(t) <= 40) OR alone)),
oft AS (SELECT doc_id, t FROM hd JOIN pgs USING (doc_id) GROUP BY doc_id, t, pages HAVING count(DISTINCT page) > greatest(2, pages * 0.25)),
kp AS (SELECT hd.* FROM hd LEFT JOIN oft ON oft.doc_id = hd.doc_id AND oft.t = hd.t WHERE oft.t IS NULL),
few AS (SELECT doc_id FROM pgs LEFT JOIN (SELECT doc_id, count(*) AS n FROM kp GROUP BY 1) USING (doc_id) WHERE coalesce(n, 0) < greatest(3, pages * 0.15)),
fd AS (SELECT doc_id, page, line, t, size, y0 FROM kp WHERE doc_id NOT IN (SELECT doc_id FROM few)
       UNION ALL SELECT doc_id, page, line, t, body + 99, y0 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY size DESC, y0, line) AS rn FROM al
          WHERE ok AND doc_id IN (SELECT doc_id FROM few)) WHERE rn = 1),
lv AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS dr, lag(t) OVER (PARTITION BY doc_id, page ORDER BY y0, line) AS prv FROM fd)"""


def _outline(spark, folder):
    return Y.auto_outline(Y.lines_of(_spans(spark, folder)), corpus.page_table(spark, folder))


@query("auto_outline", sql(_OUTLINE, """
SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, line) AS INTEGER) AS seq, least(dr, 3) AS level, t AS title, page + 1 AS page FROM lv
WHERE prv IS NULL OR prv <> t)"""))
def auto_outline(spark, folder):
    return _outline(spark, folder)


_HTML = r"""
raw AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<h[1-6][^>]*>') AS m FROM pages),
toc AS (SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS seq, CAST(regexp_extract(unnest(m), 'h([1-6])', 1) AS INTEGER) AS lvl FROM raw),
toc2 AS (SELECT doc_id, seq, CASE WHEN (seq + doc_id) % 3 = 0 THEN lvl + 3 ELSE lvl END AS lvl, CAST(seq * 4 - 1 AS INTEGER) AS page FROM toc)"""


@query("outline_repair", "WITH RECURSIVE " + _HTML.strip() + """,
walk AS (SELECT doc_id, seq, least(lvl, 1) AS level, page FROM toc2 WHERE seq = 0
         UNION ALL SELECT t.doc_id, t.seq, least(t.lvl, w.level + 1), t.page FROM walk w JOIN toc2 t ON t.doc_id = w.doc_id AND t.seq = w.seq + 1)
SELECT doc_id, seq, level, greatest(1, least(6, page)) AS page FROM walk""")
def outline_repair(spark, folder):
    """Headings of the web pages as an outline with jumps in it."""
    found = corpus.load(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(
        F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), F.lit(1))).alias("seq", "h"))
    level = F.col("h").cast("int") + F.when((F.col("seq") + F.col("doc_id")) % 3 == 0, 3).otherwise(0)
    toc = found.select("doc_id", "seq", level.alias("level"), F.lit("").alias("title"), (F.col("seq") * 4 - 1).alias("page"))
    counts = found.select("doc_id").distinct().withColumn("pages", F.lit(6))
    return D.repair_outline(toc, counts).select("doc_id", "seq", "level", "page")


# ---------------------------------------------------------------- headers, boxes, margins, breaks

_REPEAT = corpus.SPANS + """,
cnt AS (SELECT doc_id, count(DISTINCT n // 20) AS pages FROM wrapped GROUP BY 1),
head AS (SELECT doc_id, page, line, y0, y1, 'Section ' || (doc_id % 7) || ' page ' || (page + 1) AS text FROM span WHERE line = 0 AND doc_id % 2 = 0
         UNION ALL SELECT doc_id, page, line, y0, y1, text FROM span WHERE NOT (line = 0 AND doc_id % 2 = 0)),
keyed AS MATERIALIZED (SELECT doc_id, page, line AS block, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS key,
                 CASE WHEN y1 < 842 * 0.09 THEN 'top' WHEN y0 > 842 * 0.91 THEN 'bottom' END AS band FROM head WHERE trim(text) <> '')"""


def _headed(spark, folder):
    """Visual lines as blocks; every other document gets a running header on its first line."""
    d = F.col("doc_id")
    head = F.concat(F.lit("Section "), (d % 7).cast("string"), F.lit(" page "), (F.col("page") + 1).cast("string"))
    return _line_blocks(spark, folder).withColumn("text", F.when((F.col("line") == 0) & (d % 2 == 0), head).otherwise(F.col("text")))


@query("repeating_headers", sql(_REPEAT, """
SELECT k.doc_id, k.page, k.block, k.band, k.key FROM keyed k JOIN (
 SELECT doc_id, band, key FROM keyed JOIN cnt USING (doc_id) WHERE band IS NOT NULL AND pages >= 3 GROUP BY doc_id, band, key, pages
 HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.5 + 0.5))) o ON o.doc_id = k.doc_id AND o.band = k.band AND o.key = k.key"""))
def repeating_headers(spark, folder):
    return Y.repeating_text(_headed(spark, folder), corpus.page_table(spark, folder)).select("doc_id", "page", "block", "band", "key")


_IMAGE = """
img AS (SELECT vec_id % 200 AS doc_id, CAST(vec_id % 4 AS INTEGER) AS page, vec_id AS xref, 20.0::DOUBLE AS x0, 30.0::DOUBLE AS y0, 20 + (label + 1) * 50.0::DOUBLE AS x1, 30 + (vec_id % 9) * 90.0::DOUBLE AS y1 FROM embeddings)"""


def images(spark, folder):
    """Pictures placed on pages, one from every embedding row."""
    v = F.col("vec_id")
    return corpus.load(spark, folder, "embeddings").select(
        (v % 200).alias("doc_id"), (v % 4).cast("int").alias("page"), v.alias("seq"), (v % 350).alias("xref"),
        F.lit(20.0).alias("x0"), F.lit(30.0).alias("y0"), (20 + (F.col("label") + 1) * 50.0).alias("x1"), (30 + (v % 9) * 90.0).alias("y1"),
        F.when(v % 3 == 0, F.lit("")).when(v % 3 == 1, F.concat(F.lit("picture "), v.cast("string"))).alias("alt"),
        (v % 40).cast("int").alias("w_px"), (v % 50).cast("int").alias("h_px"))


@query("content_boxes", sql(corpus.SPANS + "," + _IMAGE, """
SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (
 SELECT doc_id, page, x0, y0, x1, y1 FROM span WHERE trim(text) <> '' UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM img WHERE x1 > x0 AND y1 > y0) GROUP BY 1, 2"""))
def content_boxes(spark, folder):
    return Y.content_boxes(_spans(spark, folder), images(spark, folder))


_CROP = corpus.SPANS + """,
box AS (SELECT doc_id, page, greatest(0, min(x0) - 14) AS x0, greatest(0, min(y0) - 14) AS y0, max(x1) + 14 AS x1, max(y1) + 14 AS y1,
               CASE WHEN doc_id % 4 IN (1, 3) THEN 842.0::DOUBLE ELSE 595.0 END AS w, CASE WHEN doc_id % 4 IN (1, 3) THEN 595.0::DOUBLE ELSE 842.0 END AS h
        FROM span WHERE trim(text) <> '' GROUP BY 1, 2)"""


@query("auto_crop", sql(_CROP, """
SELECT doc_id, page, x0, y0, least(x1, w) AS x1, least(y1, h) AS y1 FROM box
WHERE least(x1, w) > x0 AND least(y1, h) > y0 AND NOT (least(x1, w) - x0 >= w - 1 AND least(y1, h) - y0 >= h - 1)"""))
def auto_crop(spark, folder):
    from folioframe.operators import pages as P

    return P.auto_crop(corpus.page_table(spark, folder), Y.content_boxes(_spans(spark, folder)))


_SCAN = corpus.SPANS + "," + _IMAGE + """,
pgs AS (SELECT DISTINCT doc_id, CAST(n // 20 AS INTEGER) AS page FROM wrapped),
txt AS (SELECT doc_id, page, sum(length(trim(text))) AS chars FROM span GROUP BY 1, 2),
scan AS (SELECT DISTINCT p.doc_id, p.page FROM pgs p JOIN img USING (doc_id, page) LEFT JOIN txt USING (doc_id, page) WHERE coalesce(chars, 0) < 5 OR (doc_id % 5 = 0 AND page % 2 = 1))"""


def page_chars(spark, folder):
    """Trimmed characters of each page; odd pages of every fifth document count as scans without text."""
    scan = (F.col("doc_id") % 5 == 0) & (F.col("page") % 2 == 1)
    return _spans(spark, folder).groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars")).withColumn(
        "chars", F.when(scan, 0).otherwise(F.col("chars")))


def _scanned(spark, folder):
    return Y.cheap_scanned(corpus.page_table(spark, folder), page_chars(spark, folder), images(spark, folder))


@query("scanned_pages", sql(_SCAN, "SELECT doc_id, page FROM scan"))
def scanned_pages(spark, folder):
    return _scanned(spark, folder)


@query("document_margins", sql(_SCAN, """,
pb AS (SELECT s.doc_id, s.page, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM span s LEFT JOIN scan c ON c.doc_id = s.doc_id AND c.page = s.page
       WHERE c.doc_id IS NULL AND trim(text) <> '' AND y1 > 842 * 0.09 AND y0 < 842 * 0.91 GROUP BY 1, 2)
SELECT doc_id, round("left", 4) AS "left", round(top, 4) AS top, round("right", 4) AS "right", round(least(bottom, greatest(top, 72)), 4) AS bottom FROM (
 SELECT doc_id, min(greatest(18, least(x0, 595 * 0.4))) AS "left", min(greatest(18, least(y0, 842 * 0.4))) AS top,
        min(greatest(18, least(595 - x1, 595 * 0.4))) AS "right", min(greatest(18, least(842 - y1, 842 * 0.4))) AS bottom FROM pb GROUP BY 1)""").replace("\n,\npb", ",\npb"))
def document_margins(spark, folder):
    found = Y.document_margins(_line_blocks(spark, folder), corpus.page_table(spark, folder), _scanned(spark, folder))
    return found.select("doc_id", *[F.round(c, 4).alias(c) for c in ("left", "top", "right", "bottom")])


@query("section_breaks", sql(_SCAN, """,
low AS (SELECT doc_id, page, max(y1) AS low FROM span WHERE trim(text) <> '' AND y1 < 842 * 0.91 GROUP BY 1, 2)
SELECT p.doc_id, p.page, CASE WHEN q.page IS NULL THEN false ELSE c.doc_id IS NOT NULL OR d.doc_id IS NOT NULL OR coalesce(low < 842 * 0.8, true) END AS breaks
FROM pgs p LEFT JOIN pgs q ON q.doc_id = p.doc_id AND q.page = p.page + 1 LEFT JOIN scan c ON c.doc_id = p.doc_id AND c.page = p.page
LEFT JOIN scan d ON d.doc_id = p.doc_id AND d.page = p.page + 1 LEFT JOIN low l ON l.doc_id = p.doc_id AND l.page = p.page""").replace("\n,\nlow", ",\nlow"))
def section_breaks(spark, folder):
    return Y.section_breaks(_line_blocks(spark, folder), corpus.page_table(spark, folder), _scanned(spark, folder))

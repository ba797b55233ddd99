"""Registered queries of the page algebra."""

from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.operators import pages as P
from folioframe.plans import corpus
from folioframe.plans.registry import ORACLES, query, sql
from folioframe.session import cut_lineage

_COUNTS = corpus.PAGE + ",\npc AS (SELECT doc_id, count(*) AS pages FROM page GROUP BY 1)"
# Which pages a query picks, the same rule on both sides.
_PICK = "(page * 7 + doc_id) % 5 = 2"


def _pages(spark, folder):
    return corpus.page_table(spark, folder)


def _held(spark, folder):
    """Pages that are used several times: worked out from the texts once, kept in the checkpoint folder."""
    return cut_lineage(_pages(spark, folder))


def _picked(pages):
    return pages.where((F.col("page") * 7 + F.col("doc_id")) % 5 == 2).select("doc_id", "page")


def _specs(pages):
    d = F.col("doc_id") % 8
    spec = (F.when(d == 0, "1-3, 2").when(d == 1, "１〜２、1").when(d == 2, "2-").when(d == 3, "-2, 1").when(d == 4, "99999")
            .when(d == 5, "x").when(d == 6, " , ").otherwise("1"))
    return P.page_counts(pages).select("doc_id", "pages", spec.alias("spec"))


@query("page_ranges", sql(_COUNTS, """
SELECT doc_id, pos, grp, page, error FROM (
 SELECT doc_id, unnest([0,1,2,3]) AS pos, unnest([0,0,0,1]) AS grp, unnest([0,1,2,1]) AS page, NULL AS error FROM pc WHERE doc_id % 8 = 0 AND pages >= 3
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'out of range: 1-3' FROM pc WHERE doc_id % 8 = 0 AND pages < 3
 UNION ALL SELECT doc_id, unnest([0,1,2]), unnest([0,0,1]), unnest([0,1,0]), NULL FROM pc WHERE doc_id % 8 = 1 AND pages >= 2
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'out of range: 1-2' FROM pc WHERE doc_id % 8 = 1 AND pages < 2
 UNION ALL SELECT doc_id, i - 1, 0, i, NULL FROM (SELECT doc_id, unnest(generate_series(1, pages - 1)) AS i FROM pc WHERE doc_id % 8 = 2 AND pages >= 2)
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'out of range: 2-' FROM pc WHERE doc_id % 8 = 2 AND pages < 2
 UNION ALL SELECT doc_id, unnest([0,1,2]), unnest([0,0,1]), unnest([0,1,0]), NULL FROM pc WHERE doc_id % 8 = 3 AND pages >= 2
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'out of range: -2' FROM pc WHERE doc_id % 8 = 3 AND pages < 2
 UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE doc_id % 8 WHEN 4 THEN 'out of range: 99999' WHEN 5 THEN 'unreadable: x' ELSE 'empty' END FROM pc WHERE doc_id % 8 IN (4, 5, 6)
 UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM pc WHERE doc_id % 8 = 7)"""))
def page_ranges(spark, folder):
    return P.parse_ranges(_specs(_pages(spark, folder)))


@query("page_ranges_set", sql(_COUNTS, """
SELECT doc_id, page, error FROM (
 SELECT doc_id, unnest([0,1,2]) AS page, NULL AS error FROM pc WHERE doc_id % 8 = 0 AND pages >= 3
 UNION ALL SELECT doc_id, NULL, 'out of range: 1-3' FROM pc WHERE doc_id % 8 = 0 AND pages < 3
 UNION ALL SELECT doc_id, NULL, 'unreadable: １〜２' FROM pc WHERE doc_id % 8 = 1
 UNION ALL SELECT doc_id, unnest(generate_series(1, pages - 1)), NULL FROM pc WHERE doc_id % 8 = 2 AND pages >= 2
 UNION ALL SELECT doc_id, NULL, 'out of range: 2-' FROM pc WHERE doc_id % 8 = 2 AND pages < 2
 UNION ALL SELECT doc_id, unnest([0,1]), NULL FROM pc WHERE doc_id % 8 = 3 AND pages >= 2
 UNION ALL SELECT doc_id, NULL, 'out of range: -2' FROM pc WHERE doc_id % 8 = 3 AND pages < 2
 UNION ALL SELECT doc_id, NULL, CASE doc_id % 8 WHEN 4 THEN 'out of range: 99999' ELSE 'unreadable: x' END FROM pc WHERE doc_id % 8 IN (4, 5)
 UNION ALL SELECT doc_id, unnest(generate_series(0, pages - 1)), NULL FROM pc WHERE doc_id % 8 = 6
 UNION ALL SELECT doc_id, 0, NULL FROM pc WHERE doc_id % 8 = 7)"""))
def page_ranges_set(spark, folder):
    specs = _specs(_pages(spark, folder))
    return P.parse_ranges_set(specs.withColumn("spec", F.when(F.col("spec") == " , ", "").otherwise(F.col("spec"))))


@query("target_pages", sql(corpus.PAGE, f"SELECT doc_id, page FROM page WHERE {_PICK}"))
def target_pages(spark, folder):
    pages = _held(spark, folder)
    return P.target_pages(pages, _picked(pages)).select("doc_id", "page")


@query("range_texts", sql(corpus.PAGE, """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS run, CASE WHEN a = b THEN '' || a ELSE a || '-' || b END AS text
FROM (SELECT doc_id, g, min(page) + 1 AS a, max(page) + 1 AS b FROM (
  SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM page WHERE (page * 7 + doc_id) % 5 < 3) GROUP BY 1, 2)"""))
def range_texts(spark, folder):
    return P.range_texts(_pages(spark, folder).where((F.col("page") * 7 + F.col("doc_id")) % 5 < 3))


@query("extract_pages", sql(corpus.PAGE, f"""
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS new_page FROM page WHERE {_PICK}"""))
def extract_pages(spark, folder):
    pages = _held(spark, folder)
    return P.extract(pages, _picked(pages)).select("doc_id", "page", "new_page")


@query("extract_ranges", sql(_COUNTS, """
SELECT doc_id, new_page, page, bytes FROM (
 SELECT doc_id, unnest([0,1,2,3]) AS new_page, unnest([0,1,2,1]) AS page FROM pc WHERE doc_id % 8 = 0 AND pages >= 3
 UNION ALL SELECT doc_id, unnest([0,1,2]), unnest([0,1,0]) FROM pc WHERE doc_id % 8 IN (1, 3) AND pages >= 2
 UNION ALL SELECT doc_id, i - 1, i FROM (SELECT doc_id, unnest(generate_series(1, pages - 1)) AS i FROM pc WHERE doc_id % 8 = 2 AND pages >= 2)
 UNION ALL SELECT doc_id, 0, 0 FROM pc WHERE doc_id % 8 = 7) JOIN page USING (doc_id, page)"""))
def extract_ranges(spark, folder):
    pages = _held(spark, folder)
    return P.extract_ranges(pages, P.parse_ranges(_specs(pages))).select("doc_id", "new_page", "page", "bytes")


@query("delete_pages", sql(corpus.PAGE, """
SELECT doc_id, page, refused, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS new_page FROM (
  SELECT *, bool_and(doc_id % 10 = 0 OR (page * 7 + doc_id) % 5 = 2) OVER (PARTITION BY doc_id) AS refused FROM page)
WHERE refused OR NOT (doc_id % 10 = 0 OR (page * 7 + doc_id) % 5 = 2)"""))
def delete_pages(spark, folder):
    """Delete the picked pages; of every tenth document all pages, which is refused."""
    pages = _held(spark, folder)
    doomed = pages.where((F.col("doc_id") % 10 == 0) | ((F.col("page") * 7 + F.col("doc_id")) % 5 == 2))
    return P.delete(pages, doomed).select("doc_id", "page", "refused", "new_page")


@query("duplicate_pages", sql(corpus.PAGE, f"""
SELECT doc_id, page, copy, row_number() OVER (PARTITION BY doc_id ORDER BY page, copy) - 1 AS new_page FROM (
  SELECT doc_id, page, unnest(CASE WHEN {_PICK} THEN [0, 1] ELSE [0] END) AS copy FROM page)"""))
def duplicate_pages(spark, folder):
    pages = _held(spark, folder)
    return P.duplicate(pages, _picked(pages)).select("doc_id", "page", "copy", "new_page")


@query("insert_page", sql(_COUNTS, """
SELECT doc_id, CAST(page + CASE WHEN page >= least(doc_id % 6, pages) THEN 1 ELSE 0 END AS BIGINT) AS new_page, width, height, false AS inserted FROM page JOIN pc USING (doc_id)
UNION ALL SELECT doc_id, least(doc_id % 6, pages), 420.0::DOUBLE, 595.0::DOUBLE, true FROM pc"""))
def insert_page(spark, folder):
    pages = _held(spark, folder)
    fresh = pages.where(F.col("page") == 0).select("doc_id", (F.col("doc_id") % 6).alias("at"), F.lit(420.0).alias("width"), F.lit(595.0).alias("height"))
    return P.insert_pages(pages, fresh)


@query("reorder_pages", sql(_COUNTS, """
SELECT doc_id, page, doc_id % 9 <> 4 OR pages = 1 AS ok, CASE WHEN doc_id % 9 = 4 THEN page ELSE pages - 1 - page END AS new_page FROM page JOIN pc USING (doc_id)"""))
def reorder_pages(spark, folder):
    """Reverse every document; every ninth order repeats a slot and is no permutation."""
    pages = _held(spark, folder)
    order = pages.join(P.page_counts(pages), "doc_id").select(
        "doc_id", "page", F.when(F.col("doc_id") % 9 == 4, 0).otherwise(F.col("pages") - 1 - F.col("page")).alias("new_page"))
    return P.reorder(pages, order).select("doc_id", "page", "ok", "new_page")


@query("move_pages", sql(_COUNTS, f"""
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {_PICK} THEN 1 WHEN page < least(3, pages) THEN 0 ELSE 2 END, page) - 1 AS new_page
FROM page JOIN pc USING (doc_id)"""))
def move_pages(spark, folder):
    pages = _held(spark, folder)
    at = P.page_counts(pages).select("doc_id", F.least(F.lit(3), "pages").alias("at"))
    return P.move_before(pages, _picked(pages), at).select("doc_id", "page", "new_page")


@query("rotate_pages", sql(corpus.PAGE, f"""
SELECT doc_id, page, (rotation + CASE WHEN {_PICK} THEN 270 ELSE 0 END) % 360 AS rotation FROM page"""))
def rotate_pages(spark, folder):
    pages = _held(spark, folder)
    return P.rotate(pages, _picked(pages), -90).select("doc_id", "page", "rotation")


def _sources(pages):
    d = F.col("doc_id")
    return pages.select("doc_id").distinct().select((d % 10).alias("target"), d.alias("ord"), "doc_id", F.concat(
        F.lit("part"), d.cast("string"), F.lit(".PDF")).alias("name"))


@query("merge_documents", sql(corpus.PAGE, """
SELECT doc_id % 10 AS target, doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id, page) - 1 AS BIGINT) AS new_page FROM page"""))
def merge_documents(spark, folder):
    pages = _held(spark, folder)
    return P.merge(_sources(pages), pages).select("target", "doc_id", "page", "new_page")


@query("merge_bookmarks", sql(_COUNTS, """
SELECT doc_id % 10 AS target, 1 AS level, 'part' || doc_id AS title,
       CAST(sum(pages) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) - pages + 1 AS BIGINT) AS page FROM pc"""))
def merge_bookmarks(spark, folder):
    pages = _held(spark, folder)
    return P.merge_bookmarks(_sources(pages), pages)


@query("insert_document", sql(_COUNTS + """,
a AS (SELECT doc_id, least(pages, 2) AS n, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE pages END AS spot FROM pc)""", """
SELECT doc_id, page, 'base' AS origin, page + CASE WHEN page >= spot THEN n ELSE 0 END AS new_page FROM page JOIN a USING (doc_id)
UNION ALL SELECT doc_id, page, 'incoming', spot + page FROM page JOIN a USING (doc_id) WHERE page < 2"""))
def insert_document(spark, folder):
    """The first two pages of each document once more: after page one, or at the end of odd documents."""
    pages = _held(spark, folder)
    at = pages.where((F.col("doc_id") % 2 == 0) & (F.col("page") == 0)).select("doc_id", F.lit(1).alias("at"))
    return P.insert_document(pages, pages.where(F.col("page") < 2), at)


@query("replace_pages", sql(_COUNTS + f""",
t AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k, count(*) OVER (PARTITION BY doc_id) AS need FROM page WHERE {_PICK})""", """
SELECT p.doc_id, p.page, CASE WHEN m.need IS NULL THEN 'no pages to replace' WHEN pages < m.need + 1 THEN 'source too short' END AS error,
       CASE WHEN pages >= t.need + 1 THEN k END AS source_page
FROM page p JOIN pc USING (doc_id) LEFT JOIN t ON t.doc_id = p.doc_id AND t.page = p.page
LEFT JOIN (SELECT DISTINCT doc_id, need FROM t) m ON m.doc_id = p.doc_id"""))
def replace_pages(spark, folder):
    pages = _held(spark, folder)
    return P.replace_pages(pages, _picked(pages), pages, first=1).select("doc_id", "page", "error", "source_page")


@query("organize_pages", sql(_COUNTS, """
SELECT doc_id AS out_id, page * 2 AS new_page, (page + 1) % pages AS page, false AS blank, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height,
       (rotation + page * 90) % 360 AS rotation FROM page JOIN pc USING (doc_id)
UNION ALL SELECT doc_id, page * 2 + 1, NULL, true, 300.0, 842.0, 90 FROM page"""))
def organize_pages(spark, folder):
    """Each document turned round by one page, with a blank sheet after every page."""
    pages = _held(spark, folder)
    base = pages.select("doc_id", "page").join(P.page_counts(pages), "doc_id")
    null = F.lit(None)
    kept = base.select(F.col("doc_id").alias("out_id"), (F.col("page") * 2).alias("pos"), "doc_id", ((F.col("page") + 1) % F.col("pages")).alias("page"),
                       (F.col("page") * 90).alias("rotate"), F.lit(False).alias("blank"), null.cast("double").alias("w"), null.cast("double").alias("h"))
    blanks = base.select(F.col("doc_id").alias("out_id"), (F.col("page") * 2 + 1).alias("pos"), "doc_id", null.cast("bigint").alias("page"),
                         F.lit(90).alias("rotate"), F.lit(True).alias("blank"), F.lit(300.0).alias("w"), null.cast("double").alias("h"))
    return P.organize(kept.unionByName(blanks), pages).select("out_id", "new_page", "page", "blank", "width", "height", "rotation")


@query("bates_numbers", sql(corpus.PAGE, """
SELECT doc_id, page, 'A-' || CASE WHEN length('' || n) >= 4 THEN '' || n ELSE lpad('' || n, 4, '0') END || '-x' AS label,
       'P' || lpad('' || (page + 9), 3, '0') AS own_label
FROM (SELECT doc_id, page, row_number() OVER (ORDER BY doc_id, page) + 99 AS n FROM page)"""))
def bates_numbers(spark, folder):
    pages = _held(spark, folder)
    through = P.bates(pages, "A-", 100, 4, "-x", production=True)
    own = P.bates(pages, "P", 9, 3).select("doc_id", "page", F.col("label").alias("own_label"))
    return through.join(own, ["doc_id", "page"]).select("doc_id", "page", "label", "own_label")


@query("page_labels", sql(_COUNTS, """
SELECT doc_id, page, '- ' || (page + 4) || ' of ' || (pages + 3) || ' -' AS label, CASE WHEN page % 2 = 1 THEN 'right' ELSE 'left' END AS side
FROM page JOIN pc USING (doc_id) WHERE page >= 1"""))
def page_labels(spark, folder):
    return P.page_labels(_pages(spark, folder), "- {page} of {pages} -", start=5, skip=1, align="outside")


@query("booklet_order", sql(_COUNTS, """
SELECT doc_id, s.side, s.slot, CASE WHEN p < pages THEN p ELSE -1 END AS page FROM (
 SELECT doc_id, pages, t, unnest(generate_series(0, t // 4 - 1)) AS k FROM (SELECT *, CAST((pages + 3) // 4 * 4 AS BIGINT) AS t FROM pc)) x,
 LATERAL (VALUES (2 * k, 0, t - 1 - 2 * k), (2 * k, 1, 2 * k), (2 * k + 1, 0, 2 * k + 1), (2 * k + 1, 1, t - 2 - 2 * k)) s(side, slot, p)"""))
def booklet_order(spark, folder):
    return P.booklet(_pages(spark, folder))


@query("duplex_order", sql(_COUNTS, """
SELECT doc_id, page, CASE WHEN page < (pages + 1) // 2 THEN page * 2 ELSE (pages - 1 - page) * 2 + 1 END AS reversed_backs,
       CASE WHEN page < (pages + 1) // 2 THEN page * 2 ELSE (page - (pages + 1) // 2) * 2 + 1 END AS plain_backs FROM page JOIN pc USING (doc_id)"""))
def duplex_order(spark, folder):
    pages = _held(spark, folder)
    a = P.duplex_order(pages, True).select("doc_id", "page", F.col("new_page").alias("reversed_backs"))
    return a.join(P.duplex_order(pages, False).select("doc_id", "page", F.col("new_page").alias("plain_backs")), ["doc_id", "page"])


_VIEW = corpus.MIXED + """,
v AS (SELECT *, CASE WHEN rotation % 180 = 90 THEN height ELSE width END AS vw, CASE WHEN rotation % 180 = 90 THEN width ELSE height END AS vh FROM mixed)"""
_NUP = _VIEW + """,
asp AS (SELECT doc_id, (list_sort(list(vw / vh)))[count(*) // 2 + 1] AS aspect FROM v GROUP BY 1),
o AS (SELECT doc_id, least((595 - 48 - 10) / 2.0 / aspect, 842 - 48.0) AS s1, least((842 - 48 - 10) / 2.0 / aspect, 595 - 48.0) AS s2,
             least((595 - 48.0) / aspect, (842 - 48 - 10) / 2.0) AS s3, least((842 - 48.0) / aspect, (595 - 48 - 10) / 2.0) AS s4 FROM asp),
b2 AS (SELECT *, CASE WHEN s2 > s1 + 0.5 THEN 2 ELSE 1 END AS k2, CASE WHEN s2 > s1 + 0.5 THEN s2 ELSE s1 END AS m2 FROM o),
b3 AS (SELECT *, CASE WHEN s3 > m2 + 0.5 THEN 3 ELSE k2 END AS k3, CASE WHEN s3 > m2 + 0.5 THEN s3 ELSE m2 END AS m3 FROM b2),
b4 AS (SELECT doc_id, CASE WHEN s4 > m3 + 0.5 THEN 4 ELSE k3 END AS k FROM b3),
sh AS (SELECT doc_id, CASE WHEN k IN (1, 3) THEN 595.0 ELSE 842.0 END AS w, CASE WHEN k IN (1, 3) THEN 842.0 ELSE 595.0 END AS h,
              CASE WHEN k <= 2 THEN 2 ELSE 1 END AS cols, CASE WHEN k <= 2 THEN 1 ELSE 2 END AS rows FROM b4),
c AS (SELECT v.doc_id, page, n, vw, vh, w, h, cols, (w - 48 - (cols - 1) * 10) / cols AS cw, (h - 48 - 14 - (rows - 1) * 10) / rows AS ch FROM v JOIN sh USING (doc_id)),
d AS (SELECT *, 24 + (page % 2 % cols) * (cw + 10) AS x, 24 + (page % 2 // cols) * (ch + 10) AS y, least(cw / vw, ch / vh) AS s FROM c)"""


@query("nup_plan", sql(_NUP, """
SELECT doc_id, page, page // 2 AS sheet, page % 2 AS slot, CAST(w AS DOUBLE) AS sheet_w, round(CAST(x + (cw - vw * s) / 2 AS DOUBLE), 4) AS x0,
       round(CAST(y + (ch - vh * s) / 2 AS DOUBLE), 4) AS y0, round(CAST(x + (cw + vw * s) / 2 AS DOUBLE), 4) AS x1,
       (page // 2 + 1) || ' / ' || ((n + 1) // 2) AS label FROM d"""))
def nup_plan(spark, folder):
    plan = P.nup_plan(corpus.mixed_pages(spark, folder), 2, numbers=True)
    return plan.select("doc_id", "page", "sheet", "slot", "sheet_w", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1")], "label")


@query("nup_notes", sql(_VIEW, """
SELECT doc_id, page, page // 3 AS sheet, page % 3 AS slot, round(32 + vw * s, 4) AS x1, round(32 + (page % 3) * (ch + 18) + (ch - vh * s) / 2, 4) AS y0
FROM (SELECT *, least((595.0::DOUBLE - 64) * 0.54 / vw, (842.0::DOUBLE - 64 - 36) / 3 / vh) AS s, (842.0::DOUBLE - 64 - 36) / 3 AS ch FROM v)"""))
def nup_notes(spark, folder):
    plan = P.nup_plan(corpus.mixed_pages(spark, folder), "notes3")
    return plan.select("doc_id", "page", "sheet", "slot", F.round("x1", 4).alias("x1"), F.round("y0", 4).alias("y0"))


@query("page_geometry", sql(_VIEW, """
SELECT doc_id, vw AS width, vh AS height, count(*) AS pages, any_value(aspect) AS aspect
FROM v JOIN (SELECT doc_id, round((list_sort(list(vw / vh)))[count(*) // 2 + 1], 6) AS aspect FROM v GROUP BY 1) USING (doc_id) GROUP BY 1, 2, 3"""))
def page_geometry(spark, folder):
    pages = corpus.mixed_pages(spark, folder)
    return P.size_census(pages).join(P.median_aspect(pages).withColumn("aspect", F.round("aspect", 6)), "doc_id")


@query("split_every", sql(corpus.PAGE, """
SELECT doc_id, part, a, b, '_p' || CASE WHEN a = b THEN '' || (a + 1) ELSE (a + 1) || '-' || (b + 1) END AS suffix
FROM (SELECT doc_id, page // 3 AS part, min(page) AS a, max(page) AS b FROM page GROUP BY 1, 2)"""))
def split_every(spark, folder):
    return P.split_every(_pages(spark, folder), 3)


_SPLIT = """
SELECT doc_id, grp AS part, min(page) AS a, max(page) AS b, '_p' || CASE WHEN min(page) = max(page) THEN '' || (min(page) + 1) ELSE (min(page) + 1) || '-' || (max(page) + 1) END AS suffix
FROM ({ranges}) WHERE error IS NULL GROUP BY 1, 2"""


@query("split_ranges", ORACLES["page_ranges"].replace("\nSELECT doc_id, pos, grp, page, error FROM", _SPLIT.split("({ranges})")[0] + "(SELECT doc_id, pos, grp, page, error FROM", 1)
       + ")" + _SPLIT.split("({ranges})")[1])
def split_ranges(spark, folder):
    """Each range of a document as a part of its own."""
    return P.split_ranges(page_ranges(spark, folder))


@query("picture_placement", """
WITH v AS (SELECT vec_id, CAST(vec_id % 40 * 25 + 10 AS DOUBLE) AS w, CAST(vec_id % 50 * 20 + 10 AS DOUBLE) AS h FROM embeddings),
p AS (SELECT *, CASE WHEN w > h THEN 842.0 ELSE 595.0 END::DOUBLE AS pw, CASE WHEN w > h THEN 595.0 ELSE 842.0 END::DOUBLE AS ph FROM v)
SELECT vec_id, pw AS page_w, round((pw - w * least((pw - 36) / w, (ph - 36) / h)) / 2, 4) AS x0, round((ph - h * least((pw - 36) / w, (ph - 36) / h)) / 2, 4) AS y0 FROM p""")
def picture_placement(spark, folder):
    """Pictures of many shapes, each on a page of its own."""
    v = F.col("vec_id")
    placed = P.image_page((v % 40 * 25 + 10).cast("double"), (v % 50 * 20 + 10).cast("double"))
    return corpus.load(spark, folder, "embeddings").select("vec_id", placed.alias("p")).select(
        "vec_id", "p.page_w", F.round("p.x0", 4).alias("x0"), F.round("p.y0", 4).alias("y0"))


@query("turned_shapes", sql(corpus.ANNOT, """,
r AS (SELECT doc_id, id, CAST(90 * (doc_id % 4) AS INTEGER) AS r, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, x0 + 40.0 AS x1, y0 + 12.0 AS y1 FROM annot)
SELECT doc_id, id, CASE r WHEN 90 THEN 842 - y0 WHEN 180 THEN 595 - x1 WHEN 270 THEN y0 ELSE x1 END AS qx, CASE r WHEN 90 THEN x1 WHEN 180 THEN 842 - y0 WHEN 270 THEN 595 - x1 ELSE y0 END AS qy,
       CASE r WHEN 90 THEN 842 - y1 WHEN 180 THEN 595 - x1 WHEN 270 THEN y1 ELSE x1 END + 5 AS px, least(x0, 100.0) AS ux0, greatest(y1, 220.0) AS uy1 FROM r""").replace("\n,\nr AS", ",\nr AS"))
def turned_shapes(spark, folder):
    """Quads and points in the frame of the reader, points moved by five, and the box round a mark and a fixed one."""
    r, w, h = (F.col("doc_id") % 4 * 90).cast("int"), F.lit(595.0), F.lit(842.0)
    x0, y0, x1, y1 = (F.col("rect")[i] for i in range(4))
    quad = G.quad_to_view(F.array(x0, y0, x1, y0, x0, y1, x1, y1), r, w, h)
    points = G.translated_points(G.points_to_view(F.array(F.array(x0, y0), F.array(x1, y1)), r, w, h), F.lit(5.0), F.lit(0.0))
    both = G.union(F.col("rect"), F.array(F.lit(100.0), F.lit(200.0), F.lit(140.0), F.lit(220.0)))
    return corpus.annots(spark, folder).select("doc_id", "id", quad[2].alias("qx"), quad[3].alias("qy"), points[1][0].alias("px"),
                                               both[0].alias("ux0"), both[3].alias("uy1"))


@query("split_by_size", "WITH RECURSIVE " + corpus.PAGE.strip() + """,
ran AS (SELECT doc_id, page, sum(bytes) OVER w AS e, sum(bytes) OVER w - bytes AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM page WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
nx AS (SELECT r.doc_id, r.page, n, s, greatest(r.page, coalesce((SELECT max(q.page) FROM ran q WHERE q.doc_id = r.doc_id AND q.e <= r.s + 4000), r.page)) AS last FROM ran r),
walk AS (SELECT doc_id, page, last, s, n, 0 AS part FROM nx WHERE page = 0
         UNION ALL SELECT x.doc_id, x.page, x.last, x.s, x.n, w.part + 1 FROM walk w JOIN nx x ON x.doc_id = w.doc_id AND x.page = w.last + 1)
SELECT w.doc_id, part, w.page AS a, w.last AS b, CAST(r.e - w.s AS BIGINT) AS bytes FROM walk w JOIN ran r ON r.doc_id = w.doc_id AND r.page = w.last""")
def split_by_size(spark, folder):
    return P.split_by_size(_pages(spark, folder), 4000)


@query("split_spreads", sql(_VIEW, """
SELECT doc_id, page, half, row_number() OVER (PARTITION BY doc_id ORDER BY page, half) - 1 AS new_page, x0, x1 FROM (
 SELECT doc_id, page, vw, unnest(CASE WHEN vw > vh * 1.05 THEN [0, 1] ELSE [0] END) AS half,
        unnest(CASE WHEN vw > vh * 1.05 THEN [vw / 2, 0.0] ELSE [0.0] END) AS x0, unnest(CASE WHEN vw > vh * 1.05 THEN [vw, vw / 2] ELSE [vw] END) AS x1 FROM v)"""))
def split_spreads(spark, folder):
    return P.split_spreads(corpus.mixed_pages(spark, folder), right_to_left=True).select(
        "doc_id", "page", "half", "new_page", F.col("box")[0].alias("x0"), F.col("box")[2].alias("x1"))


@query("compress_choice", sql(_COUNTS + """,
st AS (SELECT doc_id, step, ([200, 150, 120, 100, 85, 72])[step + 1] AS dpi, CAST(sum(bytes) AS BIGINT) * 10 // (step + 2 + CASE WHEN step = 4 THEN 3 ELSE 0 END) AS size
       FROM page, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS step) GROUP BY 1, 2)""", """
SELECT doc_id, coalesce(min_by(dpi, step) FILTER (WHERE size <= 3000), arg_min(dpi, (size, step))) AS dpi,
       coalesce(min_by(size, step) FILTER (WHERE size <= 3000), min(size)) AS size, bool_or(size <= 3000) AS fits FROM st GROUP BY 1"""))
def compress_choice(spark, folder):
    total = _pages(spark, folder).groupBy("doc_id").agg(F.sum("bytes").alias("b"))
    ladder = F.array(*[F.lit(d) for d in (200, 150, 120, 100, 85, 72)])
    steps = total.select("doc_id", "b", F.posexplode(ladder).alias("step", "dpi"))
    divisor = F.col("step") + 2 + F.when(F.col("step") == 4, 3).otherwise(0)
    sized = steps.select("doc_id", "step", "dpi", F.floor(F.col("b") * 10 / divisor).alias("size"))
    return P.choose_setting(sized, F.lit(3000))


@query("page_boxes", sql(_VIEW, """
SELECT doc_id, page, rotation, -m0 AS x0, -m3 AS y0, width + m2 AS x1, height + m1 AS y1, round((pw - vw * s) / 2, 3) AS fit_x0, round((ph + vh * s) / 2, 3) AS fit_y1
FROM (SELECT *, ([10.0, 20.0, 30.0, 40.0]::DOUBLE[])[rotation // 90 % 4 + 1] AS m0, ([20.0, 30.0, 40.0, 10.0]::DOUBLE[])[rotation // 90 % 4 + 1] AS m1,
             ([30.0, 40.0, 10.0, 20.0]::DOUBLE[])[rotation // 90 % 4 + 1] AS m2, ([40.0, 10.0, 20.0, 30.0]::DOUBLE[])[rotation // 90 % 4 + 1] AS m3,
             CASE WHEN vw > vh THEN 841.89::DOUBLE ELSE 595.28 END AS pw, CASE WHEN vw > vh THEN 595.28::DOUBLE ELSE 841.89 END AS ph,
             least(CASE WHEN vw > vh THEN 841.89::DOUBLE ELSE 595.28 END / vw, CASE WHEN vw > vh THEN 595.28::DOUBLE ELSE 841.89 END / vh) AS s FROM v)"""))
def page_boxes(spark, folder):
    """New media boxes after adding margins, and where the page sits when fitted to A4."""
    pages = corpus.mixed_pages(spark, folder)
    grown = P.add_margins(pages, 10, 20, 30, 40)
    fitted = P.fit_paper(pages).select("doc_id", "page", F.round("x0", 3).alias("fit_x0"), F.round("y1", 3).alias("fit_y1"))
    return pages.select("doc_id", "page", "rotation").join(grown, ["doc_id", "page"]).join(fitted, ["doc_id", "page"])


@query("crop_pages", sql(_VIEW, """
SELECT doc_id, page, CASE WHEN x0 < x1 AND y0 < y1 THEN x0 END AS x0, CASE WHEN x0 < x1 AND y0 < y1 THEN y0 END AS y0,
       CASE WHEN x0 < x1 AND y0 < y1 THEN x1 END AS x1, CASE WHEN x0 < x1 AND y0 < y1 THEN y1 END AS y1, CASE WHEN x0 < x1 AND y0 < y1 THEN NULL ELSE 'outside the page' END AS error
FROM (SELECT doc_id, page, greatest(0, CASE rotation WHEN 90 THEN 20.0 WHEN 180 THEN width - 700 WHEN 270 THEN width - 500 ELSE 350 END) AS x0,
  greatest(0, CASE rotation WHEN 90 THEN height - 700 WHEN 180 THEN height - 500 WHEN 270 THEN 350.0 ELSE 20 END) AS y0,
  least(width, CASE rotation WHEN 90 THEN 500.0 WHEN 180 THEN width - 350 WHEN 270 THEN width - 20 ELSE 700 END) AS x1,
  least(height, CASE rotation WHEN 90 THEN height - 350 WHEN 180 THEN height - 20 WHEN 270 THEN 700.0 ELSE 500 END) AS y1 FROM v)"""))
def crop_pages(spark, folder):
    boxed = P.crop(corpus.mixed_pages(spark, folder), [350, 20, 700, 500])
    return boxed.select("doc_id", "page", *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "error")


@query("marks_on_rotated_pages", sql(corpus.ANNOT, """
SELECT doc_id, id, r AS rotation, CASE r WHEN 90 THEN 842 - y0 - 12 WHEN 180 THEN 595 - x0 - 40 WHEN 270 THEN y0 ELSE x0 END AS vx0,
       CASE r WHEN 90 THEN x0 WHEN 180 THEN 842 - y0 - 12 WHEN 270 THEN 595 - x0 - 40 ELSE y0 END AS vy0, 842 - y0 - 12 AS flipped_y0, true AS round_trip
FROM (SELECT doc_id, id, CAST(90 * (doc_id % 4) AS INTEGER) AS r, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0 FROM annot)"""))
def marks_on_rotated_pages(spark, folder):
    """Marks in the frame the reader sees, with the bottom-left flip; the way back has to give the start."""
    r, w, h = (F.col("doc_id") % 4 * 90).cast("int"), F.lit(595.0), F.lit(842.0)
    view = G.rect_to_view(F.col("rect"), r, w, h)
    return corpus.annots(spark, folder).select(
        "doc_id", "id", r.alias("rotation"), view[0].alias("vx0"), view[1].alias("vy0"),
        G.flip_rect(F.col("rect"), h)[1].alias("flipped_y0"), (G.rect_to_page(view, r, w, h) == F.col("rect")).alias("round_trip"))

"""Registered queries of comparison, history, documents and small column functions."""

from pyspark.sql import functions as F

from folioframe.functions import marks as K
from folioframe.functions import measure as M
from folioframe.functions import text as T
from folioframe.operators import compare as C
from folioframe.operators import documents as D
from folioframe.operators import history as H
from folioframe.plans import corpus
from folioframe.plans.layout import images, page_chars
from folioframe.plans.registry import query, sql

# ---------------------------------------------------------------- versions

_VERSIONS = corpus.WRAPPED + """,
bp AS (SELECT DISTINCT doc_id, CAST(n // 20 AS INTEGER) AS page FROM wrapped),
rp AS (SELECT doc_id, page FROM bp WHERE NOT (doc_id % 6 = 1 AND page > 0) UNION ALL SELECT doc_id, CAST(max(page) + 1 AS INTEGER) FROM bp WHERE doc_id % 5 = 0 GROUP BY 1)"""


def _revised(pages):
    kept = pages.where(~((F.col("doc_id") % 6 == 1) & (F.col("page") > 0))).select("doc_id", "page")
    fresh = pages.where(F.col("doc_id") % 5 == 0).groupBy("doc_id").agg((F.max("page") + 1).alias("page"))
    return kept.unionByName(fresh)


@query("page_pairs", sql(_VERSIONS, """
SELECT coalesce(b.doc_id, r.doc_id) AS doc_id, coalesce(b.page, r.page) AS page, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN r.doc_id IS NULL THEN 'removed' ELSE 'common' END AS status
FROM bp b FULL JOIN rp r ON b.doc_id = r.doc_id AND b.page = r.page"""))
def page_pairs(spark, folder):
    pages = corpus.page_table(spark, folder)
    return C.pair_pages(pages, _revised(pages), report_removed=True)


_TILE = """
tile AS (SELECT vec_id, vec_id % 20 AS doc_id, CAST(vec_id // 20 % 3 AS INTEGER) AS page, CAST(vec_id // 60 % 10 AS INTEGER) AS cx, CAST(vec_id // 600 AS INTEGER) AS cy,
                list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS INTEGER) % 256) AS tones FROM embeddings)"""


def _tiles(spark, folder):
    v = F.col("vec_id")
    return corpus.load(spark, folder, "embeddings").select(
        v, (v % 20).alias("doc_id"), (F.floor(v / 20) % 3).cast("int").alias("page"), (F.floor(v / 60) % 10).cast("int").alias("cx"),
        F.floor(v / 600).cast("int").alias("cy"),
        F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int") % 256).alias("tones"))


def _changed(spark, folder):
    """Two cells of three change: every ninth tone is 60 higher."""
    base = _tiles(spark, folder)
    raised = F.transform("tones", lambda t, i: F.when((i % 9 == 0) & (F.col("vec_id") % 3 != 0), t + 60).otherwise(t))
    return C.changed_cells(base, base.withColumn("tones", raised))


@query("changed_cells", sql(_TILE, """
SELECT doc_id, page, cx * 12 AS x0, cy * 12 AS y0, cx * 12 + 12 AS x1, cy * 12 + 12 AS y1 FROM tile WHERE vec_id % 3 <> 0"""))
def changed_cells(spark, folder):
    return _changed(spark, folder)


_MERGED = "WITH RECURSIVE " + _TILE.strip() + """,
ch AS (SELECT doc_id, page, cx, cy, cy * 100 + cx AS node FROM tile WHERE vec_id % 3 <> 0),
rc AS (SELECT doc_id, page, node AS root, cx, cy FROM ch UNION SELECT r.doc_id, r.page, root, c.cx, c.cy FROM rc r JOIN ch c ON c.doc_id = r.doc_id AND c.page = r.page AND abs(c.cx - r.cx) + abs(c.cy - r.cy) = 1),
cc AS (SELECT doc_id, page, cx, cy, min(root) AS comp FROM rc GROUP BY 1, 2, 3, 4),
rect AS (SELECT doc_id, page, min(cx) * 12 AS x0, min(cy) * 12 AS y0, max(cx) * 12 + 12 AS x1, max(cy) * 12 + 12 AS y1 FROM cc GROUP BY doc_id, page, comp)"""


@query("merged_changes", _MERGED + " SELECT * FROM rect")
def merged_changes(spark, folder):
    return C.merge_touching(_changed(spark, folder))


@query("difference_marks", _MERGED + """
SELECT doc_id, page, round(x0 * (72 / 110.0::DOUBLE) - 3, 6) AS x0, round(y1 * (72 / 110.0::DOUBLE) + 3, 6) AS y1, '変更あり' AS contents, 'square' AS type FROM rect
UNION ALL SELECT doc_id, 3, 0, 842, '追加されたページ', 'square' FROM tile WHERE doc_id % 4 = 0 GROUP BY doc_id""")
def difference_marks(spark, folder):
    tiles = _tiles(spark, folder)
    base = tiles.select("doc_id", "page").distinct()
    fresh = base.where(F.col("doc_id") % 4 == 0).select("doc_id").distinct().withColumn("page", F.lit(3))
    pages = base.unionByName(fresh).withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    added = C.pair_pages(base, pages).where(F.col("status") == "added").select("doc_id", "page")
    marks = C.difference_marks(C.merge_touching(_changed(spark, folder)), added, pages)
    return marks.select("doc_id", "page", F.round(F.col("rect")[0], 6).alias("x0"), F.round(F.col("rect")[3], 6).alias("y1"), "contents", "type")


@query("outgrown_strips", """
WITH s AS (SELECT o_orderkey AS doc_id, 900 + o_custkey % 20 AS ow, 1200 AS oh, 910 AS nw, 1195 + o_orderkey % 10 AS nh FROM orders)
SELECT doc_id, least(ow, nw) AS x0, 0 AS y0, nw AS x1, nh AS y1 FROM s WHERE nw > ow UNION ALL SELECT doc_id, 0, least(oh, nh), nw, nh FROM s WHERE nh > oh""")
def outgrown_strips(spark, folder):
    sizes = corpus.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), (900 + F.col("o_custkey") % 20).alias("ow"), F.lit(1200).cast("bigint").alias("oh"),
        F.lit(910).cast("bigint").alias("nw"), (1195 + F.col("o_orderkey") % 10).alias("nh"))
    return C.outgrown_strips(sizes).drop("page")


_BLANK = _TILE + """,
tone AS (SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN 250 - t % 5 - CASE WHEN doc_id % 4 = 0 AND vec_id % 7 = doc_id % 7 AND k = 1 THEN 100 ELSE 0 END ELSE 250 - t END AS t
         FROM (SELECT vec_id, doc_id, page, unnest(tones) AS t, generate_subscripts(tones, 1) AS k FROM tile)),
hist AS (SELECT doc_id, page, t, count(*) AS n FROM tone GROUP BY 1, 2, 3),
pap AS (SELECT doc_id, page, arg_max(t, (n, -t)) AS paper, sum(n) AS total FROM hist GROUP BY 1, 2)"""


@query("blank_pages", sql(_BLANK, """
SELECT h.doc_id, h.page FROM hist h JOIN pap p USING (doc_id, page) WHERE NOT (doc_id % 3 = 0 AND page = 1) GROUP BY h.doc_id, h.page, total
HAVING sum(CASE WHEN t < paper - 60 THEN n ELSE 0 END) / total <= 0.0015"""))
def blank_pages(spark, folder):
    """Even documents are clean, half of them with dark specks; a page with text is never blank."""
    even = F.col("doc_id") % 2 == 0
    speck = F.when((F.col("doc_id") % 4 == 0) & (F.col("vec_id") % 7 == F.col("doc_id") % 7), 100).otherwise(0)
    tones = F.transform("tones", lambda t, i: F.when(even, 250 - t % 5 - F.when(i == 0, speck).otherwise(0)).otherwise(250 - t))
    tiles = _tiles(spark, folder).withColumn("tones", tones)
    texts = tiles.select("doc_id", "page").distinct().withColumn("text", F.when((F.col("doc_id") % 3 == 0) & (F.col("page") == 1), "x").otherwise(" "))
    return C.blank_pages(tiles, texts)


# ---------------------------------------------------------------- history

_STEPS = corpus.EDIT + """,
st AS (SELECT *, sum(CASE WHEN merge_token = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM (
       SELECT *, lag(merge_token) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM edit))"""


@query("gesture_steps", sql(_STEPS, """
SELECT doc_id, CAST(step AS BIGINT) AS step, annot_id, min_by(before, seq) AS before, max_by(after, seq) AS after, count(*) AS edits FROM st GROUP BY 1, 2, 3"""))
def gesture_steps(spark, folder):
    return H.collapse_gestures(corpus.edit_events(spark, folder))


@query("state_at_step", sql(corpus.EDIT, """
SELECT doc_id, annot_id, after FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, annot_id ORDER BY seq DESC) AS rn FROM edit WHERE seq <= 3000 + doc_id * 10) WHERE rn = 1 AND op <> 'delete'"""))
def state_at_step(spark, folder):
    edits = corpus.edit_events(spark, folder)
    step = edits.select("doc_id").distinct().withColumn("n", 3000 + F.col("doc_id") * 10)
    return H.state_at(edits, step)


@query("retained_snapshots", """
SELECT doc_id, seq, bytes FROM (SELECT *, sum(bytes) OVER (PARTITION BY doc_id ORDER BY seq DESC) AS total FROM (
 SELECT user_id AS doc_id, event_id AS seq, CAST(value * 1000000 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
 WHERE rn <= 15) WHERE rn = 1 OR total <= 300000000""")
def retained_snapshots(spark, folder):
    snaps = corpus.load(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.round(F.col("value") * 1000000).cast("bigint").alias("bytes"))
    return H.retained(snaps)


@query("recent_files", """
SELECT user_id, entry, strftime(opened, '%Y-%m-%d %H:%M:%S') AS "at", position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY opened DESC, entry) AS position FROM (
 SELECT user_id, 'f' || (event_id % 17) AS entry, max(ts) AS opened FROM events GROUP BY 1, 2)) WHERE position <= 8""")
def recent_files(spark, folder):
    opened = corpus.load(spark, folder, "events").select(
        "user_id", F.concat(F.lit("f"), (F.col("event_id") % 17).cast("string")).alias("entry"), F.col("ts").alias("at"))
    return H.recent_files(opened).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("live_drafts", """
SELECT user_id AS doc_id, count(*) AS drafts FROM events WHERE ts >= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY GROUP BY 1""")
def live_drafts(spark, folder):
    drafts = corpus.load(spark, folder, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("saved_at"))
    live = H.live_drafts(drafts, F.lit("2024-02-10 12:00:00").cast("timestamp_ntz"))
    return live.groupBy("doc_id").agg(F.count("*").alias("drafts"))


# ---------------------------------------------------------------- documents

def _docs(spark, folder):
    d = F.col("doc_id")
    return corpus.documents(spark, folder, "lang", "source", "n_chars").select(
        d, F.concat(F.lit("doc"), d.cast("string"), F.lit(".pdf")).alias("name"),
        F.when(d % 3 == 0, " ").otherwise(F.concat(F.lit("Title "), d.cast("string"))).alias("title"), F.col("source").alias("author"),
        F.lit("").alias("subject"), F.lit(None).cast("string").alias("keywords"), (d % 2 == 0).alias("tagged"),
        F.when(d % 5 == 0, "").otherwise(F.col("lang")).alias("lang"), ((d * 37) % 4096).cast("int").alias("perm_bits"), F.col("n_chars").alias("bytes"))


_DOC = """
doc AS (SELECT doc_id, 'doc' || doc_id || '.pdf' AS name, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'Title ' || doc_id END AS title, source AS author, doc_id % 2 = 0 AS tagged,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS lang, CAST(doc_id * 37 % 4096 AS INTEGER) AS perm_bits, n_chars AS bytes FROM documents)"""
_IMAGES = """
img AS (SELECT vec_id % 200 AS doc_id, CAST(vec_id % 4 AS INTEGER) AS page, vec_id AS seq, vec_id % 350 AS xref,
               CASE WHEN vec_id % 3 = 0 THEN '' WHEN vec_id % 3 = 1 THEN 'picture ' || vec_id END AS alt FROM embeddings)"""


@query("corpus_description", sql(corpus.PAGE + "," + corpus.ANNOT + "," + _DOC, """
SELECT doc_id, name, title, author, bytes, (SELECT count(*) FROM page p WHERE p.doc_id = d.doc_id) AS page_count, (SELECT count(*) FROM annot a WHERE a.doc_id = d.doc_id) AS annot_count,
       (SELECT coalesce(sum(len(regexp_extract_all(html, '<h[1-6]'))), 0)::BIGINT FROM pages w WHERE w.page_id = d.doc_id) AS toc_count FROM doc d"""))
def corpus_description(spark, folder):
    toc = corpus.load(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit("<h[1-6]"), F.lit(0))).alias("title"))
    full = D.describe(_docs(spark, folder), corpus.page_table(spark, folder), corpus.annots(spark, folder), toc)
    return full.select("doc_id", "name", "title", "author", "bytes", "page_count", "annot_count", "toc_count")


@query("permissions", sql(_DOC, """
SELECT doc_id, array_to_string(list_filter([CASE WHEN perm_bits & 8 = 0 THEN '内容の変更' END, CASE WHEN perm_bits & 32 = 0 THEN '注釈・書き込み' END, CASE WHEN perm_bits & 256 = 0 THEN 'フォームへの入力' END,
  CASE WHEN perm_bits & 1024 = 0 THEN 'ページの追加・削除・並べ替え' END, CASE WHEN perm_bits & 4 = 0 THEN '文字のコピー' END, CASE WHEN perm_bits & 4 = 0 THEN '印刷' END], lambda x: x IS NOT NULL), '/') AS denied,
  4 * (doc_id % 2) + 8 + 16 * (doc_id % 3 // 2) + 32 + 256 + 512 + 1024 + 2048 AS bits FROM doc""").replace("perm_bits & 4 = 0 THEN '文字のコピー'", "perm_bits & 16 = 0 THEN '文字のコピー'"))
def permissions(spark, folder):
    d = F.col("doc_id")
    bits = D.permission_bits({"print": d % 2 == 1, "copy": d % 3 == 2})
    return _docs(spark, folder).select("doc_id", F.array_join(D.restrictions(F.col("perm_bits")), "/").alias("denied"), bits.alias("bits"))


@query("metadata_changes", sql(_DOC, """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'New ' || doc_id ELSE title END AS title, author, '' AS scrubbed_title, bytes FROM doc"""))
def metadata_changes(spark, folder):
    docs = _docs(spark, folder)
    new = docs.where(F.col("doc_id") % 4 == 0).select("doc_id", F.concat(F.lit("New "), F.col("doc_id").cast("string")).alias("title"))
    scrubbed = D.scrub(docs).select("doc_id", F.col("title").alias("scrubbed_title"))
    return D.set_metadata(docs, new).join(scrubbed, "doc_id").select("doc_id", "title", "author", "scrubbed_title", "bytes")


@query("image_alt_texts", sql(_IMAGES, """
SELECT doc_id, page, seq, xref, CASE WHEN xref % 6 = 2 THEN 'set' ELSE alt END AS alt, coalesce(CASE WHEN xref % 6 = 2 THEN 'set' ELSE alt END, '') = '' AS missing FROM img"""))
def image_alt_texts(spark, folder):
    pictures = images(spark, folder)
    texts = pictures.where(F.col("xref") % 6 == 2).select("doc_id", "xref").distinct().withColumn("alt", F.lit("set"))
    return D.alt_inventory(D.set_alt(pictures, texts)).select("doc_id", "page", "seq", "xref", "alt", "missing")


@query("accessibility_audit", sql(corpus.SPANS + "," + _DOC + "," + _IMAGES, """,
pt AS (SELECT doc_id, page, CASE WHEN doc_id % 5 = 0 AND page % 2 = 1 THEN 0 ELSE sum(length(trim(text))) END AS chars FROM span GROUP BY 1, 2),
so AS (SELECT DISTINCT i.doc_id, i.page FROM img i LEFT JOIN pt ON pt.doc_id = i.doc_id AND pt.page = i.page WHERE coalesce(chars, 0) = 0),
fa AS (SELECT d.*, coalesce(n, 0) AS images, coalesce(w, 0) AS without_alt, coalesce(s, 0) AS scanned, pg FROM doc d
   LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE coalesce(alt, '') = '') AS w FROM img GROUP BY 1) USING (doc_id)
   LEFT JOIN (SELECT doc_id, count(*) AS s, array_to_string(list_sort(list(page + 1)), ',') AS pg FROM so GROUP BY 1) USING (doc_id))
SELECT doc_id, images, without_alt, scanned, pg AS scanned_pages, array_to_string(list_filter([CASE WHEN NOT tagged THEN 'tags:high' END, CASE WHEN lang = '' THEN 'lang:medium' END,
  CASE WHEN without_alt > 0 THEN 'alt:high' END, CASE WHEN scanned > 0 THEN 'scanned:high' END, CASE WHEN trim(title) = '' THEN 'title:low' END], lambda x: x IS NOT NULL), ' ') AS issues,
  tagged AND lang <> '' AND without_alt = 0 AND scanned = 0 AND trim(title) <> '' AS passed FROM fa""").replace("\n,\npt", ",\npt"))
def accessibility_audit(spark, folder):
    found = D.audit(_docs(spark, folder), page_chars(spark, folder), images(spark, folder))
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["id"], i["severity"])), " ")
    pages = F.array_join(F.transform("scanned_pages", lambda p: p.cast("string")), ",")
    return found.withColumns({"issues": issues, "scanned_pages": pages})


@query("accessibility_pages", sql(corpus.SPANS + "," + _IMAGES, """,
pt AS (SELECT doc_id, page, CASE WHEN doc_id % 5 = 0 AND page % 2 = 1 THEN 0 ELSE sum(length(trim(text))) END AS chars FROM span GROUP BY 1, 2)
SELECT DISTINCT i.doc_id, i.page + 1 AS page FROM img i LEFT JOIN pt ON pt.doc_id = i.doc_id AND pt.page = i.page WHERE coalesce(chars, 0) = 0""").replace("\n,\npt", ",\npt"))
def accessibility_pages(spark, folder):
    """Every page that has pictures and no text, counted from one."""
    return D.picture_pages(page_chars(spark, folder), images(spark, folder)).select("doc_id", (F.col("page") + 1).alias("page"))


@query("scrubbed_parts", sql(corpus.FIELD + "," + _IMAGES, """,
l AS (SELECT doc_id, count(*) AS links FROM img GROUP BY 1)
SELECT doc_id, name, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE value END AS value, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE coalesce(links, 0) END AS links
FROM field LEFT JOIN l USING (doc_id)""").replace("\n,\nl AS", ",\nl AS"))
def scrubbed_parts(spark, folder):
    """Field values reset in every second document, links taken out of every third."""
    fields, d = corpus.fields(spark, folder), F.col("doc_id")
    links = images(spark, folder).select("doc_id", "page", "seq")
    left = D.scrub_links(links.where(d % 3 != 0)).unionByName(D.scrub_links(links.where(d % 3 == 0), remove=True)).groupBy("doc_id").agg(F.count("*").alias("links"))
    cleared = D.scrub_fields(fields.where(d % 2 == 0), reset=True).unionByName(D.scrub_fields(fields.where(d % 2 != 0)))
    return cleared.join(left, "doc_id", "left").select("doc_id", "name", "value", F.coalesce("links", F.lit(0)).alias("links"))


# ---------------------------------------------------------------- small functions

@query("colours", """
SELECT event_id, printf('#%02x%02x%02x', event_id % 256, event_id * 7 % 256, event_id * 13 % 256) AS code, upper(printf('%06x', event_id * 977 % 16777216)) AS packed,
  round((event_id % 256 * 0.3 + event_id * 7 % 256 * 0.59 + event_id * 13 % 256 * 0.11)::DOUBLE / 255, 6) AS grey,
  printf('#%02x%02x%02x', CAST(round_even((1 - event_id % 11 / 10.0) * 0.75 * 255, 0) AS INTEGER), 191, 96) AS from_cmyk FROM events""")
def colours(spark, folder):
    e = F.col("event_id")
    parts = [(e % 256) / 255, (e * 7 % 256) / 255, (e * 13 % 256) / 255]
    cmyk = F.array((e % 11) / F.lit(10.0), F.lit(0.0), F.lit(0.4980392), F.lit(0.25))
    written = corpus.load(spark, folder, "events").select("event_id", K.rgb_to_hex(F.array(*parts)).alias("code"), K.packed_to_hex(e * 977 % 16777216).alias("packed"),
                                                         K.rgb_to_hex(cmyk).alias("from_cmyk"))
    return written.withColumn("grey", F.round(K.grey(K.hex_to_rgb(F.col("code"))), 6))


@query("file_dates", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS iso FROM events""")
def file_dates(spark, folder):
    e = F.col("event_id")
    full = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+09'00'"))
    text = F.when(e % 5 == 4, "D:2024").when(e % 5 == 3, F.date_format("ts", "yyyyMMdd")).otherwise(full)
    return corpus.load(spark, folder, "events").select("event_id", F.date_format(K.pdf_date(text), "yyyy-MM-dd HH:mm:ss").alias("iso"))


@query("font_names", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Arial' WHEN 1 THEN '游明朝' WHEN 2 THEN '游ゴシック' WHEN 3 THEN 'Open Sans' WHEN 4 THEN 'ＭＳ Ｐゴシック' ELSE p_type END AS office FROM part""")
def font_names(spark, folder):
    k = F.col("p_partkey") % 6
    name = (F.when(k == 0, "ABCDEF+Helvetica-Bold").when(k == 1, "HeiseiMin-W3").when(k == 2, "NotoSansCJKjp-Regular").when(k == 3, "XYZABC+OpenSans-Light")
            .when(k == 4, "MS-PGothic").otherwise(F.concat("p_type", F.lit("-Regular"))))
    return corpus.load(spark, folder, "part").select("p_partkey", K.office_font(name).alias("office"))


@query("file_sizes", r"""
SELECT o_orderkey, CASE WHEN b >= 10485760 THEN printf('%.0f', b / 1048576.0) || ' MB' WHEN b >= 1048576 THEN printf('%.1f', b / 1048576.0) || ' MB'
  ELSE greatest(1, CAST(floor(b / 1024.0 + 0.5) AS BIGINT)) || ' KB' END AS size FROM (SELECT o_orderkey, o_orderkey * 997 + o_custkey AS b FROM orders)""")
def file_sizes(spark, folder):
    return corpus.load(spark, folder, "orders").select("o_orderkey", M.size_text(F.col("o_orderkey") * 997 + F.col("o_custkey")).alias("size"))


@query("escaped_texts", """
SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS markup, md5(replace(replace(replace(html, '\\', '\\\\'), '(', '\\('), ')', '\\)')) AS fdf, true AS back FROM pages""".replace("\\\\", "\\"))
def escaped_texts(spark, folder):
    html = F.col("html")
    return corpus.load(spark, folder, "pages").select(
        "page_id", F.md5(T.escape_markup(html)).alias("markup"), F.md5(T.escape_fdf(html)).alias("fdf"),
        (T.unescape_fdf(T.escape_fdf(html)) == html).alias("back"))


@query("list_item_starts", corpus.LINES.strip().join(["WITH ", r"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(ltrim(text), '^(?:[・•●○▪■◆◇★☆※\-–—‣◦▶▷]|[（(]?[0-9]+[.)）．、]|[①-⑳]|[（(][0-9a-zA-Zぁ-んァ-ン一-龥０-９]+[）)])')) AS items FROM lines GROUP BY 1"""]))
def list_item_starts(spark, folder):
    return corpus.lines(spark, folder).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(T.starts_like_item(F.ltrim("text"))).alias("items"))


@query("bullet_characters", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '•' WHEN 1 THEN '■' WHEN 2 THEN 'n' WHEN 3 THEN '◦' ELSE '•' END AS bullet FROM events""")
def bullet_characters(spark, folder):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "\uf0b7").when(k.isin(1, 2), "n").when(k == 3, "o").otherwise("\uf0ff")
    font = F.when(k == 1, "Wingdings").when(k == 3, "Courier New").otherwise("Arial")
    return corpus.load(spark, folder, "events").select("event_id", T.bullet_character(text, font).alias("bullet"))

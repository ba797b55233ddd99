"""Registered queries over review comments, take-off and forms."""

from pyspark.sql import functions as F

from folioframe.functions import labels as L
from folioframe.functions import measure as M
from folioframe.operators import forms, review, takeoff
from folioframe.plans import corpus
from folioframe.plans.registry import query, sql
from folioframe.session import scratch_folder
from folioframe.sources import files

# ---------------------------------------------------------------- replies

_CONV = """
parent AS (SELECT conv_id AS doc_id, CAST(conv_id AS VARCHAR) AS id, role AS author, text AS contents FROM conversations WHERE turn = 0 AND conv_id % 7 <> 3),
resp AS (SELECT conv_id AS doc_id, CAST(conv_id AS VARCHAR) AS in_reply_to, turn AS seq, role AS author, text AS contents,
                CASE turn % 4 WHEN 3 THEN 'accepted' WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'none' END END AS state
         FROM conversations WHERE turn > 0)"""


def _conversations(spark, folder):
    """Turn 0 is the mark, later turns answer it; one conversation in seven has lost its mark."""
    turns = corpus.load(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("seq"),
        F.col("role").alias("author"), F.col("text").alias("contents"))
    marks = turns.where((F.col("seq") == 0) & (F.col("doc_id") % 7 != 3)).withColumn("state", F.lit(None).cast("string"))
    state = F.when(F.col("seq") % 4 == 3, F.lit("accepted")).when(
        (F.col("seq") % 4 == 2) & (F.col("doc_id") % 2 == 0), F.lit("none"))
    return marks, turns.where(F.col("seq") > 0).withColumnRenamed("id", "in_reply_to").withColumn("state", state)


@query("thread_replies", sql(_CONV, """
SELECT p.doc_id, p.id, p.author, p.contents,
       (SELECT CASE WHEN max_by(state, seq) <> 'none' THEN max_by(state, seq) END FROM resp r WHERE r.doc_id = p.doc_id AND state IS NOT NULL) AS state,
       (SELECT count(*) FROM resp r WHERE r.doc_id = p.doc_id AND state IS NULL) AS replies, false AS orphan FROM parent p
UNION ALL SELECT doc_id, in_reply_to || '/' || seq, author, contents, NULL, 0, true FROM resp r
WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.doc_id = r.doc_id)"""))
def thread_replies(spark, folder):
    marks, orphans = review.thread_replies(*_conversations(spark, folder))
    left = marks.select("doc_id", "id", "author", "contents", "state", "replies", F.lit(False).alias("orphan"))
    return left.unionByName(orphans.select(
        "doc_id", F.concat_ws("/", "in_reply_to", F.col("seq").cast("string")).alias("id"), "author", "contents",
        F.lit(None).cast("string").alias("state"), F.lit(0).cast("bigint").alias("replies"), F.lit(True).alias("orphan")))


@query("reply_rows", sql(_CONV, """
SELECT r.doc_id, in_reply_to, seq, author, contents FROM resp r WHERE state IS NULL AND EXISTS (SELECT 1 FROM parent p WHERE p.doc_id = r.doc_id)"""))
def reply_rows(spark, folder):
    return review.replies_of(*_conversations(spark, folder)).select("doc_id", "in_reply_to", "seq", "author", "contents")


# ---------------------------------------------------------------- filters and lists

_FILTER = "type = 'note' AND checked AND state = 'accepted' AND contains(lower(text || ' ' || contents || ' ' || author || ' ' || subject), 'topic')"


@query("comment_filter", sql(corpus.ANNOT, f"""
SELECT doc_id, id, page, type, author, subject, state FROM annot WHERE {_FILTER}
UNION ALL SELECT doc_id, id, page, type, author, subject, state FROM annot WHERE state IS NULL AND NOT checked AND author = 'u3'"""))
def comment_filter(spark, folder):
    marks = corpus.annots(spark, folder)
    cols = ["doc_id", "id", "page", "type", "author", "subject", "state"]
    one = review.filter_comments(marks, checked="checked", state="accepted", kind="note", text="TOPIC")
    # "caret" does not occur in the data, so that filter is ignored.
    two = review.filter_comments(marks, checked="unchecked", state="none", kind="caret", author="u3")
    return one.select(cols).unionByName(two.select(cols))


@query("comment_list_counts", sql(corpus.ANNOT, f"""
SELECT doc_id, count(*) AS total, count(DISTINCT author) AS authors, count(DISTINCT type) AS kinds, count(*) FILTER (WHERE {_FILTER}) AS visible
FROM annot GROUP BY 1"""))
def comment_list_counts(spark, folder):
    marks = corpus.annots(spark, folder)
    return review.list_counts(marks, review.filter_comments(
        marks, checked="checked", state="accepted", kind="note", text="topic"))


@query("managed_marks", sql(corpus.ANNOT, """
SELECT doc_id, type, count(*) AS marks FROM annot WHERE type <> 'popup' GROUP BY 1, 2"""))
def managed_marks(spark, folder):
    return review.managed(corpus.annots(spark, folder)).groupBy("doc_id", "type").agg(F.count("*").alias("marks"))


@query("comment_list_capped", sql(corpus.ANNOT, """
SELECT doc_id, id, rank FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(state, ''), page, y0, event_id) AS rank FROM annot)"""))
def comment_list_capped(spark, folder):
    """Every row of every comment list with its rank, sorted by state."""
    marks = corpus.annots(spark, folder)
    return review.ranked(marks, ["doc_id"], [*review.comment_order("state"), F.col("event_id")]).select(
        "doc_id", "id", F.col("_rank").alias("rank"))


@query("comment_list_by_author", sql(corpus.ANNOT, f"""
SELECT doc_id, id, rank FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY author, page, y0, event_id) AS rank FROM annot)"""))
def comment_list_by_author(spark, folder):
    """Every row of every comment list with its rank, sorted by author in Japanese collation."""
    marks = corpus.annots(spark, folder)
    return review.ranked(marks, ["doc_id"], [*review.comment_order("author"), F.col("event_id")]).select(
        "doc_id", "id", F.col("_rank").alias("rank"))


@query("comment_list_by_page", sql(corpus.ANNOT, """
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, event_id) AS rank FROM annot"""))
def comment_list_by_page(spark, folder):
    marks = corpus.annots(spark, folder)
    return review.ranked(marks, ["doc_id"], [*review.comment_order("page"), F.col("event_id")]).select("doc_id", "id", F.col("_rank").alias("rank"))


@query("comment_list_by_date", sql(corpus.ANNOT, """
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY created, page, y0, event_id) AS rank FROM annot"""))
def comment_list_by_date(spark, folder):
    marks = corpus.annots(spark, folder)
    return review.ranked(marks, ["doc_id"], [*review.comment_order("created"), F.col("event_id")]).select("doc_id", "id", F.col("_rank").alias("rank"))


@query("report_positions", sql(corpus.ANNOT, """
SELECT doc_id, page, count(*) AS marks, min(y0) AS first_y, max_by(id, (y0, x0, event_id)) AS last_id FROM annot GROUP BY 1, 2"""))
def report_positions(spark, folder):
    """Report order within a page: marks, first height, and the mark that comes last."""
    key = F.struct(*review.report_order()[1:], F.col("event_id"))
    return corpus.annots(spark, folder).groupBy("doc_id", "page").agg(
        F.count("*").alias("marks"), F.min(F.col("rect")[1]).alias("first_y"), F.max_by("id", key).alias("last_id"))


_CASE = {k: "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) + " END"
         for k, t in (("type", L.TYPE_LABELS), ("state", L.STATE_LABELS))}
_TYPE_SQL = "coalesce(" + _CASE["type"].format(c="type") + ", type)"
_STATE_SQL = "coalesce(" + _CASE["state"].format(c="state") + ", '')"


@query("comment_labels", sql(corpus.ANNOT, f"""
SELECT doc_id, id, {_TYPE_SQL} AS type_label, {_STATE_SQL} AS state_label,
       CASE WHEN text = '' THEN contents ELSE text || chr(10) || contents END AS body,
       CASE WHEN type = 'freetext' THEN CASE WHEN text <> '' THEN text ELSE '（空のテキスト）' END ELSE contents END AS summary FROM annot"""))
def comment_labels(spark, folder):
    c = F.col
    return corpus.annots(spark, folder).select(
        "doc_id", "id", L.type_label(c("type")).alias("type_label"), L.state_label(c("state")).alias("state_label"),
        L.body_text(c("text"), c("contents")).alias("body"),
        L.comment_summary(c("type"), c("text"), c("contents"), c("subject")).alias("summary"))


# ---------------------------------------------------------------- quotes and reports

_QUADS = corpus.CHARS + """,
marked AS (SELECT doc_id, page, line, 'm' || page || '_' || line AS id, x0 AS a0, y0 AS b0, x0 + 20 * size * 0.5 AS a1, y1 AS b1 FROM span WHERE line % 5 = 1),
quoted AS (SELECT m.doc_id, m.id, m.page, m.b0, m.a0, trim(string_agg(c.c, '' ORDER BY c.line, c.seq), ' ' || chr(9)) AS quote FROM marked m JOIN chars c
           ON c.doc_id = m.doc_id AND c.page = m.page AND (c.x0 + c.x1) / 2 >= a0 AND (c.x0 + c.x1) / 2 < a1 AND (c.y0 + c.y1) / 2 >= b0 AND (c.y0 + c.y1) / 2 < b1
           GROUP BY 1, 2, 3, 4, 5)"""


def _highlights(spark, folder):
    """A highlight over the first twenty characters of every fifth visual line."""
    x1 = F.col("x0") + F.col("size") * 10.0
    quad = F.array("x0", "y0", x1, F.col("y0"), F.col("x0"), F.col("y1"), x1, F.col("y1"))
    return corpus.spans(spark, folder).where(F.col("line") % 5 == 1).select(
        "doc_id", "page", F.concat_ws("_", F.concat(F.lit("m"), F.col("page").cast("string")), F.col("line").cast("string")).alias("id"),
        F.lit("highlight").alias("type"), F.array(quad).alias("quads"))


@query("quoted_text", sql(_QUADS, "SELECT doc_id, id, quote FROM quoted WHERE quote <> ''"))
def quoted_text(spark, folder):
    return review.quoted_text(_highlights(spark, folder), corpus.runs(corpus.spans(spark, folder)), corpus.centres())


def _report_inputs(spark, folder):
    marks = corpus.annots(spark, folder).withColumns({"quote": F.lit(""), "replies": F.lit(0)})
    replies = marks.where(F.col("event_id") % 6 == 0).select(
        "doc_id", F.col("id").alias("in_reply_to"), F.col("event_id").alias("seq"), F.lit("").alias("author"),
        F.concat(F.lit("re "), F.col("id")).alias("contents"))
    names = marks.select("doc_id", F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("name")).distinct()
    return marks, replies, names


@query("comments_csv", sql(corpus.ANNOT, f"""
SELECT doc_id, page, y0 AS y, x0 AS x, id,
       (page + 1) || ',' || {_TYPE_SQL} || ',' || author || ',' || subject || ',' || {_STATE_SQL} || ',' || CASE WHEN checked THEN '✓' ELSE '' END
       || ',"' || replace(CASE WHEN text = '' THEN contents ELSE text || chr(10) || contents END, '"', '""') || '",,0,' || stroke || ','
       || strftime(created, '%Y-%m-%dT%H:%M:%S') || ',' || printf('%.1f', x0) || ',' || printf('%.1f', y0) || ',' || printf('%.1f', x0 + 40) || ',' || printf('%.1f', y0 + 12) AS line
FROM annot UNION ALL SELECT DISTINCT doc_id, -1, 0, 0, '', 'ページ,種類,作成者,主題,状態,チェック済,本文,対象テキスト,返信数,色,作成日時,x0,y0,x1,y1' FROM annot"""))
def comments_csv(spark, folder):
    lines = review.csv_lines(_report_inputs(spark, folder)[0])
    return lines.select("doc_id", "page", F.col("_y").alias("y"), F.col("_x").alias("x"), "id", "line")


_TAGGED = "CASE lower(stroke) WHEN '#e0403a' THEN ' · #objection' WHEN '#ffeb3b' THEN ' · #key' ELSE '' END"


@query("comments_markdown", sql(corpus.ANNOT, f"""
SELECT doc_id, page, part, id, pos, line FROM (
 SELECT doc_id, -1 AS page, 0 AS part, '' AS id, unnest([0, 1, 2, 3]) AS pos, unnest(['# file' || doc_id, '', '注釈 ' || n || ' 件', '']) AS line
   FROM (SELECT doc_id, count(*) AS n FROM annot GROUP BY 1)
 UNION ALL SELECT doc_id, page, 1, '', unnest([0, 1, 2]), unnest(['', '## ' || (page + 1) || ' ページ', '']) FROM (SELECT DISTINCT doc_id, page FROM annot)
 UNION ALL SELECT doc_id, page, 2, id, unnest([0, 1, 2]), unnest(['**' || {_TYPE_SQL} || ' · ' || author || {_TAGGED}
        || CASE WHEN state IS NULL THEN '' ELSE ' · ［' || {_STATE_SQL} || '］' END || '**', '',
        CASE WHEN text = '' THEN contents ELSE text || chr(10) || contents END]) FROM annot
 UNION ALL SELECT doc_id, page, 3, id, unnest([event_id * 2, event_id * 2 + 1]), unnest(['', '- **返信**: re ' || id]) FROM annot WHERE event_id % 6 = 0
 UNION ALL SELECT doc_id, page, 4, id, 0, '' FROM annot)"""))
def comments_markdown(spark, folder):
    lines = review.markdown_lines(*_report_inputs(spark, folder), {"#e0403a": "objection", "#ffeb3b": "key"})
    return lines.select("doc_id", "page", "part", "id", "pos", "line")


@query("comments_summary_html", sql(corpus.ANNOT, f"""
SELECT doc_id, page, part, id, pos, line FROM (
 SELECT doc_id, -1 AS page, 0 AS part, '' AS id, 0 AS pos, '<h1>注釈一覧</h1><div class=''meta''>file' || doc_id || ' — ' || count(*) || ' 件</div>' AS line FROM annot GROUP BY 1
 UNION ALL SELECT DISTINCT doc_id, page, 1, '', 0, '<h2>' || (page + 1) || ' ページ</h2>' FROM annot
 UNION ALL SELECT doc_id, page, 2, id, 0, '<div class=''item'' style=''border-left-color:' || stroke || '''><div class=''head''>' || {_TYPE_SQL} || ' · ' || author
        || CASE WHEN state IS NULL THEN '' ELSE ' · ' || {_STATE_SQL} END || CASE WHEN checked THEN ' · ✓' ELSE '' END || '</div><div class=''body''>'
        || CASE WHEN text = '' THEN contents ELSE text || chr(10) || contents END || '</div>' FROM annot
 UNION ALL SELECT doc_id, page, 3, id, event_id, '<div class=''reply''>↳ <b>返信</b>: re ' || id || '</div>' FROM annot WHERE event_id % 6 = 0
 UNION ALL SELECT doc_id, page, 4, id, 0, '</div>' FROM annot)"""))
def comments_summary_html(spark, folder):
    return review.summary_lines(*_report_inputs(spark, folder)).select("doc_id", "page", "part", "id", "pos", "line")


# ---------------------------------------------------------------- ids, changes, drafts

@query("repair_ids", """
WITH a AS (SELECT user_id AS doc_id, CASE WHEN event_id % 9 = 4 THEN '' ELSE 'n' || (event_id % 400) END AS id, event_id AS seq FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY seq) AS rn FROM a)
SELECT doc_id, seq, CASE WHEN rn = 1 AND id <> '' THEN id ELSE 'ff-' || substr(sha256(doc_id || ':' || seq), 1, 12) END AS id FROM f""")
def repair_ids(spark, folder):
    e = F.col("event_id")
    marks = corpus.load(spark, folder, "events").select(F.col("user_id").alias("doc_id"), e.alias("seq"), F.when(
        e % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("n"), (e % 400).cast("string"))).alias("id"))
    return review.repair_ids(marks, ["seq"]).select("doc_id", "seq", "id")


_VERSIONS = corpus.ANNOT + """,
wanted AS (SELECT doc_id, id, type, CASE WHEN event_id % 11 = 5 THEN upper(subject) ELSE subject END AS subject,
                  CASE WHEN event_id % 17 = 2 THEN x0 + 0.001 WHEN event_id % 19 = 2 THEN x0 + 1 ELSE x0 END AS x0, checked FROM annot WHERE event_id % 13 <> 7
           UNION ALL SELECT doc_id, 'new' || id, type, subject, x0, checked FROM annot WHERE event_id % 23 = 1)"""


def _versions(spark, folder):
    marks = corpus.annots(spark, folder).withColumn("x0", F.col("rect")[0])
    e = F.col("event_id")
    kept = marks.where(e % 13 != 7).withColumns({
        "subject": F.when(e % 11 == 5, F.upper("subject")).otherwise(F.col("subject")),
        "x0": F.when(e % 17 == 2, F.col("x0") + 0.001).when(e % 19 == 2, F.col("x0") + 1).otherwise(F.col("x0"))})
    added = marks.where(e % 23 == 1).withColumn("id", F.concat(F.lit("new"), "id"))
    form = review.canonical(["type", "subject", "x0", "checked", "created", "_event"], ["x0"])
    return marks.withColumn("form", form), kept.unionByName(added).withColumn("form", form)


@query("baseline_diff", sql(_VERSIONS, """
SELECT coalesce(a.doc_id, w.doc_id) AS doc_id, coalesce(a.id, w.id) AS id,
       CASE WHEN a.id IS NULL THEN 'insert' WHEN w.id IS NULL THEN 'delete'
            WHEN a.subject = w.subject AND round(a.x0, 2) = round(w.x0, 2) THEN 'unchanged' ELSE 'update' END AS action
FROM annot a FULL JOIN wanted w ON a.doc_id = w.doc_id AND a.id = w.id"""))
def baseline_diff(spark, folder):
    return review.baseline_diff(*_versions(spark, folder))


@query("draft_offers", sql(_VERSIONS, """
SELECT a.doc_id, w.n AS draft_marks, a.n AS marks FROM (SELECT doc_id, count(*) AS n, string_agg(id || subject || round(x0, 2), '|' ORDER BY id) AS f FROM annot GROUP BY 1) a
JOIN (SELECT doc_id, count(*) AS n, string_agg(id || subject || round(x0, 2), '|' ORDER BY id) AS f FROM wanted GROUP BY 1) w ON a.doc_id = w.doc_id
WHERE a.f <> w.f AND a.doc_id % 3 <> 1"""))
def draft_offers(spark, folder):
    base, wanted = _versions(spark, folder)
    pages = F.when(F.col("doc_id") % 3 == 1, 31).otherwise(30)
    return review.draft_offers(wanted.withColumn("page_count", pages), base.withColumn("page_count", F.lit(30)))


@query("rebind_marks", sql(corpus.ANNOT, """
SELECT doc_id, id, 'mine' AS origin FROM annot WHERE event_id % 4 = 0
UNION ALL SELECT doc_id, id, 'file' FROM annot WHERE event_id % 4 <> 0"""))
def rebind_marks(spark, folder):
    marks = corpus.annots(spark, folder)
    mine = marks.where(F.col("event_id") % 4 == 0).select("doc_id", "id", F.lit("mine").alias("origin"))
    return review.rebind(marks.select("doc_id", "id", F.lit("file").alias("origin")), mine)


@query("stamp_counts", """
SELECT user_id AS doc_id, event_type AS kind, count(DISTINCT event_id % 30) AS pages FROM events GROUP BY 1, 2""")
def stamp_counts(spark, folder):
    return review.count_stamps(_stamps(spark, folder))


def _stamps(spark, folder):
    return corpus.load(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 30).alias("page"), "event_id")


@query("stamps_left", """
SELECT user_id AS doc_id, count(*) AS marks, count(DISTINCT event_type) AS kinds FROM events
WHERE NOT (event_type IN ('click', 'view') AND event_id % 30 < 10) GROUP BY 1""")
def stamps_left(spark, folder):
    """What remains after two kinds of stamp are taken off the first ten pages."""
    marks = _stamps(spark, folder)
    pages = marks.select("doc_id", "page").where(F.col("page") < 10).distinct()
    left = review.remove_marks(marks, ["click", "view"], pages)
    return left.groupBy("doc_id").agg(F.count("*").alias("marks"), F.countDistinct("kind").alias("kinds"))


@query("patched_style", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '#111' ELSE '#222' END AS stroke, 'x' AS fill, props AS note FROM events""")
def patched_style(spark, folder):
    e = F.col("event_id")
    m = "map<string,map<string,string>>"
    target = F.create_map(F.lit("style"), F.create_map(F.lit("stroke"), F.lit("#111"), F.lit("fill"), F.lit("x")),
                          F.lit("info"), F.create_map(F.lit("note"), F.lit("old"), F.lit("extra"), F.lit("1"))).cast(m)
    patch = F.create_map(F.lit("style"), F.when(e % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("stroke"), F.lit("#222"))), F.lit("info"), F.create_map(F.lit("note"), F.col("props"))).cast(m)
    done = review.apply_patch(target, patch, ["style"])
    return corpus.load(spark, folder, "events").select(
        "event_id", done["style"]["stroke"].alias("stroke"), done["style"]["fill"].alias("fill"),
        done["info"]["note"].alias("note"))


# ---------------------------------------------------------------- take-off

_LABEL_SQL = "CASE WHEN subject <> '' THEN subject WHEN kind = 'area' THEN '面積' WHEN kind = 'distance' THEN '距離' ELSE 'カウント' END"
_UNIT_SQL = "CASE kind WHEN 'area' THEN 'm²' WHEN 'distance' THEN 'm' ELSE '' END"
_ROWS = f"""
SELECT {{by}}{_LABEL_SQL} AS label, min_by(stroke, seq) AS colour, min_by(kind, seq) AS kind, min_by({_UNIT_SQL}, seq) AS unit,
       min_by(kind, seq) <> 'count' AS summable, count(*) AS count, round(sum(value), 4) AS total,
       array_to_string(list_sort(list_distinct(list(page + 1))), ' ') AS pages FROM meas GROUP BY ALL"""


@query("takeoff_by_document", sql(corpus.MEASURE, _ROWS.format(by="doc_id, ")))
def takeoff_by_document(spark, folder):
    rows = takeoff.summarise(corpus.measures(spark, folder), ["doc_id"])
    return rows.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), " "))


@query("takeoff_panel", sql(corpus.MEASURE, """
SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY label) AS place
FROM (SELECT DISTINCT doc_id, {label} AS label FROM meas)""".replace("{label}", _LABEL_SQL)))
def takeoff_panel(spark, folder):
    """The labels of a document in the order of the live panel."""
    return takeoff.panel_order(takeoff.summarise(corpus.measures(spark, folder), ["doc_id"]), ["doc_id"]).select("doc_id", "label", "place")


@query("takeoff_totals", sql(corpus.MEASURE, f"""
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS items FROM (SELECT count(*) AS n FROM meas GROUP BY {_LABEL_SQL})"""))
def takeoff_totals(spark, folder):
    return takeoff.totals(takeoff.summarise(corpus.measures(spark, folder)))


@query("takeoff_csv", sql(corpus.MEASURE, f"""
SELECT doc_id, page, l_discount AS y, seq, (page + 1) || ',' || subject || ',' || kind || ',' || value || ',m,' || value || ' m,' AS line FROM meas"""))
def takeoff_csv(spark, folder):
    return takeoff.detail_csv(corpus.measures(spark, folder))


@query("takeoff_summary_csv", sql(corpus.MEASURE, f"""
SELECT label || ',' || kind || ',' || count || ',' || total || ',' || unit || ',' || pages || ',' || colour AS line FROM ({_ROWS.format(by='')})"""))
def takeoff_summary_csv(spark, folder):
    return takeoff.summary_csv(takeoff.summarise(corpus.measures(spark, folder))).select("line")


@query("takeoff_report_csv", sql(corpus.MEASURE, f"""
SELECT doc_id, 0 AS part, '0' AS label, 0 AS page, 0.0::DOUBLE AS y, '分類,種別,個数,合計,単位,ページ,色' AS line FROM meas GROUP BY 1
UNION ALL SELECT doc_id, 1, label, 0, 0, label || ',' || kind || ',' || count || ',' || total || ',' || unit || ',' || pages || ',' || colour FROM ({_ROWS.format(by='doc_id, ')})
UNION ALL SELECT doc_id, 2, '0', 0, 0, '' FROM meas GROUP BY 1
UNION ALL SELECT doc_id, 2, '1', 0, 0, 'ページ,分類,種別,値,単位,表示,コメント' FROM meas GROUP BY 1
UNION ALL SELECT doc_id, 3, '', page, l_discount, (page + 1) || ',' || subject || ',' || kind || ',' || value || ',m,' || value || ' m,' FROM meas"""))
def takeoff_report_csv(spark, folder):
    return takeoff.report_csv(corpus.measures(spark, folder)).drop("seq")


_POINTS = """
pts AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000 AS p, l_discount * 100 AS d FROM lineitem)"""


@query("measured_shapes", sql(_POINTS, """
SELECT l_orderkey, l_linenumber, round((sqrt(q * q + d * d) + sqrt((p - q) * (p - q) + (d + 1 - d) * (d + 1 - d))) * (5.0 / 99.7), 6) AS distance,
       round((sqrt(q * q + d * d) + sqrt((p - q) * (p - q) + 1) + sqrt(p * p + (d + 1) * (d + 1))) * (5.0 / 99.7), 6) AS perimeter,
       round(abs(q * (d + 1) - p * d) / 2 * (5.0 / 99.7) * (5.0 / 99.7), 6) AS area, round(abs(q * (d + 1) - p * d) / 2 * (5.0 / 99.7) * (5.0 / 99.7) * 2, 6) AS volume,
       round(sqrt(q * q + d * d) * (5.0 / 99.7), 6) AS radius,
       round(CASE WHEN t > 180 THEN 360 - t ELSE t END, 6) AS angle
FROM (SELECT *, degrees(abs(atan2(0 - d, 0 - q) - atan2(1, p - q))) AS t FROM pts)"""))
def measured_shapes(spark, folder):
    """Triangles from the order lines, at a scale of 99.7 points to 5 m."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(q, d), F.array(p, d + 1))
    shapes = corpus.load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", points.alias("pts"))
    factor = M.scale_factor(F.lit(99.7), F.lit(5.0))
    return shapes.select("l_orderkey", "l_linenumber", *[
        M.value_of(F.lit(k), F.col("pts"), factor, F.lit(2.0)).alias(k)
        for k in ("distance", "perimeter", "area", "volume", "radius", "angle")])


@query("unit_conversion", """
SELECT l_orderkey, l_linenumber, round(l_quantity * 304.8 / 1000, 4) AS metres, round(l_quantity * (25.4 / 72) / 25.4, 4) AS inches,
       printf('%.2f', l_quantity) || CASE l_returnflag WHEN 'A' THEN ' m²' WHEN 'N' THEN '°' ELSE ' m³' END AS label FROM lineitem""")
def unit_conversion(spark, folder):
    q = F.col("l_quantity")
    kind = F.when(F.col("l_returnflag") == "A", "area").when(F.col("l_returnflag") == "N", "angle").otherwise("volume")
    return corpus.load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(M.convert(q, F.lit("ft"), F.lit("m")), 4).alias("metres"),
        F.round(M.convert(q, F.lit("pt"), F.lit("in")), 4).alias("inches"), M.label_of(q, kind, F.lit("m")).alias("label"))


# ---------------------------------------------------------------- forms

@query("form_collation", """
SELECT p_partkey AS doc_id, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS seal FROM part""")
def form_collation(spark, folder):
    return forms.collate(corpus.fields(spark, folder), ["brand", "type", "size", "seal"])


@query("form_collation_cells", sql(corpus.FIELD, """
SELECT doc_id, CASE name WHEN 'brand' THEN 1 WHEN 'type' THEN 2 WHEN 'size' THEN 3 ELSE 4 END AS position, name, coalesce(value, '') AS value FROM field"""))
def form_collation_cells(spark, folder):
    """The answers of all forms in long form, names ranked by where they are first seen."""
    return forms.collate_cells(corpus.fields(spark, folder))


@query("form_collation_csv", """
SELECT 0 AS part, NULL::BIGINT AS doc_id, 'ファイル,brand,type,size,seal' AS line UNION ALL
SELECT 1, p_partkey, 'form' || p_partkey || ',' || p_brand || ',' || p_type || ',' || p_size || ',' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END FROM part""")
def form_collation_csv(spark, folder):
    """The collation as a CSV file, written in ranges and read back."""
    fields = corpus.fields(spark, folder)
    labels = fields.select("doc_id").distinct().select("doc_id", F.concat(F.lit("form"), F.col("doc_id").cast("string")).alias("name"))
    path = scratch_folder(spark, "collation")
    lines = forms.collate_lines(fields, labels).withColumn("file", F.lit("all"))
    files.write_lines(lines, path, ["part", "doc_id"], key="file")
    head = F.startswith("value", F.lit("ファイル,"))
    return spark.read.text(path).select(F.when(head, 0).otherwise(1).alias("part"), F.when(
        ~head, F.regexp_extract("value", "^form([0-9]+)", 1)).cast("bigint").alias("doc_id"), F.col("value").alias("line"))


@query("form_fill", sql(corpus.FIELD, """
SELECT doc_id, name, CASE WHEN name = 'size' AND doc_id % 3 = 0 THEN 'v' || doc_id ELSE value END AS value, name = 'size' AND doc_id % 3 = 0 AS filled FROM field"""))
def form_fill(spark, folder):
    fields = corpus.fields(spark, folder)
    key = F.col("doc_id")
    values = fields.where((F.col("name") == "size") & (key % 3 == 0)).select(
        "doc_id", "name", F.concat(F.lit("v"), key.cast("string")).alias("value"))
    return forms.fill(fields, values).select("doc_id", "name", "value", "filled")


@query("form_upsert", sql(corpus.FIELD, """
SELECT doc_id, page, seq, name, CASE WHEN seq = 1 AND doc_id % 5 = 0 THEN 'changed' ELSE value END AS value FROM field WHERE NOT (seq = 3 AND doc_id % 4 = 0)"""))
def form_upsert(spark, folder):
    fields = corpus.fields(spark, folder)
    changed = fields.where((F.col("seq") == 1) & (F.col("doc_id") % 5 == 0)).withColumn("value", F.lit("changed"))
    removed = fields.where((F.col("seq") == 3) & (F.col("doc_id") % 4 == 0))
    return forms.upsert_fields(fields, changed, removed).select("doc_id", "page", "seq", "name", "value")


@query("form_csv", sql(corpus.FIELD, """
SELECT doc_id, page, seq, name || ',' || type || ',' || coalesce(value, '') || ',' || (page + 1) || ',' || CASE WHEN required THEN '○' ELSE '' END || ','
       || CASE WHEN read_only THEN '○' ELSE '' END AS line FROM field
UNION ALL SELECT DISTINCT doc_id, -1, -1, 'フィールド名,種別,値,ページ,必須,読み取り専用' FROM field"""))
def form_csv(spark, folder):
    return forms.csv_lines(corpus.fields(spark, folder))


@query("form_fdf", sql(corpus.FIELD, """
SELECT doc_id, 1 AS part, page, seq, '<< /T (' || name || ') /V (' || coalesce(value, '') || ') >>' AS line FROM field WHERE type <> 'signature'
UNION ALL SELECT doc_id, 0, 0, unnest([0, 1, 2]), unnest(['%FDF-1.2', '1 0 obj', '<< /FDF << /Fields [']) FROM (SELECT DISTINCT doc_id FROM field)
UNION ALL SELECT doc_id, 2, 0, unnest([0, 1, 2, 3, 4]), unnest(['] /F (form\\(' || doc_id || '\\)) >> >>', 'endobj', 'trailer', '<< /Root 1 0 R >>', '%%EOF']) FROM (SELECT DISTINCT doc_id FROM field)"""))
def form_fdf(spark, folder):
    fields = corpus.fields(spark, folder)
    names = corpus.load(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(
        F.lit("form("), F.col("p_partkey").cast("string"), F.lit(")")).alias("name"))
    return forms.fdf_lines(fields, names)


@query("form_json", sql(corpus.FIELD, """
SELECT doc_id, page, seq, '"' || name || '":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END AS line FROM field"""))
def form_json(spark, folder):
    return forms.json_values(corpus.fields(spark, folder))


@query("form_values_read", sql(corpus.FIELD, """
SELECT doc_id, name, value FROM field WHERE seq IN (0, 2) AND doc_id % 2 = 1
UNION ALL SELECT doc_id, name, value FROM field WHERE seq IN (0, 2) AND doc_id % 2 = 0"""))
def form_values_read(spark, folder):
    """Form data written as FDF (odd forms) and as JSON (even forms), then read back."""
    p = corpus.load(spark, folder, "part")
    fdf = F.concat(F.lit("%FDF-1.2\n<< /FDF << /Fields [\n<< /T (brand) /V ("), "p_brand", F.lit(") >>\n<< /T (size) /V ("),
                   F.col("p_size").cast("string"), F.lit(") >>\n] >> >>"))
    json = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    texts = p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 1, fdf).otherwise(json).alias("text"))
    return forms.read_values(texts)


@query("detected_fields", """
WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ln FROM lineitem),
r AS (SELECT doc_id, ln, (doc_id + ln) % 3 <> 0 AS rule FROM d)
SELECT doc_id, 50.0::DOUBLE AS x0, CASE WHEN rule THEN 82 ELSE 90 END + 30.0::DOUBLE * ln AS y0, 250.0::DOUBLE AS x1, CASE WHEN rule THEN 100 ELSE 110 END + 30.0::DOUBLE * ln AS y1 FROM r""")
def detected_fields(spark, folder):
    """Rules and boxes of a paper form per order: a box under a rule is the same field, short strokes are none."""
    rows = corpus.load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ln")).distinct()
    y = 100 + 30.0 * F.col("ln")

    def drawing(x0, y0, w, h):
        return F.struct(F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x0 + w).alias("x1"), (y0 + h).alias("y1"))

    rule = F.when((F.col("doc_id") + F.col("ln")) % 3 != 0, drawing(50.0, y, 200.0, 1.0))
    shapes = F.array_compact(F.array(rule, drawing(50.0, y - 10, 200.0, 20.0), drawing(400.0, y, 30.0, 1.0)))
    drawings = rows.select("doc_id", F.lit(0).alias("page"), F.explode(shapes).alias("s")).select("doc_id", "page", "s.*")
    return forms.detect(drawings).select("doc_id", "x0", "y0", "x1", "y1")


@query("signature_state", sql(corpus.FIELD, """
SELECT doc_id, count(*) AS fields, count(value) AS signed FROM field WHERE type = 'signature' GROUP BY 1"""))
def signature_state(spark, folder):
    return forms.signature_state(corpus.fields(spark, folder))

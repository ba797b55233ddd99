"""Registered queries that write files and read them back, and queries over streams of edits."""

from pyspark.sql import functions as F

from folioframe.operators import review as V
from folioframe.plans import corpus
from folioframe.plans.registry import query, sql
from folioframe.session import scratch_folder
from folioframe.sources import charts, files, xfdf
from folioframe.streaming import edits as E

# ---------------------------------------------------------------- files


def _marks(spark, folder):
    """Managed marks with quads or points, ready for exchange."""
    a = V.managed(corpus.annots(spark, folder))
    r = F.col("rect")
    quad = F.array(r[0], r[1], r[2], r[1], r[0], r[3], r[2], r[3])
    pts = F.array(F.array(r[0], r[1]), F.array(r[2], r[1]), F.array(r[2], r[3]))
    none = F.lit(None).cast("string")
    return a.withColumns({
        "quads": F.when(F.col("type") == "highlight", F.array(quad)), "points": F.when(F.col("type") == "polygon", pts),
        "strokes": F.when(F.col("type") == "ink", F.array(F.struct(pts.alias("pts")))),
        "style": F.struct(F.col("stroke"), none.alias("fill"), F.lit(0.5).alias("opacity"), F.lit(2.0).alias("width"))})


def _small_files(frame):
    """Spark puts 32 small files into a task, and each task opens a file for every part of the next shuffle: 16 tasks become one."""
    return frame.coalesce(max(4 * frame.sparkSession.sparkContext.defaultParallelism, frame.rdd.getNumPartitions() // 16))


def _page_grid(marks):
    return marks.select("doc_id").distinct().withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("height", F.lit(842.0))


_XFDF = corpus.ANNOT + """,
mk AS (SELECT *, CASE type WHEN 'note' THEN 'text' ELSE type END AS tag, CASE WHEN text = '' THEN contents ELSE text || chr(10) || contents END AS body FROM annot WHERE type <> 'popup')"""


@query("xfdf_lines", sql(_XFDF, """
SELECT doc_id, page, id, pos, line FROM (
 SELECT doc_id, page, id, 0::BIGINT AS pos, '    <' || tag || ' page="' || page || '" rect="' || printf('%.2f,%.2f,%.2f,%.2f', x0, 842 - y0 - 12, x0 + 40, 842 - y0) || '" color="' || stroke || '" opacity="0.5" width="2.0" title="'
   || author || '"' || CASE WHEN subject = '' THEN '' ELSE ' subject="' || subject || '"' END || ' creationdate="' || strftime(created, '%Y-%m-%dT%H:%M:%S') || '"'
   || CASE WHEN state IS NULL THEN '' ELSE ' state="' || upper(substr(state, 1, 1)) || substr(state, 2) || '" statemodel="Review"' END
   || CASE type WHEN 'highlight' THEN ' coords="' || printf('%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f', x0, 842 - y0, x0 + 40, 842 - y0, x0, 830 - y0, x0 + 40, 830 - y0) || '"'
        WHEN 'polygon' THEN ' vertices="' || printf('%.2f,%.2f;%.2f,%.2f;%.2f,%.2f', x0, 842 - y0, x0 + 40, 842 - y0, x0 + 40, 830 - y0) || '"'
        WHEN 'ink' THEN ' inklist="' || printf('%.2f,%.2f,%.2f,%.2f,%.2f,%.2f', x0, 842 - y0, x0 + 40, 842 - y0, x0 + 40, 830 - y0) || '"' ELSE '' END
   || '><contents>' || body || '</contents></' || tag || '>' AS line FROM mk
 UNION ALL SELECT doc_id, page, id, event_id + 1, '    <text page="' || page || '" rect="' || printf('%.2f,%.2f,%.2f,%.2f', x0, 842 - y0 - 12, x0 + 40, 842 - y0) || '" inreplyto="' || id || '" title="r"><contents>re &lt;' || id || '&gt;</contents></text>' FROM mk WHERE event_id % 6 = 0
 UNION ALL SELECT doc_id, -1, '', unnest([0, 1, 2, 3]), unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<xfdf xmlns="http://ns.adobe.com/xfdf/">', '  <f href="file' || doc_id || '.pdf"/>', '  <annots>']) FROM (SELECT DISTINCT doc_id FROM annot)
 UNION ALL SELECT doc_id, 2147483647, '', unnest([0, 1]), unnest(['  </annots>', '</xfdf>']) FROM (SELECT DISTINCT doc_id FROM annot))"""))
def xfdf_lines(spark, folder):
    return _xfdf(spark, folder).select("doc_id", "page", "id", "pos", "line")


def _xfdf(spark, folder):
    marks = _marks(spark, folder)
    e = F.col("event_id")
    replies = marks.where(e % 6 == 0).select("doc_id", F.col("id").alias("in_reply_to"), e.alias("seq"), F.lit("r").alias("author"),
                                             F.concat(F.lit("re <"), "id", F.lit(">")).alias("contents"))
    names = corpus.annots(spark, folder).select("doc_id", F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name")).distinct()
    return xfdf.xfdf_lines(marks, replies, _page_grid(marks), names)


@query("xfdf_round_trip", sql(_XFDF, """
SELECT doc_id, page, type, author, count(*) AS marks, count(state) AS states, round(sum(x0), 2)::DOUBLE AS x0, round(sum(y0), 2)::DOUBLE AS y0, CAST(sum(CASE WHEN type IN ('highlight', 'polygon', 'ink') THEN 1 ELSE 0 END) AS BIGINT) AS shaped
FROM (SELECT doc_id, page, type, author, state, x0, y0 FROM mk WHERE page < 25 UNION ALL SELECT doc_id, page, 'note', 'r', NULL, x0, y0 FROM mk WHERE event_id % 6 = 0 AND page < 25) GROUP BY 1, 2, 3, 4"""))
def xfdf_round_trip(spark, folder):
    """All marks written as XFDF files, one folder a document, and read back; the last pages do not exist any more."""
    path = scratch_folder(spark, "xfdf")
    files.write_lines(_xfdf(spark, folder), path, ["page", "y", "x", "id", "pos"])
    nodes = _small_files(xfdf.read_nodes(spark, path)).withColumn("doc_id", F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint"))
    pages = _page_grid(corpus.annots(spark, folder)).where(F.col("page") < 25)
    r = F.col("rect")
    shaped = F.col("quads").isNotNull() | F.col("points").isNotNull() | (F.size("strokes") > 0)
    return xfdf.to_marks(nodes, pages).groupBy("doc_id", "page", "type", "author").agg(
        F.count("*").alias("marks"), F.count("state").alias("states"), F.round(F.sum(r[0]), 2).alias("x0"), F.round(F.sum(r[1]), 2).alias("y0"),
        F.count_if(shaped).alias("shaped"))


@query("xfdf_rejects", sql(_XFDF, """
SELECT doc_id, tag, problem, count(*) AS elements FROM (
 SELECT doc_id, tag, CASE event_id % 7 WHEN 0 THEN 'opacity' WHEN 1 THEN 'rect' WHEN 2 THEN 'page' END AS problem FROM mk WHERE event_id % 7 < 3
 UNION ALL SELECT doc_id, 'text', CASE event_id % 7 WHEN 1 THEN 'rect' WHEN 2 THEN 'page' END FROM mk WHERE event_id % 6 = 0 AND event_id % 7 IN (1, 2)) GROUP BY 1, 2, 3"""))
def xfdf_rejects(spark, folder):
    """Files in which some numbers were spoilt: what is wrong with the elements that give no mark."""
    path = scratch_folder(spark, "xfdf")
    event = F.col("id").try_cast("bigint") % 7
    spoilt = (F.when(event == 0, F.replace("line", F.lit(' opacity="0.5"'), F.lit(' opacity="abc"')))
              .when(event == 1, F.regexp_replace("line", ' rect="[^,]*,', ' rect="'))
              .when(event == 2, F.regexp_replace("line", ' page="', ' page="p')).otherwise(F.col("line")))
    files.write_lines(_xfdf(spark, folder).withColumn("line", spoilt), path, ["page", "y", "x", "id", "pos"])
    bad = xfdf.rejects(_small_files(xfdf.read_nodes(spark, path))).withColumn("doc_id", F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint"))
    return bad.groupBy("doc_id", "tag", "problem").agg(F.count("*").alias("elements"))


@query("report_files", sql(corpus.ANNOT, """
SELECT doc_id, count(*) + count(DISTINCT page) * 3 + 4 AS lines FROM (
 SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot
 UNION ALL SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot WHERE text <> ''
 UNION ALL SELECT doc_id, page FROM annot WHERE event_id % 6 = 0 UNION ALL SELECT doc_id, page FROM annot WHERE event_id % 6 = 0) GROUP BY 1"""))
def report_files(spark, folder):
    """The Markdown reports of all documents as files, counted line by line after reading them back."""
    from folioframe.plans.review import _report_inputs

    path = scratch_folder(spark, "reports")
    files.write_lines(V.markdown_lines(*_report_inputs(spark, folder)), path, ["page", "_y", "_x", "id", "part", "pos"], mark=True)
    # The document is read from the path: the driver would work out the partition values of all folders one after the other.
    doc = F.regexp_extract("_metadata.file_path", r"/doc_id=(-?\d+)/", 1).try_cast("bigint")
    return _small_files(spark.read.option("recursiveFileLookup", "true").text(path).select(doc.alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("report_shards", sql(corpus.ANNOT, """
SELECT doc_id, count(*) + count(DISTINCT page) * 3 + 4 AS lines, 8 AS files FROM (
 SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot
 UNION ALL SELECT doc_id, page FROM annot UNION ALL SELECT doc_id, page FROM annot WHERE text <> ''
 UNION ALL SELECT doc_id, page FROM annot WHERE event_id % 6 = 0 UNION ALL SELECT doc_id, page FROM annot WHERE event_id % 6 = 0) GROUP BY 1"""))
def report_shards(spark, folder):
    """The same reports in eight files, found again through their index."""
    from folioframe.plans.review import _report_inputs

    path = scratch_folder(spark, "shards")
    index = files.write_shards(V.markdown_lines(*_report_inputs(spark, folder)), path, ["page", "_y", "_x", "id", "part", "pos"], 8)
    total = spark.read.text(path).groupBy("shard").agg(F.count("*").alias("n"))
    whole = index.groupBy("shard").agg(F.sum("lines").alias("held"), F.max(F.col("first_line") + F.col("lines")).alias("end"))
    sound = total.join(whole, "shard").where((F.col("n") == F.col("held")) & (F.col("n") == F.col("end"))).agg(F.count("*").cast("int").alias("files"))
    return index.groupBy("doc_id").agg(F.sum("lines").alias("lines")).crossJoin(F.broadcast(sound))


@query("chart_series", """
WITH s AS (SELECT l_suppkey, l_returnflag, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3)
SELECT c.l_suppkey AS chart, CASE c.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS series, c.l_returnflag AS name, i AS idx, 'L' || i AS cat, CAST(s.q AS DOUBLE) AS val
FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) c, (SELECT unnest(generate_series(0, 9)) AS i) LEFT JOIN s ON s.l_suppkey = c.l_suppkey AND s.l_returnflag = c.l_returnflag AND s.l_linenumber = i""")
def chart_series(spark, folder):
    """A chart part per supplier with ten positions a series, written as XML and read back; gaps become null."""
    sums = corpus.load(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    pts = sums.groupBy("l_suppkey", "l_returnflag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda p: F.concat(
        F.lit('<c:pt idx="'), p["l_linenumber"].cast("string"), F.lit('"><c:v>'), p["q"].cast("string"), F.lit("</c:v></c:pt>"))), "").alias("pts"))
    cats = F.lit("".join(f'<c:pt idx="{i}"><c:v>L{i}</c:v></c:pt>' for i in range(10)))
    flag = F.col("l_returnflag")
    number = F.when(flag == "A", "0").when(flag == "N", "1").otherwise("2")
    ser = F.concat(F.lit('<c:ser><c:idx val="'), number, F.lit('"/><c:tx><c:strRef><c:strCache><c:ptCount val="1"/><c:pt idx="0"><c:v>'), flag,
                   F.lit('</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache><c:ptCount val="10"/>'), cats,
                   F.lit('</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:ptCount val="10"/>'), "pts",
                   F.lit("</c:numCache></c:numRef></c:val></c:ser>"))
    lines = pts.select(F.col("l_suppkey").alias("doc_id"), number.cast("int").alias("pos"), ser.alias("line"))
    root = pts.select(F.col("l_suppkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("pos"), F.lit('<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart">').alias("line")),
        F.struct(F.lit(99).alias("pos"), F.lit("</c:chart>").alias("line")))).alias("r")).select("doc_id", "r.pos", "r.line")
    path = scratch_folder(spark, "charts")
    files.write_lines(lines.unionByName(root), path, ["pos"], whole=True)
    points = charts.read_series(spark, path)
    return points.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint").alias("chart"), "series", "name", "idx", "cat", "val")


@query("file_inventory", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ole' WHEN 2 THEN 'docx' WHEN 3 THEN 'unknown' WHEN 4 THEN 'image' WHEN 5 THEN 'text' ELSE 'unknown' END AS kind,
       doc_id % 7 IN (0, 2, 4, 5) AS convertible FROM documents""")
def file_inventory(spark, folder):
    """Documents wrapped in the signatures of several kinds of file."""
    k = F.col("doc_id") % 7
    raw = F.encode(F.col("text"), "UTF-8")

    def head(hexed):
        return F.concat(F.unhex(F.lit(hexed)), raw)

    content = (F.when(k == 0, head("255044462D312E37")).when(k == 1, head("D0CF11E0A1B11AE1")).when(k == 2, head("504B0304" + b"word/document.xml".hex()))
               .when(k == 3, head("504B0304")).otherwise(head("20")))
    ending = F.when(k == 4, ".JPG").when(k == 5, ".md").when(k == 6, ".bin").otherwise(".pdf")
    docs = corpus.documents(spark, folder).select("doc_id", F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), ending).alias("path"),
                                                  F.length("text").alias("length"), content.alias("content"))
    found = files.inventory(docs)
    return found.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint").alias("doc_id"), "kind", "convertible")


@query("decoded_texts", """
SELECT doc_id, md5(CASE doc_id % 4 WHEN 3 THEN CAST(doc_id AS VARCHAR) || '契約ｱ' ELSE text END) AS digest FROM documents""")
def decoded_texts(spark, folder):
    """Documents stored as UTF-8 with and without mark, and short Japanese texts in cp932."""
    k = F.col("doc_id") % 4
    plain = F.encode("text", "UTF-8")
    japanese = F.encode(F.concat(F.col("doc_id").cast("string"), F.lit("契約ｱ")), "windows-31j")
    content = F.when(k == 3, japanese).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).otherwise(plain)
    return corpus.documents(spark, folder).select("doc_id", F.md5(files.decode_text(content)).alias("digest"))


# ---------------------------------------------------------------- streams

_SESSIONS = corpus.EDIT + """,
gap AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < {gap} THEN 0 ELSE 1 END AS s FROM edit WINDOW w AS (PARTITION BY doc_id ORDER BY ts, seq)),
ses AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS k FROM gap)"""
SIX_HOURS = 6 * 3600 * 1000000


def _edit_stream(spark, folder):
    return _edits_of(E.read_events(spark, folder, "events", corpus.SCHEMAS["events"]))


def _edits_of(events):
    return events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), (F.col("event_id") % 20).cast("string").alias("annot_id"),
        F.concat(F.lit("a"), (F.floor(F.col("event_id") / 40) % 3).cast("string")).alias("after"))


@query("edit_sessions", sql(_SESSIONS.format(gap=SIX_HOURS), """
SELECT doc_id, count(*) AS edits, min(seq) AS first_seq, max(seq) AS last_seq FROM ses GROUP BY doc_id, k"""))
def edit_sessions(spark, folder):
    """Sessions with a pause of six hours, over the table; the streaming query below gives the closed ones."""
    return E.typing_sessions(corpus.edit_events(spark, folder), "6 hours").select("doc_id", "edits", "first_seq", "last_seq")


@query("edit_sessions_stream", sql(_SESSIONS.format(gap=SIX_HOURS), """
SELECT doc_id, count(*) AS edits, min(seq) AS first_seq, max(seq) AS last_seq FROM ses GROUP BY doc_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM edit) - INTERVAL 1 HOUR"""))
def edit_sessions_stream(spark, folder):
    """The sessions the stream has closed: those that end before its watermark, an hour behind the last edit."""
    closed = E.to_table(E.typing_sessions(_edit_stream(spark, folder), "6 hours", "1 hour"), name="sessions")
    return closed.select("doc_id", "edits", "first_seq", "last_seq")


_SAVES = corpus.EDIT + """,
gap AS (SELECT *, ts + CASE WHEN seq % 4 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 4 HOUR END AS till FROM edit),
run AS (SELECT *, max(till) OVER (PARTITION BY doc_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_till FROM gap),
ses AS (SELECT *, sum(CASE WHEN ts < before_till THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS k FROM run)"""


@query("save_points", sql(_SAVES, """
SELECT doc_id, strftime(max(till), '%Y-%m-%d %H:%M:%S') AS saved_at, max(seq) AS seq, max_by(after, seq) AS after, count(*) AS edits FROM ses GROUP BY doc_id, k"""))
def save_points(spark, folder):
    """Saves after four quiet hours, or eight where the editor was busy."""
    edits = corpus.edit_events(spark, folder).withColumn("busy", F.col("seq") % 4 == 0)
    return E.save_points(edits, "4 hours", "8 hours").withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


@query("save_points_stream", sql(_SAVES, """
SELECT doc_id, max(seq) AS seq, count(*) AS edits FROM ses GROUP BY doc_id, k HAVING max(till) <= (SELECT max(ts) FROM edit) - INTERVAL 1 HOUR"""))
def save_points_stream(spark, folder):
    edits = _edit_stream(spark, folder).withColumn("busy", F.col("seq") % 4 == 0)
    return E.to_table(E.save_points(edits, "4 hours", "8 hours", "1 hour"), name="saves").select("doc_id", "seq", "edits")


@query("ordered_requests_stream", "SELECT conv_id AS doc_id, turn AS seq, role AS op, CAST(turn AS VARCHAR) AS annot_id, md5(text) AS after FROM conversations")
def ordered_requests_stream(spark, folder):
    """Turns of a conversation as requests, handed on in order."""
    turns = E.read_events(spark, folder, "conversations", corpus.SCHEMAS["conversations"])
    requests = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("op"), F.col("turn").cast("string").alias("annot_id"),
                            F.md5("text").alias("after"))
    return E.to_table(E.apply_in_order(requests), name="ordered")


@query("latest_marks_stream", """
SELECT user_id AS doc_id, CAST(event_id % 20 AS VARCHAR) AS annot_id, 'a' || (event_id // 40 % 3) AS after, event_id AS seq FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def latest_marks_stream(spark, folder):
    """The marks the edit stream leaves behind."""
    return E.current_marks(E.to_table(E.latest_state(_edit_stream(spark, folder)), name="latest"))


_EXPIRED = _SESSIONS.format(gap=24 * 3600 * 1000000) + """
SELECT doc_id, arg_max(seq, (epoch_us(ts) // 1000, seq)) AS seq, max(epoch_us(ts) // 1000) AS saved_ms FROM ses GROUP BY doc_id, k
HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM edit) - INTERVAL {late}"""


@query("expired_drafts_stream", sql(_EXPIRED.replace("{late}", "1 HOUR"), ""))
def expired_drafts_stream(spark, folder):
    """Drafts of documents without a save for a day, as the stream's time passes their limit."""
    return E.to_table(E.expired_drafts(_edit_stream(spark, folder), days=1), name="expired")


@query("deduplicated_stream", "SELECT user_id AS doc_id, count(*) AS edits FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY 1")
def deduplicated_stream(spark, folder):
    """Every edit delivered twice; the second copy is dropped on the way."""
    twice = _edit_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = E.to_table(E.without_duplicates(twice, ["doc_id", "seq"]), name="once")
    return once.groupBy("doc_id").agg(F.count("*").alias("edits"))


# ---------------------------------------------------------------- the same streams over four deliveries

_LATE = "1 day"


def _replayed(spark, folder, run):
    """The edits in four deliveries by time: of the last twelve hours of each, one in eleven comes late, with the next, and one
    in thirteen comes again with it. The stream is started anew for each."""
    week, half_day = 7.5 * 86400, 43200
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    events = corpus.load(spark, folder, "events").withColumn("part", F.least(F.floor(at / week), F.lit(3)).cast("int"))
    near_end = (at - F.col("part") * week > week - half_day) & (F.col("part") < 3)
    key = F.col("event_id")
    parts = F.when(near_end & (key % 11 == 0), F.array(F.col("part") + 1)).when(
        near_end & (key % 13 == 0), F.array(F.col("part"), F.col("part") + 1)).otherwise(F.array("part"))
    return E.replay(events.withColumn("part", F.explode(parts)), "part", [0, 1, 2, 3], lambda stream: run(_edits_of(stream)))


@query("edit_sessions_deliveries", sql(_SESSIONS.format(gap=SIX_HOURS), """
SELECT doc_id, count(*) AS edits, min(seq) AS first_seq, max(seq) AS last_seq FROM ses GROUP BY doc_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM edit) - INTERVAL 1 DAY"""))
def edit_sessions_deliveries(spark, folder):
    """Repeated edits are dropped before sessions are counted, late ones join theirs."""
    out = scratch_folder(spark, "sessions")

    def run(edits):
        once = E.without_duplicates(edits, ["doc_id", "seq"], _LATE)
        return E.to_table(E.typing_sessions(once, "6 hours", None), out=out)

    return _replayed(spark, folder, run).select("doc_id", "edits", "first_seq", "last_seq")


@query("save_points_deliveries", sql(_SAVES, """
SELECT doc_id, max(seq) AS seq, max_by(after, seq) AS after FROM (SELECT * REPLACE ('a' || (seq // 40 % 3) AS after) FROM ses) GROUP BY doc_id, k
HAVING max(till) <= (SELECT max(ts) FROM edit) - INTERVAL 1 DAY"""))
def save_points_deliveries(spark, folder):
    out = scratch_folder(spark, "saves")
    run = lambda edits: E.to_table(E.save_points(edits.withColumn("busy", F.col("seq") % 4 == 0), "4 hours", "8 hours", _LATE), out=out)
    return _replayed(spark, folder, run).select("doc_id", "seq", "after")


@query("latest_marks_deliveries", """
SELECT user_id AS doc_id, CAST(event_id % 20 AS VARCHAR) AS annot_id, 'a' || (event_id // 40 % 3) AS after, event_id AS seq FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def latest_marks_deliveries(spark, folder):
    """The marks that are held after four triggers, each combined before it meets the state."""
    target = scratch_folder(spark, "marks")

    def run(edits):
        E.merge_latest(edits, target)
        return E.merged_marks(spark, target)

    return _replayed(spark, folder, run)


@query("expired_drafts_deliveries", sql(_EXPIRED.replace("{late}", "1 DAY"), ""))
def expired_drafts_deliveries(spark, folder):
    out = scratch_folder(spark, "expired")
    return _replayed(spark, folder, lambda edits: E.to_table(E.expired_drafts(edits, 1, _LATE), out=out))


@query("deduplicated_deliveries", "SELECT user_id AS doc_id, count(*) AS edits FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY 1")
def deduplicated_deliveries(spark, folder):
    out = scratch_folder(spark, "once")
    once = _replayed(spark, folder, lambda edits: E.to_table(E.without_duplicates(edits, ["doc_id", "seq"], _LATE), out=out))
    return once.groupBy("doc_id").agg(F.count("*").alias("edits"))

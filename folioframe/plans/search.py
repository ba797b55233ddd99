"""Registered queries of search and of running text."""

from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import search as S
from folioframe.operators import documents as D
from folioframe.operators.scale import by_key
from folioframe.plans import corpus
from folioframe.plans.registry import query, sql

NEEDLE = "of the"
LOOSE = "whe re"

_PAGE_TEXT = corpus.SPANS + """,
ptext AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS t,
                 string_agg(lower(regexp_replace(text, '\\s+', '', 'g')), '' ORDER BY line) AS flat FROM span GROUP BY 1, 2)"""
# A blank may be any run of blanks, and a hyphen at a line end is skipped together with the end.
_PATTERN = r"(?i)o(?:-\n)?f\s+t(?:-\n)?h(?:-\n)?e"
_HITS = _PAGE_TEXT + f""",
m0 AS (SELECT doc_id, page, regexp_extract_all(t, '{_PATTERN}') AS m, string_split_regex(t, '{_PATTERN}') AS g FROM ptext WHERE regexp_matches(t, '{_PATTERN}')),
m1 AS (SELECT doc_id, page, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS hit, unnest(m) AS text, unnest(g[1:len(m)]) AS gap FROM m0),
hits AS (SELECT doc_id, page, hit, text, CAST(sum(length(gap)) OVER w + coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
         FROM m1 WINDOW w AS (PARTITION BY doc_id, page ORDER BY hit))"""
_BOXES = _HITS + """,
ls AS (SELECT doc_id, page, line, text, size, x0, y0, y1, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line) - length(text) - 1 AS BIGINT) AS at FROM span),
parts AS (SELECT h.doc_id, h.page, h.hit, l.line, greatest(h.start - l.at, 0) AS a, least(h.start + length(h.text) - l.at, length(l.text)) AS b, l.text AS lt, l.size, l.x0 AS bx, l.y0, l.y1
          FROM hits h JOIN ls l ON l.doc_id = h.doc_id AND l.page = h.page AND h.start < l.at + length(l.text) AND h.start + length(h.text) > l.at),
exact AS (SELECT doc_id, page, false AS relaxed, hit, line AS part, bx + size * 0.5 * a AS x0, y0, bx + size * 0.5 * b AS x1, y1, a, b, lt FROM parts)"""


def _relaxed_sql(needle: str, source: str) -> str:
    target = "".join(needle.split())
    return f"""
flat0 AS (SELECT c.doc_id, c.page, c.line, lower(c.c) AS c, x0, y0, x1, y1, row_number() OVER (PARTITION BY c.doc_id, c.page ORDER BY c.line, c.seq) AS k
          FROM chars c JOIN {source} p ON p.doc_id = c.doc_id AND p.page = c.page WHERE regexp_replace(c.c, '\\s', '') <> ''),
flat1 AS (SELECT doc_id, page, string_agg(c, '' ORDER BY k) AS f FROM flat0 GROUP BY 1, 2),
spots AS (SELECT doc_id, page, k, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS hit FROM
       (SELECT doc_id, page, f, unnest(generate_series(1, length(f))) AS k FROM flat1 WHERE contains(f, '{target}')) WHERE substr(f, k, {len(target)}) = '{target}'),
loose0 AS (SELECT a.doc_id, a.page, CAST(hit AS INTEGER) AS hit, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
           FROM spots a JOIN flat0 f ON f.doc_id = a.doc_id AND f.page = a.page AND f.k >= a.k AND f.k < a.k + {len(target)} GROUP BY 1, 2, 3, 4),
loose AS (SELECT doc_id, page, hit, CAST(row_number() OVER (PARTITION BY doc_id, page, hit ORDER BY line) - 1 AS INTEGER) AS part, x0, y0, x1, y1 FROM loose0)"""


def _lines(spark, folder):
    """The visual lines, put by page once: whatever is made of them stays in the task of its page."""
    return by_key(corpus.spans(spark, folder), "doc_id", "page")


def _gated(spark, folder, needle):
    """Spans of the pages that can hold the phrase; characters are built for those only."""
    spans = _lines(spark, folder)
    return spans.join(S.gate(spans, needle), ["doc_id", "page"], "left_semi")


def _found(spark, folder):
    near = _gated(spark, folder, NEEDLE)
    return S.search(corpus.span_chars(near), near, NEEDLE)


@query("search_gate", sql(_PAGE_TEXT, """
SELECT doc_id, page FROM ptext WHERE contains(flat, 'ofthe') OR contains(replace(flat, '-', ''), 'ofthe')"""))
def search_gate(spark, folder):
    return S.gate(_lines(spark, folder), NEEDLE)


@query("search_exact", sql(_HITS, """SELECT doc_id, page, hit, start, start + length(text) AS "end", text FROM hits"""))
def search_exact(spark, folder):
    return S.exact_hits(_lines(spark, folder), NEEDLE)


@query("search_match_case", sql(_HITS.replace("(?i)", ""), """SELECT doc_id, page, hit, start, start + length(text) AS "end", text FROM hits"""))
def search_match_case(spark, folder):
    return S.exact_hits(_lines(spark, folder), NEEDLE, match_case=True)


@query("search_relaxed", sql(corpus.CHARS + ",\nallp AS (SELECT DISTINCT doc_id, page FROM span)," + _relaxed_sql(LOOSE, "allp"),
                             "SELECT * FROM loose"))
def search_relaxed(spark, folder):
    return S.relaxed_hits(corpus.span_chars(_gated(spark, folder, LOOSE)), LOOSE)


_ALL_HITS = _BOXES + """,
chars AS (SELECT doc_id, page, block, line, seq, substr(text, seq + 1, 1) AS c, bx + size * 0.5 * seq AS x0, y0, bx + size * 0.5 * (seq + 1) AS x1, y1
          FROM (SELECT doc_id, page, block, line, text, size, x0 AS bx, y0, y1, CAST(unnest(generate_series(0, length(text) - 1)) AS INTEGER) AS seq FROM span)),
rest AS (SELECT doc_id, page FROM ptext WHERE (contains(flat, 'ofthe') OR contains(replace(flat, '-', ''), 'ofthe')) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = ptext.doc_id AND h.page = ptext.page)),""" + _relaxed_sql(NEEDLE, "rest")


@query("search_hits", sql(_ALL_HITS, """
SELECT doc_id, page, relaxed, hit, part, x0, y0, x1, y1 FROM exact UNION ALL SELECT doc_id, page, true, hit, part, x0, y0, x1, y1 FROM loose"""))
def search_hits(spark, folder):
    return _found(spark, folder)


@query("search_contexts", sql(_ALL_HITS, r""",
every_hit AS (SELECT doc_id, page, relaxed, hit, part, a, b, lt FROM exact UNION ALL
         SELECT l.doc_id, l.page, true, l.hit, l.part, CAST(round((l.x0 - s.x0) / (s.size * 0.5)) AS BIGINT), CAST(round((l.x1 - s.x0) / (s.size * 0.5)) AS BIGINT), s.text
         FROM loose l JOIN span s ON s.doc_id = l.doc_id AND s.page = l.page AND s.y0 = l.y0)
SELECT doc_id, page, relaxed, hit, part, bb || w || aa AS context, length(bb) AS at, length(w) AS size FROM (
 SELECT doc_id, page, relaxed, hit, part, right(one_b, 24) AS bb, trim(regexp_replace(substr(lt, a + 1, b - a), '\s+', ' ', 'g')) AS w, rtrim(left(one_a, 70)) AS aa FROM (
  SELECT *, CASE WHEN fb = '' THEN '' ELSE CASE WHEN regexp_matches(rb, '^\s') THEN ' ' ELSE '' END || fb || CASE WHEN rb LIKE '% ' THEN ' ' ELSE '' END END AS one_b,
         CASE WHEN fa = '' THEN '' ELSE CASE WHEN regexp_matches(ra, '^\s') THEN ' ' ELSE '' END || fa || CASE WHEN ra LIKE '% ' THEN ' ' ELSE '' END END AS one_a FROM (
   SELECT *, substr(lt, 1, a) AS rb, substr(lt, b + 1) AS ra, trim(regexp_replace(substr(lt, 1, a), '\s+', ' ', 'g')) AS fb,
          trim(regexp_replace(substr(lt, b + 1), '\s+', ' ', 'g')) AS fa FROM every_hit)))""").replace("\n,\nevery_hit", ",\nevery_hit"))
def search_contexts(spark, folder):
    """Every hit, exact or relaxed, with the words round it."""
    near = _gated(spark, folder, NEEDLE)
    return S.hit_contexts(S.search(corpus.span_chars(near), near, NEEDLE), corpus.runs(near), NEEDLE, centres=corpus.centres())


@query("search_relaxed_contexts", sql(corpus.CHARS + ",\nallp AS (SELECT DISTINCT doc_id, page FROM span)," + _relaxed_sql(LOOSE, "allp"), r""",
cut AS (SELECT l.doc_id, l.page, hit, part, s.text AS lt, CAST(round((l.x0 - s.x0) / (s.size * 0.5)) AS BIGINT) AS a, CAST(round((l.x1 - s.x0) / (s.size * 0.5)) AS BIGINT) AS b
        FROM loose l JOIN span s ON s.doc_id = l.doc_id AND s.page = l.page AND s.y0 = l.y0)
SELECT doc_id, page, hit, part, length(bb) AS at, w FROM (SELECT *, trim(regexp_replace(substr(lt, a + 1, b - a), '\s+', ' ', 'g')) AS w, right(CASE WHEN fb = '' THEN '' ELSE
   CASE WHEN regexp_matches(rb, '^\s') THEN ' ' ELSE '' END || fb || CASE WHEN rb LIKE '% ' THEN ' ' ELSE '' END END, 24) AS bb
 FROM (SELECT *, substr(lt, 1, a) AS rb, trim(regexp_replace(substr(lt, 1, a), '\s+', ' ', 'g')) AS fb FROM cut))""").replace("\n,\ncut", ",\ncut"))
def search_relaxed_contexts(spark, folder):
    """Contexts of a phrase that only the relaxed search finds, blanks and line ends inside it."""
    near = _gated(spark, folder, LOOSE)
    found = S.hit_contexts(S.relaxed_hits(corpus.span_chars(near), LOOSE), corpus.runs(near), LOOSE, centres=corpus.centres())
    return found.select("doc_id", "page", "hit", "part", "at", F.substring("context", F.col("at") + 1, F.col("size")).alias("w"))


@query("search_replaced_lines", sql(_BOXES, """,
spot AS (SELECT doc_id, page, part AS line, a, b, lt, row_number() OVER (PARTITION BY doc_id, page, part ORDER BY a) AS k,
                coalesce(lag(b) OVER (PARTITION BY doc_id, page, part ORDER BY a), 0) AS p FROM exact)
SELECT doc_id, page, line, string_agg(substr(lt, p + 1, a - p) || 'for some', '' ORDER BY k) || substr(any_value(lt), max(b) + 1) AS text, count(*) AS edits
FROM spot GROUP BY 1, 2, 3""").replace("\n,\nspot", ",\nspot"))
def search_replaced_lines(spark, folder):
    """The lines as they read after replacing the phrase."""
    near = _gated(spark, folder, NEEDLE)
    return S.edited_lines(near, S.exact_hits(near, NEEDLE), "for some")


@query("search_highlights", sql(_ALL_HITS, """
SELECT doc_id, page, 'highlight' AS type, 'of the' AS subject, count(*) AS marks, min(x0) AS left_edge, max(y1) AS bottom
FROM (SELECT doc_id, page, x0, y1 FROM exact UNION ALL SELECT doc_id, page, x0, y1 FROM loose) GROUP BY 1, 2"""))
def search_highlights(spark, folder):
    marks = S.highlight_hits(_found(spark, folder), NEEDLE)
    return marks.groupBy("doc_id", "page", "type", "subject").agg(
        F.count("*").alias("marks"), F.min(F.col("quads")[0][0]).alias("left_edge"), F.max(F.col("rect")[3]).alias("bottom"))


@query("search_redaction_marks", sql(_ALL_HITS, """
SELECT doc_id, count(*) AS applied, count(DISTINCT page) AS pages FROM (SELECT doc_id, page FROM exact UNION ALL SELECT doc_id, page FROM loose) GROUP BY 1"""))
def search_redaction_marks(spark, folder):
    """Every hit, exact or else relaxed, as a redaction mark; what applying them would touch."""
    from folioframe.operators.privacy import redaction_report

    return redaction_report(S.highlight_hits(_found(spark, folder), "", "redact"))


@query("search_replace", sql(_BOXES, """
SELECT e.doc_id, e.page, hit, part, 'for some' AS text, (SELECT min_by(s.size, s.line) FROM span s WHERE s.doc_id = e.doc_id AND s.page = e.page
   AND s.x0 < e.x1 AND s.x1 > e.x0 AND s.y0 < e.y1 AND s.y1 > e.y0 AND trim(s.text) <> '') AS size FROM exact e"""))
def search_replace(spark, folder):
    near = _gated(spark, folder, NEEDLE)
    hits = S.exact_boxes(corpus.span_chars(near), near, S.exact_hits(near, NEEDLE))
    return S.replace_in_spans(hits, near, "for some").select("doc_id", "page", "hit", "part", "text", "size")


@query("text_in_boxes", sql(corpus.CHARS, """
SELECT doc_id, page, string_agg(c, '' ORDER BY line, seq) AS text FROM chars
WHERE (x0 + x1) / 2 >= 100 AND (x0 + x1) / 2 < 300 AND (y0 + y1) / 2 >= 220 AND (y0 + y1) / 2 < 270 GROUP BY 1, 2"""))
def text_in_boxes(spark, folder):
    boxes = corpus.page_table(spark, folder).select("doc_id", "page", F.lit(100.0).alias("x0"), F.lit(220.0).alias("y0"),
                                                    F.lit(300.0).alias("x1"), F.lit(270.0).alias("y1"))
    return S.text_in(corpus.runs(corpus.spans(spark, folder)), boxes, [], corpus.centres())


# ---------------------------------------------------------------- running text

@query("document_statistics", r"""
SELECT doc_id, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS characters, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (WHERE chars = 0) AS pages_without_text,
       CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT conv_id AS doc_id, turn AS page, length(regexp_replace(text, '\s+', '', 'g')) AS chars, strlen(text) AS bytes,
             len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS words FROM conversations
      UNION ALL SELECT doc_id + 1000000000, 0, length(regexp_replace(text, '\s+', '', 'g')), strlen(text),
             len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) FROM documents) GROUP BY 1""")
def document_statistics(spark, folder):
    """Characters, words and bytes: documents as one page each, conversations with a page per turn."""
    turns = corpus.load(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    docs = corpus.documents(spark, folder).select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit(0).cast("bigint").alias("page"), "text")
    return D.statistics(turns.unionByName(docs))


_JOINED = """
rows AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda r: trim(r)), lambda r: r <> '') AS r FROM conversations),
joined AS (SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN '' ELSE list_reduce(r, lambda a, b: CASE WHEN regexp_matches(a, '[a-z]-$') AND regexp_matches(b, '^[a-z]')
   THEN substr(a, 1, length(a) - 1) || b ELSE a || ' ' || b END) END AS text FROM rows)"""


@query("joined_lines", sql(_JOINED, "SELECT conv_id, turn, text FROM joined"))
def joined_lines(spark, folder):
    return corpus.load(spark, folder, "conversations").select("conv_id", "turn", T.join_lines(F.col("text")).alias("text"))


@query("citations", sql(_JOINED, """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '"' || text || '" (talk' || conv_id || ', p. ' || (turn + 1) || ')'
       ELSE '「' || text || '」（会話' || conv_id || '、' || (turn + 1) || 'ページ）' END AS citation FROM joined"""))
def citations(spark, folder):
    title = F.concat(F.when(F.col("turn") % 2 == 0, "talk").otherwise("会話"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    return corpus.load(spark, folder, "conversations").select(
        "conv_id", "turn", T.citation(F.col("text"), title, F.col("turn") + 1).alias("citation"))


@query("language_guess", """
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > length(text) * 0.5 THEN 'en-US' ELSE 'ja-JP' END AS language FROM documents""")
def language_guess(spark, folder):
    return corpus.documents(spark, folder).select("doc_id", T.guess_language(F.col("text")).alias("language"))


@query("page_text_export", sql(corpus.SPANS, """
SELECT doc_id, page, -2 AS line, '===== ' || (page + 1) || ' ページ =====' AS text FROM (SELECT DISTINCT doc_id, page FROM wrapped_page)
UNION ALL SELECT doc_id, page, line, text FROM span
UNION ALL SELECT doc_id, page, 1000000, '' FROM (SELECT DISTINCT doc_id, page FROM wrapped_page)""").replace(
    "\nSELECT doc_id, page, -2", ",\nwrapped_page AS (SELECT doc_id, CAST(n // 20 AS INTEGER) AS page FROM wrapped)\nSELECT doc_id, page, -2"))
def page_text_export(spark, folder):
    return D.text_export(corpus.page_table(spark, folder), corpus.spans(spark, folder))


@query("ocr_words", """
WITH w AS (SELECT conv_id AS doc_id, turn AS page, text, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq, unnest(string_split(text, ' ')) AS t FROM conversations)
SELECT doc_id, page, seq, 0 AS part, trim(t) AS text, seq * 10.0::DOUBLE AS x0, 100.0::DOUBLE AS y0 FROM w WHERE trim(t) <> '' AND (seq * 37 + page) % 100 >= 35 AND seq % 5 <> 0
UNION ALL SELECT doc_id, page, seq, unnest([0, 1]), unnest(['契', '約']), unnest([seq * 10.0::DOUBLE, seq * 10.0 + 4]), 100.0 FROM w WHERE (seq * 37 + page) % 100 >= 35 AND seq % 5 = 0""")
def ocr_words(spark, folder):
    """Words of the conversations as recognised words, every fifth one a CJK word with two symbols."""
    def box(x0, y0, x1, y1):
        return F.struct(x0.alias("x0"), F.lit(y0).alias("y0"), x1.alias("x1"), F.lit(y1).alias("y1"))

    seq = F.col("seq")
    words = corpus.load(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "t"))
    x, cjk = seq * 10.0, seq % 5 == 0
    symbols = F.array(F.struct(F.lit("契").alias("text"), box(x, 101.0, x + 4, 109.0).alias("bbox")),
                      F.struct(F.lit("約").alias("text"), box(x + 4, 102.0, x + 8, 108.0).alias("bbox")))
    recognised = words.select(
        "doc_id", "page", "seq", F.when(cjk, "契約").otherwise(F.col("t")).alias("text"),
        ((seq * 37 + F.col("page")) % 100).alias("confidence"), box(x, 101.0, x + 8, 109.0).alias("bbox"),
        box(F.lit(0.0), 100.0, F.lit(500.0), 112.0).alias("line"), F.when(cjk, symbols).alias("symbols"))
    return S.ocr_words(recognised).select("doc_id", "page", "seq", "part", "text", "x0", "y0")

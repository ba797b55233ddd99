"""Marks exchanged as XFDF: one file per document, page coordinates counted from the bottom left.

Files come from outside: an element that is no XML, or whose numbers are none, gives a row of ``rejects`` and no mark, and
the job goes on. Elements keep the order of the file, whatever their kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.labels import STATE_NAMES, TYPE_LABELS, body_text, lookup
from folioframe.functions.text import escape_markup, strip
from folioframe.sources.files import read_texts

TAGS = sorted(set(TYPE_LABELS) | {"text"}, key=lambda t: (-len(t), t))
_ATTRIBUTES = ["page", "rect", "color", "interior-color", "opacity", "width", "title", "subject", "creationdate", "state",
               "coords", "vertices", "inklist"]
_NODE = ", ".join(f"`_{a}` string" for a in _ATTRIBUTES) + ", contents string, _corrupt string"
# A start tag with its quoted values, and all up to the end tag of the same name; marked sections may hold anything.
_ELEMENT = (rf"<({'|'.join(TAGS)})(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>(?:[^<]++|<!\[CDATA\[(?s:.*?)\]\]>|<(?!/\1\s*>))*+</\1\s*>)")
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, tag, node attributes, contents, problem): the mark elements of all files in one scan, ``seq`` their place
    in the file; other elements are left out. A long file may be cut between elements into several parts."""
    text = F.regexp_replace("text", r"<!--(?s:.*?)-->", "")
    inner = F.regexp_replace(text, r"^(?s:.*?)<(?:\w+:)?annots(?=[\s>])", "<annots")
    nodes = read_texts(spark, path).select("path", F.posexplode(F.regexp_extract_all(inner, F.lit(_ELEMENT), F.lit(0))).alias("seq", "xml"))
    options = {"attributePrefix": "_", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false",
               "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    # Behind an explode an element is parsed once; otherwise a filter on what is in it would parse it a second time.
    parsed = nodes.select("*", F.explode(F.array(F.from_xml("xml", _NODE, options))).alias("n"))
    return parsed.select("path", F.regexp_extract("xml", r"^<(\w+)", 1).alias("tag"), "seq", *[F.col(f"n.`_{a}`").alias(a) for a in _ATTRIBUTES],
                         F.col("n.contents").alias("contents"), "xml", F.when(F.col("n._corrupt").isNotNull(), "xml").alias("problem")).withColumn(
        "problem", F.coalesce("problem", _problem()))


def _parts(text: Column, sep: str = ",") -> Column:
    return F.filter(F.split(text, sep), lambda v: F.trim(v) != "")


def _problem() -> Column:
    """The first attribute that does not hold the numbers it should, or null."""
    def broken(name: str, numbers: Column) -> Column:
        return F.when(F.col(name).isNotNull() & F.exists(numbers, lambda v: ~v.rlike(_NUMBER)), name)

    whole = F.when(F.col("page").isNotNull() & ~F.col("page").rlike(r"^\s*[0-9]{1,9}\s*$"), "page")
    four = F.when(F.col("rect").isNotNull() & (F.size(_parts(F.col("rect"))) < 4), "rect")
    one = [broken(c, F.array(c)) for c in ("opacity", "width")]
    points = F.flatten(F.transform(F.filter(F.split("vertices", ";"), lambda p: F.contains(p, F.lit(","))), lambda p: F.slice(F.split(p, ","), 1, 2)))
    inks = F.flatten(F.transform(F.split("inklist", ";"), lambda s: _parts(s)))
    return F.coalesce(whole, four, broken("rect", _parts(F.col("rect"))), *one, broken("coords", _parts(F.col("coords"))),
                      broken("vertices", points), broken("inklist", inks))


def rejects(nodes: DataFrame) -> DataFrame:
    """The elements that give no mark, with the attribute at fault (or xml) and the element as it stands."""
    return nodes.where(F.col("problem").isNotNull()).drop(*_ATTRIBUTES, "contents")


def _numbers(text: Column, sep: str = ",") -> Column:
    return F.transform(_parts(text, sep), lambda v: F.trim(v).try_cast("double"))


def to_marks(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements as marks of the model, but for ``rejects``. ``nodes`` needs doc_id; pages that do not exist drop their marks.

    Replies come back as notes of their own.
    """
    h = F.col("height")
    rect = _numbers(F.coalesce("rect", F.lit("0,0,0,0")))
    kind = F.when(F.col("tag") == "text", "note").otherwise(F.col("tag"))
    coords, blank = _numbers(F.col("coords")), F.lit("")

    def pairs(values, count):
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array(F.get(values, i * 2), h - F.get(values, i * 2 + 1)))

    quad_count = F.floor(F.size(coords) / 8).cast("int")
    quads = F.when(quad_count > 0, F.transform(F.sequence(F.lit(0), quad_count - 1), lambda q: F.transform(
        F.slice(coords, q * 8 + 1, F.lit(8)), lambda v, i: F.when(i % 2 == 0, v).otherwise(h - v))))
    points = F.when(F.col("vertices").isNotNull(), F.transform(
        F.filter(F.split("vertices", ";"), lambda p: F.contains(p, F.lit(","))),
        lambda p: F.array(F.get(F.split(p, ","), F.lit(0)).try_cast("double"), h - F.get(F.split(p, ","), F.lit(1)).try_cast("double"))))
    strokes = F.when(F.col("inklist").isNotNull(), F.filter(F.transform(F.split("inklist", ";"), lambda s: pairs(
        _numbers(s), F.greatest(F.floor(F.size(_numbers(s)) / 2).cast("int"), F.lit(1)))), lambda s: F.size(s) >= 2))
    state = lookup({v: k for k, v in STATE_NAMES.items()}, F.col("state"))
    said = strip(F.coalesce("contents", blank))
    sound = nodes.where(F.col("problem").isNull())
    placed = sound.withColumn("page", F.trim(F.coalesce("page", F.lit("0"))).try_cast("int")).join(
        pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    return placed.select(
        "doc_id", "page", "seq", kind.alias("type"),
        F.array(rect[0], h - rect[3], rect[2], h - rect[1]).alias("rect"), F.coalesce("title", blank).alias("author"),
        F.coalesce("subject", blank).alias("subject"), said.alias("contents"), F.when(kind == "freetext", said).alias("text"),
        state.alias("state"), F.struct(
            F.coalesce("color", F.lit("#e0403a")).alias("stroke"), F.col("interior-color").alias("fill"),
            F.coalesce(F.trim("opacity").try_cast("double"), F.lit(1.0)).alias("opacity"),
            F.coalesce(F.trim("width").try_cast("double"), F.lit(1.0)).alias("width")).alias("style"),
        quads.alias("quads"), points.alias("points"), strokes.alias("strokes"))


def _two(value: Column) -> Column:
    return F.format_string("%.2f", value)


def xfdf_lines(marks: DataFrame, replies: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """Marks as XFDF lines (doc_id, page, y, x, id, pos, line); sorted, the lines of a document are its file.

    Replies point to the id of their mark. ``names`` is (doc_id, name) for the file reference.
    """
    low, high, blank = F.lit(-1), F.lit(2147483647), F.lit("")
    h = F.coalesce("height", F.lit(842.0))
    r = F.col("rect")
    tag = F.when(F.col("type") == "areaHighlight", "square").when(F.col("type") == "note", "text").otherwise(F.col("type"))
    rect = F.concat_ws(",", _two(r[0]), _two(h - r[3]), _two(r[2]), _two(h - r[1]))

    def attribute(name, value, given=None):
        shown = value.isNotNull() & (value != "") if given is None else given
        return F.when(shown, F.concat(F.lit(f' {name}="'), F.replace(escape_markup(value), F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise(blank)

    def path(points):
        return F.transform(points, lambda p: F.concat(_two(p[0]), F.lit(","), _two(h - p[1])))

    coords = F.array_join(F.transform(F.flatten("quads"), lambda v, i: F.when(i % 2 == 0, _two(v)).otherwise(_two(h - v))), ",")
    inks = F.array_join(F.transform("strokes", lambda s: F.array_join(path(s["pts"]), ",")), ";")
    style = F.col("style")
    number = {k: F.coalesce(style[k], F.lit(1.0)).cast("string") for k in ("opacity", "width")}
    head = F.concat(
        F.lit("    <"), tag, attribute("page", F.col("page").cast("string")), attribute("rect", rect), attribute("color", style["stroke"]),
        attribute("interior-color", style["fill"]), attribute("opacity", number["opacity"]), attribute("width", number["width"]),
        attribute("title", F.col("author")), attribute("subject", F.col("subject")),
        attribute("creationdate", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss")),
        attribute("state", lookup(STATE_NAMES, F.col("state"))), attribute("statemodel", F.when(lookup(STATE_NAMES, F.col("state")).isNotNull(), "Review")),
        attribute("coords", coords), attribute("vertices", F.array_join(path(F.col("points")), ";")), attribute("inklist", inks), F.lit(">"))
    said = body_text(F.col("text"), F.col("contents"))
    body = F.when(said != "", F.concat(F.lit("<contents>"), escape_markup(said), F.lit("</contents>"))).otherwise(blank)
    placed = marks.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left")
    key = ["doc_id", "page", r[1].alias("y"), r[0].alias("x"), "id"]
    rows = placed.select(*key, F.lit(0).cast("bigint").alias("pos"), F.concat(head, body, F.lit("</"), tag, F.lit(">")).alias("line"))
    answer = F.concat(F.lit("    <text"), attribute("page", F.col("page").cast("string")), attribute("rect", rect), attribute("inreplyto", F.col("id")),
                      attribute("title", F.col("r_author")), F.lit("><contents>"), escape_markup(F.coalesce("r_contents", blank)), F.lit("</contents></text>"))
    said_back = placed.join(replies.select("doc_id", F.col("in_reply_to").alias("id"), F.col("seq").alias("r_seq"), F.col("author").alias("r_author"),
                                           F.col("contents").alias("r_contents")), ["doc_id", "id"])
    replied = said_back.select(*key, (F.col("r_seq") + 1).cast("bigint").alias("pos"), answer.alias("line"))
    zero = F.lit(0.0)
    top = names.select("doc_id", low.alias("page"), zero.alias("y"), zero.alias("x"), blank.alias("id"), F.posexplode(F.array(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/">'),
        F.concat(F.lit('  <f href="'), F.replace(escape_markup(F.col("name")), F.lit('"'), F.lit("&quot;")), F.lit('"/>')), F.lit("  <annots>"))).alias("pos", "line"))
    end = names.select("doc_id", high.alias("page"), zero.alias("y"), zero.alias("x"), blank.alias("id"), F.posexplode(F.array(
        F.lit("  </annots>"), F.lit("</xfdf>"))).alias("pos", "line"))
    return top.unionByName(rows).unionByName(replied).unionByName(end)

"""Full-text search over page tables: gate, exact and relaxed hits, boxes, context, marks, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import SPACE, find_all, offsets_of, quote, squeeze, without_space
from folioframe.operators.runs import runs_in_boxes, text_under
from folioframe.operators.scale import first_per_key


def page_texts(chars: DataFrame) -> DataFrame:
    """Per page the characters that are not blank, in reading order: text for the gate and positions for hits.

    Grouped line by line first, then page by page; a page is the largest unit ever put together.
    """
    lines = chars.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(
        F.struct("block", "seq", "c", "x0", "y0", "x1", "y1"))).alias("cs"))
    return lines.groupBy("doc_id", "page").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "cs"))), lambda r: r["cs"])).alias("cs"))


def folded_needle(needle: str) -> str:
    return "".join(needle.split()).lower()


def gate(lines: DataFrame, needle: str) -> DataFrame:
    """(doc_id, page) of the pages whose text can hold the phrase, blanks and line-end hyphens set aside.

    ``lines`` is (doc_id, page, line, text). Only the squeezed text of a page is put together.
    """
    target = folded_needle(needle)
    texts = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", F.lower(without_space(F.col("text"))).alias("t")))), lambda r: r["t"]),
        "").alias("flat"))
    plain = F.contains(F.replace("flat", F.lit("-")), F.lit(target.replace("-", "")))
    return texts.where(F.contains("flat", F.lit(target)) | plain).select("doc_id", "page")


def exact_hits(lines: DataFrame, needle: str, match_case: bool = False) -> DataFrame:
    """Exact hits per visual line or across line ends: (doc_id, page, hit, start, end).

    The definition: case is ignored unless ``match_case``, a run of blanks (a line end is one) equals one space, a hyphen at a line
    end is ignored together with the line end; hits do not overlap. ``start`` and ``end`` count characters of
    the page text in which lines are joined by one line feed.
    """
    texts = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("t"))
    words = needle.split()
    if not words:  # a blank phrase is found nowhere
        texts, words = texts.where(F.lit(False)), ["-"]
    glue = rf"(?:{SPACE}+)"
    soft = r"(?:-\n)?"
    pattern = ("" if match_case else "(?iu)") + glue.join(soft.join(quote(c) for c in w) for w in words)
    hits = texts.where(F.col("t").rlike(pattern)).select("doc_id", "page", F.posexplode(find_all(F.col("t"), pattern)).alias("hit", "h"))
    return hits.select("doc_id", "page", "hit", "h.start", "h.end", F.col("h.value").alias("text"))


def relaxed_hits(chars: DataFrame, needle: str) -> DataFrame:
    """Hits that ignore all blanks and line ends, overlapping ones too, one box for each line a hit touches.

    Gate first: only pages whose text holds the phrase get their characters put together.
    """
    target = folded_needle(needle)
    solid = chars.where(without_space(F.col("c")) != "")
    pages = page_texts(solid)
    # A letter whose lower case is longer stays as it is, or positions would drift.
    low = F.transform("cs", lambda r: F.when(F.length(F.lower(r["c"])) == 1, F.lower(r["c"])).otherwise(r["c"]))
    found = (pages.withColumn("flat", F.array_join(low, "")).where(F.contains("flat", F.lit(target)))
             .select("doc_id", "page", "cs", F.posexplode(offsets_of(F.col("flat"), target)).alias("hit", "at")))
    matched = found.select("doc_id", "page", "hit", F.slice("cs", F.col("at") + 1, F.lit(len(target))).alias("m"))
    # A jump in height of more than 0.6 of the last character starts a new box.
    box = "struct<x0:double,y0:double,x1:double,y1:double,ly:double,lh:double>"

    def add(boxes, r):
        last = F.element_at(boxes, -1)
        own = F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"),
                       r["y0"].alias("ly"), (r["y1"] - r["y0"]).alias("lh"))
        grown = F.struct(F.least(last["x0"], r["x0"]).alias("x0"), F.least(last["y0"], r["y0"]).alias("y0"),
                         F.greatest(last["x1"], r["x1"]).alias("x1"), F.greatest(last["y1"], r["y1"]).alias("y1"),
                         r["y0"].alias("ly"), (r["y1"] - r["y0"]).alias("lh"))
        jump = (F.size(boxes) == 0) | (F.abs(r["y0"] - F.try_element_at(boxes, F.lit(-1))["ly"])
                                       > F.try_element_at(boxes, F.lit(-1))["lh"] * 0.6)
        return F.when(jump, F.array_append(boxes, own)).otherwise(
            F.array_append(F.slice(boxes, F.lit(1), F.greatest(F.size(boxes) - 1, F.lit(0))), grown))

    boxes = F.aggregate("m", F.array().cast(f"array<{box}>"), add)
    return matched.select("doc_id", "page", "hit", F.posexplode(boxes).alias("part", "b")).select(
        "doc_id", "page", "hit", "part", "b.x0", "b.y0", "b.x1", "b.y1")


def line_parts(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """The part of each exact hit in each line it touches: (doc_id, page, hit, line, a, b), places in the line's text."""
    # Where each line starts in the page text, from the lengths of the lines before it (a page at most).
    ordered = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(
        F.struct("line", F.length("text").alias("n")))).alias("ls"))
    starts = ordered.select("doc_id", "page", F.explode(F.aggregate(
        "ls", F.array().cast("array<struct<line:int,at:int,next:int>>"),
        lambda acc, r: F.array_append(acc, F.struct(
            r["line"].alias("line"), F.coalesce(F.try_element_at(acc, F.lit(-1))["next"], F.lit(0)).alias("at"),
            (F.coalesce(F.try_element_at(acc, F.lit(-1))["next"], F.lit(0)) + r["n"] + 1).alias("next"))))).alias("s"))
    return (hits.alias("h").join(starts.alias("l"), ["doc_id", "page"])
            .where((F.col("h.start") < F.col("l.s.next") - 1) & (F.col("h.end") > F.col("l.s.at")))
            .select("doc_id", "page", "hit", F.col("l.s.line").alias("line"),
                    F.greatest(F.col("h.start") - F.col("l.s.at"), F.lit(0)).alias("a"),
                    F.least(F.col("h.end") - F.col("l.s.at"), F.col("l.s.next") - 1 - F.col("l.s.at")).alias("b")))


def edited_lines(lines: DataFrame, hits: DataFrame, replacement: str) -> DataFrame:
    """The lines that exact hits touch, as they read afterwards: (doc_id, page, line, text, edits).

    Each part of a hit in a line is replaced, so one across two lines sets the replacement in both. All replacements of a
    line are spliced in at once, from their places in the old text.
    """
    parts = line_parts(lines, hits).groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ps"))

    def piece(p, i):
        last = F.coalesce(F.get("ps", i - 1)["b"], F.lit(0))
        return F.concat(F.substring("text", last + 1, p["a"] - last), F.lit(replacement))

    rest = F.substring("text", F.element_at("ps", -1)["b"] + 1, F.length("text"))
    joined = parts.join(lines.select("doc_id", "page", "line", "text"), ["doc_id", "page", "line"])
    return joined.select("doc_id", "page", "line", F.concat(F.array_join(F.transform("ps", piece), ""), rest).alias("text"), F.size("ps").alias("edits"))


def exact_boxes(chars: DataFrame, lines: DataFrame, hits: DataFrame) -> DataFrame:
    """Boxes of exact hits, one for each line that a hit touches: (doc_id, page, hit, part, x0, y0, x1, y1)."""
    parts = line_parts(lines, hits)
    # By page, not by line, so that characters put by page are not moved; the line is then a range of one.
    held = F.col("c.line").between(F.col("p.line"), F.col("p.line")) & (F.col("c.seq") >= F.col("p.a")) & (F.col("c.seq") < F.col("p.b"))
    return (parts.alias("p").join(chars.alias("c"), ["doc_id", "page"]).where(held)
            .groupBy("doc_id", "page", "hit", F.col("p.line").alias("part"))
            .agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))


def search(chars: DataFrame, lines: DataFrame, needle: str) -> DataFrame:
    """Boxes of all hits: exact ones, and relaxed ones on pages without an exact hit.

    (doc_id, page, relaxed, hit, part, x0, y0, x1, y1). Both inputs should be cut to the pages of ``gate``
    first, so that characters of pages without the phrase are never read or built.
    """
    hits = exact_hits(lines, needle)
    rest = lines.select("doc_id", "page").distinct().join(hits.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    loose = relaxed_hits(chars.join(rest, ["doc_id", "page"], "left_semi"), needle)
    order = ["doc_id", "page", "relaxed", "hit", "part", "x0", "y0", "x1", "y1"]
    return (exact_boxes(chars, lines, hits).withColumn("relaxed", F.lit(False)).select(*order)
            .unionByName(loose.withColumn("relaxed", F.lit(True)).select(*order)))


def text_in(runs: DataFrame, boxes: DataFrame, ids: list[str], centres: Column | None = None) -> DataFrame:
    """The characters whose centre lies in a box (half open), joined in reading order: (doc_id, page, ids, text)."""
    rects = boxes.select("doc_id", "page", *ids, F.col("x0").alias("bx0"), F.col("y0").alias("by0"),
                         F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    return text_under(runs, rects, centres).groupBy("doc_id", "page", *ids).agg(_joined("t").alias("text"))


def _joined(piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "seq", piece))), lambda r: r[piece]), "")


def hit_contexts(hits: DataFrame, runs: DataFrame, needle: str, before: int = 24, after: int = 70,
                 limit: int | None = None, centres: Column | None = None) -> DataFrame:
    """The words round each hit, exact or relaxed, from the same line band: context, offset and length of the hit in it.

    The band is the middle of the box, so neighbouring lines do not leak in. Every hit gets a context; with
    ``limit`` only the first ones of each document, as in a result list on screen.
    """
    listed = first_per_key(hits, ["doc_id"], [F.col("page"), F.col("hit"), F.col("part")], limit, "rank") if limit else hits
    inset = (F.col("y1") - F.col("y0")) * 0.3
    ids = [c for c in ("relaxed", "hit", "part") if c in hits.columns]
    bands = listed.select("doc_id", "page", *ids, F.col("x0").alias("bx0"), (F.col("y0") + inset).alias("by0"),
                          F.col("x1").alias("bx1"), (F.col("y1") - inset).alias("by1"))
    met = runs_in_boxes(runs, bands, centres)
    sides = {"_b": F.left("text", F.col("a")), "_w": F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")),
             "_a": F.substring("text", F.col("b") + 1, F.length("text"))}
    cut = met.withColumns(sides).groupBy("doc_id", "page", *ids).agg(*[_joined(f"_{k}").alias(k) for k in "bwa"])

    def one_line(text):
        flat = squeeze(text)
        lead = F.when(text.rlike(f"^{SPACE}") & (flat != ""), " ").otherwise("")
        trail = F.when(text.endswith(" ") & (flat != ""), " ").otherwise("")
        return F.concat(lead, flat, trail)

    left = F.right(one_line(F.col("b")), F.lit(before))
    word = F.when(squeeze(F.col("w")) == "", needle).otherwise(squeeze(F.col("w")))
    right = F.rtrim(F.left(one_line(F.col("a")), F.lit(after)))
    return cut.select("doc_id", "page", *ids, F.concat(left, word, right).alias("context"),
                      F.length(left).alias("at"), F.length(word).alias("size"))


def highlight_hits(hits: DataFrame, subject: str, kind: str = "highlight", author: str = "") -> DataFrame:
    """Hits as marks, the phrase as their subject."""
    quad = F.array("x0", "y0", "x1", "y0", "x0", "y1", "x1", "y1")
    return hits.select("doc_id", "page", F.lit(kind).alias("type"), F.array(quad).alias("quads"),
                       F.array("x0", "y0", "x1", "y1").alias("rect"), F.lit(author).alias("author"),
                       F.lit(subject).alias("subject"))


def replace_in_spans(hits: DataFrame, spans: DataFrame, replacement: str) -> DataFrame:
    """For each hit box the text to set and the style of the first span (reading order) it meets."""
    boxes = hits.select("doc_id", "page", "hit", "part", F.col("x0").alias("hx0"), F.col("y0").alias("hy0"),
                        F.col("x1").alias("hx1"), F.col("y1").alias("hy1"))
    styled = spans.where(F.trim("text") != "")
    meets = (F.col("x0") < F.col("hx1")) & (F.col("x1") > F.col("hx0")) & (F.col("y0") < F.col("hy1")) & (F.col("y1") > F.col("hy0"))
    # Bands of 50 points keep the comparison local; a pair that shares two bands folds in the aggregate.
    h = boxes.withColumn("_band", F.explode(F.sequence(F.floor(F.col("hy0") / 50), F.floor(F.col("hy1") / 50))))
    s = styled.withColumn("_band", F.explode(F.sequence(F.floor(F.col("y0") / 50), F.floor(F.col("y1") / 50))))
    first = (h.join(s, ["doc_id", "page", "_band"]).where(meets).groupBy("doc_id", "page", "hit", "part").agg(
        F.min_by(F.struct("size", "font"), F.struct("block", "line", "span")).alias("style")))
    return boxes.join(first, ["doc_id", "page", "hit", "part"], "left").select(
        "doc_id", "page", "hit", "part", F.lit(replacement).alias("text"), F.coalesce("style.size", F.lit(11.0)).alias("size"),
        F.coalesce("style.font", F.lit("")).alias("font"))


def ocr_words(words: DataFrame, least_confidence: float = 35) -> DataFrame:
    """Recognised words worth keeping; words with CJK letters come symbol by symbol, at the height of their line."""
    kept = words.where((F.trim("text") != "") & (F.col("confidence") >= least_confidence))
    line_y0, line_y1 = F.coalesce("line.y0", "bbox.y0"), F.coalesce("line.y1", "bbox.y1")
    split = F.col("text").rlike(r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]") & (F.size("symbols") > 0)
    whole = F.array(F.struct(F.col("text"), F.col("bbox")))
    return kept.select("doc_id", "page", "seq", line_y0.alias("y0"), line_y1.alias("y1"),
                       F.posexplode(F.when(split, F.col("symbols")).otherwise(whole)).alias("part", "s")).where(
        F.trim("s.text") != "").select("doc_id", "page", "seq", "part", F.trim("s.text").alias("text"),
                                       F.col("s.bbox.x0").alias("x0"), "y0", F.col("s.bbox.x1").alias("x1"), "y1")

"""Page algebra: page tables in, page tables out. Order within a document is the column ``page``.

Everything that counts along a document goes through chunked running sums, so one very long document is
spread over tasks like everything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import rect_to_page, view_height, view_width
from folioframe.operators.scale import previous, running, running_through
from folioframe.session import cut_lineage

# ---------------------------------------------------------------- page ranges

_RANGE_FROM = "、，ー－〜~～０１２３４５６７８９"
_RANGE_TO = ",,-----0123456789"


def parse_ranges(specs: DataFrame) -> DataFrame:
    """(doc_id, spec, pages) to (doc_id, pos, grp, page, error): groups in order, repeats kept.

    A spec that cannot be read, reaches past the document or is empty gives one row with the error and no page.
    """
    parts = F.filter(F.transform(F.split(F.translate("spec", _RANGE_FROM, _RANGE_TO), ","), lambda p: F.trim(p)), lambda p: p != "")
    count = F.col("pages")

    def bound(text, default):
        return F.when(text == "", default).otherwise(F.regexp_extract(text, r"^\+?(\d{1,9})$", 1).try_cast("int"))

    def reading(part):
        dashed = F.contains(part, F.lit("-"))
        first = F.trim(F.substring_index(part, "-", 1))
        last = F.when(dashed, F.trim(F.substring(part, F.instr(part, "-") + 1, F.length(part)))).otherwise(part)
        a = bound(F.when(dashed, first).otherwise(part), F.lit(1))
        b = bound(last, count.cast("int"))
        bad = (F.when(a.isNull() | b.isNull(), F.concat(F.lit("unreadable: "), part))
               .when((a < 1) | (b > count) | (a > b), F.concat(F.lit("out of range: "), part)))
        return F.struct(a.alias("a"), b.alias("b"), bad.alias("error"))

    read = specs.select("doc_id", F.transform(parts, reading).alias("r"))
    error = F.when(F.size("r") == 0, F.lit("empty")).otherwise(
        F.get(F.filter(F.transform("r", lambda g: g["error"]), lambda e: e.isNotNull()), F.lit(0)))
    groups = F.transform("r", lambda g, i: F.transform(
        F.sequence(g["a"] - 1, g["b"] - 1), lambda p: F.struct(i.alias("grp"), p.alias("page"))))
    rows = read.select("doc_id", "r", error.alias("error")).select(
        "doc_id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.flatten(groups))).alias("pos", "p"))
    return rows.select("doc_id", "pos", "p.grp", "p.page", "error")


def parse_ranges_set(specs: DataFrame) -> DataFrame:
    """The range box of the screen: sorted, each page once, blanks also separate, empty means all pages."""
    parts = F.filter(F.split(F.trim("spec"), r"[,、，\s\x{3000}]+"), lambda p: p != "")
    count = F.col("pages").cast("int")
    dash = r"^(\d*)\s*[-–〜~ー]\s*(\d*)$"

    def reading(part):
        ranged = part.rlike(dash)
        a = F.when(ranged, F.regexp_extract(part, dash, 1)).otherwise(part)
        b = F.when(ranged, F.regexp_extract(part, dash, 2)).otherwise(part)
        a = F.when(ranged & (a == ""), 1).otherwise(a.try_cast("int"))
        b = F.when(ranged & (b == ""), count).otherwise(b.try_cast("int"))
        bad = (F.when(~part.rlike(r"^\d+$") & ~ranged, F.concat(F.lit("unreadable: "), part))
               .when(a.isNull() | b.isNull() | (a < 1) | (b < 1) | (a > count) | (b > count) | (a > b),
                     F.concat(F.lit("out of range: "), part)))
        return F.struct(a.alias("a"), b.alias("b"), bad.alias("error"))

    everything = F.array(F.struct(F.lit(1).alias("a"), count.alias("b"), F.lit(None).cast("string").alias("error")))
    read = specs.select("doc_id", F.when(F.trim("spec") == "", everything).otherwise(F.transform(parts, reading)).alias("r"))
    error = F.get(F.filter(F.transform("r", lambda g: g["error"]), lambda e: e.isNotNull()), F.lit(0))
    rows = read.select("doc_id", "r", error.alias("error")).select(
        "doc_id", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("r"))).alias("g"))
    pages = F.when(F.col("error").isNull(), F.sequence(F.col("g.a") - 1, F.col("g.b") - 1))
    return rows.select("doc_id", F.explode_outer(pages).alias("page"), "error").distinct()


def target_pages(pages: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The chosen pages that exist, each once; all pages where nothing is chosen."""
    return pages if chosen is None else pages.join(chosen.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def range_texts(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of consecutive pages as (keys, run, text), "1-3" or "5", counted from one."""
    seen = previous(pages.select(*keys, "page").distinct(), list(keys), "page", ["page"])
    starts = F.when(F.col("prev_page") == F.col("page") - 1, 0).otherwise(1)
    runs = running(seen, list(keys), "page", {"run": ("sum", starts)}).groupBy(*keys, "run").agg(
        F.min("page").alias("a"), F.max("page").alias("b"))
    a, b = (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")
    return runs.select(*keys, "run", F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b)).alias("text"))


# ---------------------------------------------------------------- set operations and order

def renumber(pages: DataFrame, order: str = "page", out: str = "new_page") -> DataFrame:
    """Number the rows of each document from zero in the given order."""
    return running(pages, ["doc_id"], order, {out: ("sum", F.lit(1))}).withColumn(out, (F.col(out) - 1).cast("int"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"))


def extract(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return renumber(target_pages(pages, chosen))


def extract_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages in the order of parsed ranges, repeats kept."""
    return ranges.where(F.col("error").isNull()).join(pages, ["doc_id", "page"]).withColumnRenamed("pos", "new_page")


def delete(pages: DataFrame, doomed: DataFrame) -> DataFrame:
    """Take pages out. A document of which nothing would remain is left as it is, marked ``refused``."""
    gone = doomed.select("doc_id", "page").distinct().withColumn("_gone", F.lit(1))
    marked = pages.join(gone, ["doc_id", "page"], "left")
    left = marked.groupBy("doc_id").agg((F.count("*") == F.count("_gone")).alias("refused"))
    kept = marked.join(left, "doc_id").where(F.col("refused") | F.col("_gone").isNull()).drop("_gone")
    return renumber(kept)


def duplicate(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each chosen page once more, right after itself."""
    twice = chosen.select("doc_id", "page").distinct().withColumn("_n", F.lit(2))
    copies = running(pages.join(twice, ["doc_id", "page"], "left").withColumn("_n", F.coalesce("_n", F.lit(1))),
                     ["doc_id"], "page", {"_end": ("sum", F.col("_n"))})
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(
        "new_page", (F.col("_end") - F.col("_n") + F.col("copy")).cast("int")).drop("_n", "_end")


def insert_pages(pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Put one new page (doc_id, at, width, height) into each document; ``at`` is clamped to it."""
    counts = page_counts(pages)
    placed = fresh.join(counts, "doc_id").withColumn("at", F.greatest(F.lit(0), F.least("at", "pages")).cast("int"))
    moved = pages.join(placed.select("doc_id", "at"), "doc_id", "left").select(
        "doc_id", (F.col("page") + F.when(F.col("page") >= F.col("at"), 1).otherwise(0)).alias("new_page"),
        "width", "height", F.lit(False).alias("inserted"))
    return moved.unionByName(placed.select("doc_id", F.col("at").alias("new_page"), "width", "height",
                                           F.lit(True).alias("inserted")))


def reorder(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Apply (doc_id, page, new_page); documents whose order is no permutation come out with ``ok`` false."""
    plan = order.groupBy("doc_id", "page").agg(F.count("*").alias("_n"), F.min("new_page").alias("new_page"))
    slots = order.groupBy("doc_id").agg(F.countDistinct("new_page").alias("_slots"), F.count("*").alias("_rows"),
                                        F.min("new_page").alias("_lo"), F.max("new_page").alias("_hi"))
    both = pages.withColumn("_here", F.lit(1)).join(plan, ["doc_id", "page"], "full")
    sound = both.groupBy("doc_id").agg(
        F.every((F.col("_here").isNotNull()) & (F.coalesce("_n", F.lit(0)) == 1)).alias("_whole")).join(slots, "doc_id", "left")
    ok = F.coalesce(F.col("_whole") & (F.col("_slots") == F.col("_rows")) & (F.col("_lo") == 0)
                    & (F.col("_hi") == F.col("_rows") - 1), F.lit(False))
    judged = both.where(F.col("_here") == 1).join(sound.select("doc_id", ok.alias("ok")), "doc_id")
    return judged.withColumn("new_page", F.when(F.col("ok"), F.col("new_page")).otherwise(F.col("page"))).drop("_here", "_n")


def move_before(pages: DataFrame, moving: DataFrame, at: DataFrame) -> DataFrame:
    """Move the pages of ``moving`` so that they sit before page ``at`` (doc_id, at) of the current order."""
    flagged = pages.join(moving.select("doc_id", "page").distinct().withColumn("_m", F.lit(1)),
                         ["doc_id", "page"], "left").withColumn("_m", F.coalesce("_m", F.lit(0))).join(at, "doc_id")
    ran = running(flagged, ["doc_id"], "page", {"_upto": ("sum", F.col("_m"))})
    tally = flagged.groupBy("doc_id").agg(F.sum("_m").alias("_all"), F.sum(F.when(
        (F.col("_m") == 0) & (F.col("page") < F.col("at")), 1).otherwise(0)).alias("_before"))
    p, m, before = F.col("page"), F.col("_m"), F.col("_upto") - F.col("_m")
    spot = F.when(m == 1, F.col("_before") + before).when(p < F.col("at"), p - before).otherwise(p - before + F.col("_all"))
    return ran.join(tally, "doc_id").withColumn("new_page", spot.cast("int")).drop("_m", "_upto", "_all", "_before", "at")


def rotate(pages: DataFrame, chosen: DataFrame | None, degrees: int) -> DataFrame:
    if chosen is None:
        return pages.withColumn("rotation", F.pmod(F.col("rotation") + degrees, F.lit(360)))
    turn = chosen.select("doc_id", "page").distinct().withColumn("_t", F.lit(degrees))
    return pages.join(turn, ["doc_id", "page"], "left").withColumn(
        "rotation", F.pmod(F.col("rotation") + F.coalesce("_t", F.lit(0)), F.lit(360))).drop("_t")


def merge(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Join documents: ``sources`` is (target, ord, doc_id); adds new_page in the joined document."""
    counts = page_counts(pages)
    sized = sources.join(counts, "doc_id")
    placed = running(sized, ["target"], "ord", {"_end": ("sum", F.col("pages"))}).withColumn(
        "start", F.col("_end") - F.col("pages")).drop("_end", "pages")
    return placed.join(pages, "doc_id").withColumn("new_page", F.col("start") + F.col("page"))


def merge_bookmarks(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """One bookmark per source that brings pages: (target, level, title, page from one)."""
    sized = sources.join(page_counts(pages), "doc_id")
    placed = running(sized, ["target"], "ord", {"_end": ("sum", F.col("pages"))})
    return placed.select("target", F.lit(1).alias("level"), F.regexp_replace("name", r"(?i)\.pdf$", "").alias("title"),
                         (F.col("_end") - F.col("pages") + 1).alias("page"))


def insert_document(base: DataFrame, incoming: DataFrame, at: DataFrame) -> DataFrame:
    """Insert the pages of ``incoming`` (same doc_id) at page ``at``; null means the end."""
    added = page_counts(incoming).withColumnRenamed("pages", "_added")
    size = page_counts(base).withColumnRenamed("pages", "_size")
    spot = size.join(at, "doc_id", "left").withColumn("_at", F.coalesce("at", "_size")).drop("at").join(added, "doc_id", "left")
    here = base.join(spot, "doc_id").select("doc_id", "page", F.lit("base").alias("origin"), (F.col("page") + F.when(
        F.col("page") >= F.col("_at"), F.coalesce("_added", F.lit(0))).otherwise(0)).alias("new_page"))
    there = incoming.join(spot, "doc_id").select("doc_id", "page", F.lit("incoming").alias("origin"),
                                                 (F.col("_at") + F.col("page")).alias("new_page"))
    return here.unionByName(there)


def replace_pages(pages: DataFrame, targets: DataFrame, source: DataFrame, first: int = 0) -> DataFrame:
    """Swap the sorted targets for pages first, first + 1 … of the source; short sources are marked in ``error``."""
    chosen = target_pages(pages.select("doc_id", "page"), targets)
    ranked = running(chosen, ["doc_id"], "page", {"_k": ("sum", F.lit(1))}).withColumn("source_page", F.col("_k") - 1 + first)
    need = ranked.groupBy("doc_id").agg(F.max("_k").alias("_need"))
    have = page_counts(source).withColumnRenamed("pages", "_have")
    fit = pages.select("doc_id").distinct().join(need, "doc_id", "left").join(have, "doc_id", "left").select(
        "doc_id", F.when(F.col("_need").isNull(), "no pages to replace").when(
            F.coalesce("_have", F.lit(0)) < F.col("_need") + first, "source too short").alias("error"))
    done = pages.join(ranked.drop("_k"), ["doc_id", "page"], "left").join(fit, "doc_id")
    return done.withColumn("source_page", F.when(F.col("error").isNull(), F.col("source_page")))


def organize(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Build documents from a plan (out_id, pos, doc_id, page, rotate, blank, w, h)."""
    p = plan.alias("p").join(pages.alias("s"), (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.page") == F.col("s.page"))
                             & ~F.col("p.blank"), "left")
    blank = F.col("p.blank")
    return p.select(
        "p.out_id", F.col("p.pos").alias("new_page"), "p.doc_id", "p.page", "p.blank",
        F.when(blank, F.coalesce("p.w", F.lit(595.0))).otherwise(F.col("s.width")).alias("width"),
        F.when(blank, F.coalesce("p.h", F.lit(842.0))).otherwise(F.col("s.height")).alias("height"),
        F.pmod(F.coalesce("s.rotation", F.lit(0)) + F.col("p.rotate"), F.lit(360)).alias("rotation"),
        (~blank & F.col("s.width").isNull()).alias("missing"))


# ---------------------------------------------------------------- numbers and plans

def _padded(number: Column, digits: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def bates(pages: DataFrame, prefix: str = "", start: int = 1, digits: int = 6, suffix: str = "",
          production: bool = False) -> DataFrame:
    """Running page labels, per document or through a whole production set in order of doc_id."""
    numbered = pages.withColumn("_n", F.col("page").cast("bigint"))
    if production:
        ends = running_through(page_counts(pages), "doc_id", F.col("pages"), "_end")
        offset = ends.select("doc_id", (F.col("_end") - F.col("pages")).alias("_off"))
        numbered = pages.join(offset, "doc_id").withColumn("_n", F.col("page") + F.col("_off")).drop("_off")
    return numbered.withColumn("label", F.concat(F.lit(prefix), _padded(F.col("_n") + start, digits), F.lit(suffix))).drop("_n")


def page_labels(pages: DataFrame, text: str, start: int = 1, skip: int = 0, align: str = "center") -> DataFrame:
    """Header or footer text with {page} and {pages}; the first ``skip`` pages get none."""
    number = F.col("page") - skip + start
    last = (F.col("pages") - skip + start - 1).cast("string")
    side = F.when(number % 2 != 0, "right").otherwise("left") if align == "outside" else F.lit(align)
    label = F.replace(F.replace(F.lit(text), F.lit("{page}"), number.cast("string")), F.lit("{pages}"), last)
    return pages.where(F.col("page") >= skip).join(page_counts(pages), "doc_id").select(
        "doc_id", "page", label.alias("label"), side.alias("side"))


def booklet(pages: DataFrame) -> DataFrame:
    """Where each page goes in a folded booklet: (doc_id, side, slot, page), -1 for blanks; two slots a side."""
    counts = page_counts(pages).withColumn("total", F.ceil(F.col("pages") / 4) * 4)
    real = pages.select("doc_id", "page").join(counts, "doc_id")
    blank = counts.where(F.col("total") > F.col("pages")).withColumn(
        "page", F.explode(F.sequence(F.col("pages"), F.col("total") - 1)))
    every = real.unionByName(blank.select(*real.columns))
    p = F.col("page")
    q = F.when(p < F.col("total") / 2, p).otherwise(F.col("total") - 1 - p)
    outer_half = p >= F.col("total") / 2
    slot = F.when(outer_half, q % 2).otherwise(1 - q % 2)
    return every.select("doc_id", q.cast("int").alias("side"), slot.cast("int").alias("slot"),
                        F.when(p < F.col("pages"), p).otherwise(-1).cast("int").alias("page"))


def duplex_order(pages: DataFrame, backs_reversed: bool) -> DataFrame:
    """The order of a stack scanned fronts first, then backs."""
    fronts = F.ceil(F.col("pages") / 2)
    p = F.col("page")
    pair = F.col("pages") - 1 - p if backs_reversed else p - fronts
    spot = F.when(p < fronts, p * 2).otherwise(pair * 2 + 1)
    return pages.join(page_counts(pages), "doc_id").withColumn("new_page", spot.cast("int")).drop("pages")


# Grids for a number of pages a sheet, paper sizes in points.
NUP_GRIDS = {2: [(2, 1), (1, 2)], 4: [(2, 2)], 6: [(2, 3), (3, 2)], 8: [(4, 2), (2, 4)], 9: [(3, 3)]}
PAPER = {"a4": (595.28, 841.89), "a3": (841.89, 1190.55), "b5": (515.91, 728.50), "b4": (728.50, 1031.81),
         "letter": (612.0, 792.0)}


def median_aspect(pages: DataFrame) -> DataFrame:
    """Width over height as the reader sees it, upper middle of the sorted values, per document."""
    w, h = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    shaped = pages.select("doc_id", (w / F.greatest(F.lit(1.0), h)).alias("aspect"))
    return shaped.groupBy("doc_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY aspect DESC)").alias("aspect"))


def size_census(pages: DataFrame) -> DataFrame:
    w, h = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    return pages.groupBy("doc_id", w.alias("width"), h.alias("height")).agg(F.count("*").alias("pages"))


def nup_plan(pages: DataFrame, per_sheet: int | str = 2, numbers: bool = False) -> DataFrame:
    """Several pages to a sheet: sheet, slot, the box each page is set in, and the sheet label."""
    notes = str(per_sheet) == "notes3"
    margin, gap = (32.0, 18.0) if notes else (24.0, 10.0)
    aspect = F.col("aspect")
    if notes:
        best = F.struct(F.lit(0.0).alias("scale"), F.lit(595.0).alias("w"), F.lit(842.0).alias("h"),
                        F.lit(1).alias("cols"), F.lit(3).alias("rows"))
    else:
        options = []
        for cols, rows in NUP_GRIDS.get(int(per_sheet), NUP_GRIDS[2]):
            for w, h in ((595.0, 842.0), (842.0, 595.0)):
                scale = F.least((w - 2 * margin - (cols - 1) * gap) / cols / aspect, F.lit((h - 2 * margin - (rows - 1) * gap) / rows))
                options.append(F.struct(scale.alias("scale"), F.lit(w).alias("w"), F.lit(h).alias("h"),
                                        F.lit(cols).alias("cols"), F.lit(rows).alias("rows")))
        # A later option has to be clearly larger to win.
        best = reduce(lambda a, b: F.when(b["scale"] > a["scale"] + 0.5, b).otherwise(a), options)
    sheets = median_aspect(pages).select("doc_id", best.alias("b")).select("doc_id", "b.w", "b.h", "b.cols", "b.rows")
    bottom = 14.0 if numbers else 0.0
    per = F.col("cols") * F.col("rows")
    slot = F.col("page") % per
    cell_w = (F.col("w") - 2 * margin - (F.col("cols") - 1) * gap) / F.col("cols")
    cell_h = (F.col("h") - 2 * margin - bottom - (F.col("rows") - 1) * gap) / F.col("rows")
    x = margin + (slot % F.col("cols")) * (cell_w + gap)
    y = margin + F.floor(slot / F.col("cols")) * (cell_h + gap)
    src_w, src_h = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    room = cell_w * 0.54 if notes else cell_w
    scale = F.least(room / src_w, cell_h / src_h)
    left = x if notes else x + (room - src_w * scale) / 2
    top = y + (cell_h - src_h * scale) / 2
    number = F.floor(F.col("page") / per) + 1
    total = F.floor((F.col("pages") + per - 1) / per)
    label = F.concat_ws(" / ", number.cast("string"), total.cast("string")) if numbers else F.lit(None).cast("string")
    return pages.join(sheets, "doc_id").join(page_counts(pages), "doc_id").select(
        "doc_id", "page", (number - 1).cast("int").alias("sheet"), slot.alias("slot"), F.col("w").alias("sheet_w"),
        F.col("h").alias("sheet_h"), left.alias("x0"), top.alias("y0"), (left + src_w * scale).alias("x1"),
        (top + src_h * scale).alias("y1"), label.alias("label"))


def split_every(pages: DataFrame, every: int) -> DataFrame:
    part = F.floor(F.col("page") / every)
    rows = pages.groupBy("doc_id", part.cast("int").alias("part")).agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return rows.select("doc_id", "part", "a", "b", _part_name().alias("suffix"))


def split_ranges(ranges: DataFrame) -> DataFrame:
    rows = ranges.where(F.col("error").isNull()).groupBy("doc_id", F.col("grp").alias("part")).agg(
        F.min("page").alias("a"), F.max("page").alias("b"))
    return rows.select("doc_id", "part", "a", "b", _part_name().alias("suffix"))


def _part_name() -> Column:
    a, b = (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string")
    return F.concat(F.lit("_p"), F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b)))


def split_by_size(pages: DataFrame, limit: int) -> DataFrame:
    """Greedy parts of at most ``limit`` bytes; a page over the limit stands alone. (doc_id, part, a, b, bytes).

    Sizes add up page by page. For every page the end of a part starting there is known from running sums;
    which pages really start a part follows by doubling jumps, so no document is walked by one task.
    """
    ran = running(pages.select("doc_id", "page", "bytes"), ["doc_id"], "page", {"_to": ("sum", F.col("bytes"))})
    ends = ran.select("doc_id", "page", F.col("_to").alias("_end"), (F.col("_to") - F.col("bytes")).alias("_start"))
    # The first page a part may not take: page positions of start values + limit on the running sums.
    jump = cut_lineage(_next_start(ends, limit))
    reach = jump.where(F.col("page") == 0).select("doc_id", "page")
    hops = jump.where(F.col("next").isNotNull())
    while True:
        fresh = reach.join(hops, ["doc_id", "page"]).select("doc_id", F.col("next").alias("page"))
        grown = cut_lineage(reach.unionByName(fresh).distinct())
        if hops.isEmpty():
            break
        reach = grown
        onward = hops.select("doc_id", F.col("page").alias("next"), F.col("next").alias("_far"))
        hops = cut_lineage(hops.join(onward, ["doc_id", "next"]).select("doc_id", "page", F.col("_far").alias("next")))
    parts = grown.join(jump, ["doc_id", "page"])
    numbered = running(parts, ["doc_id"], "page", {"part": ("sum", F.lit(1))})
    return numbered.select("doc_id", (F.col("part") - 1).cast("int").alias("part"), F.col("page").alias("a"),
                           (F.col("page") + F.col("size") - 1).cast("int").alias("b"), F.col("taken").alias("bytes"))


def _next_start(ends: DataFrame, limit: int) -> DataFrame:
    """For each page: the next start, how many pages a part from here takes, and its bytes.

    An as-of lookup on the running sums: page ends and part limits go in one order, and a running maximum
    carries the last end down to each limit. No pairs are formed.
    """
    marks = ends.select("doc_id", (F.col("_end") * 2).alias("_pos"), F.col("page").alias("_q"), F.col("_end").alias("_q_end"),
                        F.lit(None).cast("int").alias("page"), "_start", "_end")
    limits = ends.select("doc_id", ((F.col("_start") + limit) * 2 + 1).alias("_pos"), F.lit(None).cast("int").alias("_q"),
                         F.lit(None).cast("bigint").alias("_q_end"), "page", "_start", "_end")
    ran = running(marks.unionByName(limits), ["doc_id"], "_pos",
                  {"_last": ("max", F.col("_q")), "_last_end": ("max", F.col("_q_end"))}, width=limit * 2048)
    last = F.greatest(F.col("page"), F.coalesce("_last", "page"))
    last_end = F.greatest(F.col("_end"), F.coalesce("_last_end", "_end"))
    return ran.where(F.col("page").isNotNull()).join(page_counts(ends), "doc_id").select(
        "doc_id", "page", F.when(last + 1 < F.col("pages"), last + 1).alias("next"), (last - F.col("page") + 1).alias("size"),
        (last_end - F.col("_start")).alias("taken"))


def split_spreads(pages: DataFrame, chosen: DataFrame | None = None, right_to_left: bool = False) -> DataFrame:
    """Cut landscape pages into two half pages; portrait pages stay whole. Adds the visible box and new_page."""
    w, h = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    wide = w > h * 1.05
    if chosen is not None:
        pages = pages.join(chosen.select("doc_id", "page").distinct().withColumn("_c", F.lit(True)), ["doc_id", "page"], "left")
        wide = wide & F.coalesce("_c", F.lit(False))
    zero = F.lit(0.0)
    left, right = F.array(zero, zero, w / 2, h), F.array(w / 2, zero, w, h)
    halves = F.array(right, left) if right_to_left else F.array(left, right)
    boxes = F.when(wide, halves).otherwise(F.array(F.array(zero, zero, w, h)))
    ran = running(pages.withColumn("_boxes", boxes), ["doc_id"], "page", {"_end": ("sum", F.size("_boxes"))})
    return ran.select("doc_id", "page", (F.col("_end") - F.size("_boxes")).alias("_at"), F.posexplode("_boxes").alias("half", "box")).select(
        "doc_id", "page", "half", "box", (F.col("_at") + F.col("half")).cast("int").alias("new_page"))


def choose_setting(sizes: DataFrame, target: Column) -> DataFrame:
    """(doc_id, step, dpi, size): the first step within the target, else the smallest file."""
    fits = F.col("size") <= target
    pick = F.struct("step", "dpi", "size")
    best = sizes.groupBy("doc_id").agg(F.min_by(F.when(fits, pick), F.when(fits, F.col("step"))).alias("_fit"),
                                       F.min_by(pick, F.struct("size", "step")).alias("_least"))
    chosen = F.coalesce("_fit", "_least")
    return best.select("doc_id", chosen["dpi"].alias("dpi"), chosen["size"].alias("size"), F.col("_fit").isNotNull().alias("fits"))


# ---------------------------------------------------------------- boxes of pages

def crop(pages: DataFrame, rect: list[float]) -> DataFrame:
    """Visible box in page space from one the reader drew, cut to the page; outside it the ``error`` is set."""
    box = rect_to_page(F.array(*[F.lit(float(v)) for v in rect]), F.col("rotation"), F.col("width"), F.col("height"))
    cut = pages.withColumn("_b", box).withColumn("_b", F.array(
        F.greatest(F.col("_b")[0], F.lit(0.0)), F.greatest(F.col("_b")[1], F.lit(0.0)),
        F.least(F.col("_b")[2], F.col("width")), F.least(F.col("_b")[3], F.col("height"))))
    empty = (F.col("_b")[0] >= F.col("_b")[2]) | (F.col("_b")[1] >= F.col("_b")[3])
    return cut.select("doc_id", "page", F.when(~empty, F.col("_b")).alias("box"), F.when(empty, "outside the page").alias("error"))


def auto_crop(pages: DataFrame, content: DataFrame, padding: float = 14.0) -> DataFrame:
    """Trim to the content box (view space) plus padding; pages already tight or empty are left out."""
    w, h = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    zero = F.lit(0.0)
    boxed = pages.join(content, ["doc_id", "page"]).select(
        "doc_id", "page", w.alias("w"), h.alias("h"), F.greatest(F.col("x0") - padding, zero).alias("x0"),
        F.greatest(F.col("y0") - padding, zero).alias("y0"), F.least(F.col("x1") + padding, w).alias("x1"),
        F.least(F.col("y1") + padding, h).alias("y1"))
    bw, bh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxed.where((bw > 0) & (bh > 0) & ~((bw >= F.col("w") - 1) & (bh >= F.col("h") - 1))).drop("w", "h")


def add_margins(pages: DataFrame, left: float = 0, top: float = 0, right: float = 0, bottom: float = 0) -> DataFrame:
    """Grow the paper; sides are those the reader sees, turned back to the unrotated page. Bottom-left boxes."""
    sides = F.array(*[F.lit(float(v)) for v in (left, top, right, bottom)])
    turns = F.pmod(F.floor(F.col("rotation") / 90), F.lit(4)).cast("int")

    def side(i):
        return F.get(sides, (turns + i) % 4)

    return pages.select("doc_id", "page", (-side(0)).alias("x0"), (-side(3)).alias("y0"),
                        (F.col("width") + side(2)).alias("x1"), (F.col("height") + side(1)).alias("y1"))


def fit_paper(pages: DataFrame, paper: str = "a4") -> DataFrame:
    """Every page on one size of paper, scaled to fit and centred; landscape pages get landscape paper."""
    short, long = PAPER.get(paper.lower(), PAPER["a4"])
    sw, sh = [f(F.col("width"), F.col("height"), F.col("rotation")) for f in (view_width, view_height)]
    w, h = F.when(sw > sh, long).otherwise(short), F.when(sw > sh, short).otherwise(long)
    scale = F.least(w / sw, h / sh)
    return pages.select("doc_id", "page", w.alias("paper_w"), h.alias("paper_h"), ((w - sw * scale) / 2).alias("x0"),
                        ((h - sh * scale) / 2).alias("y0"), ((w + sw * scale) / 2).alias("x1"), ((h + sh * scale) / 2).alias("y1"))


def image_page(width: Column, height: Column, margin: float = 18.0) -> Column:
    """One A4 page per picture, turned to suit it: the page size, and where the picture stands, as large as fits, in the middle."""
    w, h = F.when(width > height, 842.0).otherwise(595.0), F.when(width > height, 595.0).otherwise(842.0)
    scale = F.least((w - 2 * margin) / width, (h - 2 * margin) / height)
    left, top = (w - width * scale) / 2, (h - height * scale) / 2
    return F.struct(w.alias("page_w"), h.alias("page_h"), left.alias("x0"), top.alias("y0"), (w - left).alias("x1"), (h - top).alias("y1"))

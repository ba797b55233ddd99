"""Layout reconstruction: runs, rows, paragraphs, reading order, headings, running headers, margins.

The unit of every sequential step is a block or a page, gathered into one array and walked by ``aggregate``.
``by_page`` shuffles once on (doc_id, page); all finer groupings after it stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.text import BULLET_OR_ROMAN, let, scan, squeeze, starts_like_item, strip
from folioframe.operators.scale import by_key, running
from folioframe.session import cut_lineage


def by_page(df: DataFrame) -> DataFrame:
    """A page in one task. Spark leaves this out where the rows have been put by page before, as ``corpus.words`` does."""
    return by_key(df, "doc_id", "page")


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _replace_last(array: Column, item: Column) -> Column:
    return F.array_append(F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0))), item)


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


# ---------------------------------------------------------------- runs of one style

_RUN = "struct<text:string,font:string,size:double,bold:boolean,italic:boolean,color:int,link:string,sup:boolean,x0:double,y0:double,x1:double,y1:double>"


def style_flags(font: Column, flags: Column) -> dict[str, Column]:
    name = F.lower(F.coalesce(font, F.lit("")))
    return {"bold": (flags.bitwiseAND(16) != 0) | name.rlike("bold|black|heavy|-w6|demi"),
            "italic": (flags.bitwiseAND(2) != 0) | name.rlike("italic|oblique"), "sup": flags.bitwiseAND(1) != 0}


def merge_runs(spans: DataFrame) -> DataFrame:
    """Neighbouring spans of one style with a gap below 0.6 of their size become one span.

    Needs font, size, flags, color, link; a run compares with the style of its first span, so the walk goes
    over the spans of one line.
    """
    flags = style_flags(F.col("font"), F.col("flags"))
    styled = spans.where(F.col("text") != "").withColumns(
        {**flags, "font": F.regexp_replace("font", r"^[A-Z]{6}\+", ""), "size": F.round("size", 1)})
    fields = ["text", "font", "size", "bold", "italic", "color", "link", "sup", "x0", "y0", "x1", "y1"]

    def add(runs, s):
        prev = _last(runs)
        same = (prev["font"].eqNullSafe(s["font"]) & (F.abs(prev["size"] - s["size"]) < 0.2) & (prev["bold"] == s["bold"])
                & (prev["italic"] == s["italic"]) & prev["color"].eqNullSafe(s["color"]) & prev["link"].eqNullSafe(s["link"])
                & (prev["sup"] == s["sup"]) & (F.abs(prev["x1"] - s["x0"]) < s["size"] * 0.6))
        joined = _struct(text=F.concat(prev["text"], s["text"]), font=prev["font"], size=prev["size"], bold=prev["bold"],
                         italic=prev["italic"], color=prev["color"], link=prev["link"], sup=prev["sup"], x0=prev["x0"],
                         y0=F.least(prev["y0"], s["y0"]), x1=s["x1"], y1=F.greatest(prev["y1"], s["y1"]))
        own = _struct(**{f: s[f] for f in fields})
        return F.when((F.size(runs) > 0) & same, _replace_last(runs, joined)).otherwise(F.array_append(runs, own))

    lines = by_page(styled).groupBy("doc_id", "page", "block", "line").agg(
        F.array_sort(F.collect_list(F.struct("span", *fields))).alias("ss"))
    return lines.select("doc_id", "page", "block", "line", F.posexplode(
        F.aggregate("ss", F.array().cast(f"array<{_RUN}>"), add)).alias("span", "r")).select(
        "doc_id", "page", "block", "line", "span", "r.*")


# ---------------------------------------------------------------- rows on one baseline

def merge_baselines(spans: DataFrame) -> DataFrame:
    """Lines of a block that share a baseline become one row; wide gaps in a row get a tab, visible ones a blank.

    Out: (doc_id, page, block, row, pos, text, size, x0, y0, x1, y1, vertical). A line joins the first earlier
    row it overlaps by more than 60 % of the smaller height.
    """
    return _gapped(joined_baselines(spans), ["doc_id", "page", "block", "row"])


_HEIGHTS = "array<struct<y0:double,y1:double>>"


def joined_baselines(spans: DataFrame) -> DataFrame:
    """The rows of ``merge_baselines`` whole, before gaps are looked for: (doc_id, page, block, row, vertical, y0, y1, ss,
    boxes): ``boxes`` are the heights of the pieces where they are not all those of the row.

    The spans of a block that have one height are gathered at once. Where no two of these strips can join, they are the rows
    as they stand; only the other blocks are put together line by line and walked. ``spans`` are spans, or blocks that hold an
    array ``spans`` of level ones.
    """
    keys = ["doc_id", "page", "block"]
    if "spans" in spans.columns:
        # Exploding one item keeps the strips from being put back into what is made of them.
        blocks = spans.select(*keys, F.explode(F.array(_strips(F.filter("spans", lambda s: s["text"] != "")))).alias("zs")).where(F.size("zs") > 0)
    else:
        vertical = F.abs(F.coalesce("dir_y", F.lit(0.0))) > 0.7 if "dir_y" in spans.columns else F.lit(False)
        # The piece is made ahead of the grouping, in compiled code; its line is read from it, or it would be put back into the list.
        pieces = by_page(spans.where(F.col("text") != "")).select(*keys, F.col("y0").alias("top"), F.col("y1").alias("bottom"), vertical.alias("v"), _piece(F.col).alias("s"))
        strips = pieces.groupBy(*keys, "top", "bottom", "v").agg(
            F.min("s.line").alias("first"), F.max("s.line").alias("last"), F.collect_list("s").alias("ss"))
        blocks = strips.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("top", "bottom", "first", "last", "v", "ss"))).alias("zs"))

    def apart(z, i):
        p, q = F.get("zs", i - 1), F.get("zs", i - 2)
        low = F.least(p["bottom"] - p["top"], z["bottom"] - z["top"])
        after = ((z["first"] > p["last"]) & (z["bottom"] >= p["bottom"]) & (p["bottom"] - z["top"] <= low * 0.6)
                 & ((i == 1) | (z["top"] >= q["bottom"])))
        return ~z["v"] & (z["bottom"] > z["top"]) & ((i == 0) | after)

    apart_all = F.forall(F.transform("zs", lambda z, i: F.coalesce(apart(z, i), F.lit(False))), lambda is_apart: is_apart)
    tested = blocks.withColumn("plain", apart_all)
    as_rows = F.transform("zs", lambda z, i: F.struct(i.alias("row"), F.lit(False).alias("vertical"), z["top"].alias("y0"), z["bottom"].alias("y1"),
                                                       F.sort_array(z["ss"]).alias("ss"), F.lit(None).cast(_HEIGHTS).alias("boxes")))
    return _walked_rows(tested).select(*keys, F.explode(F.when(F.col("plain"), as_rows).otherwise(F.col("walked"))).alias("r")).select(*keys, "r.*")


def _piece(field) -> Column:
    """A span as a piece of its row; ``field`` gives its fields by name."""
    return F.struct(*[field(n).alias(n) for n in ("x0", "line", "span", "text", "size", "x1")], *[c.alias(n) for n, c in _edges(field("text")).items()])


def _strips(held: Column) -> Column:
    """The spans of a block by their heights, from the top."""
    def strip_of(spans, h):
        same = F.filter(spans, lambda s: s["y0"].eqNullSafe(h["top"]) & s["y1"].eqNullSafe(h["bottom"]))
        return let(same, lambda ss: _struct(top=h["top"], bottom=h["bottom"], first=F.array_min(ss["line"]), last=F.array_max(ss["line"]),
                                            v=F.lit(False), ss=F.transform(ss, lambda s: _piece(lambda n: s[n]))))

    heights = lambda spans: F.sort_array(F.array_distinct(F.transform(spans, lambda s: _struct(top=s["y0"], bottom=s["y1"]))))
    return let(held, lambda spans: F.transform(heights(spans), lambda h: strip_of(spans, h)))


def _walked_rows(blocks: DataFrame) -> DataFrame:
    """Add ``walked``: the rows of each block that is not ``plain``, found line by line."""
    own = F.transform("zs", lambda z: F.transform(z["ss"], lambda s: F.struct(
        s["line"].alias("line"), z["v"].alias("v"), z["top"].alias("y0"), z["bottom"].alias("y1"), s.alias("s"))))
    spans = blocks.withColumn("all", F.when(~F.col("plain"), F.sort_array(F.flatten(own))))
    heads = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (i == 0) | (F.get("all", i)["line"] != F.get("all", i - 1)["line"]))
    marked = spans.withColumn("heads", F.when(~F.col("plain"), heads))

    def line_of(a, k):
        held = F.slice("all", a + 1, F.coalesce(F.get("heads", k + 1), F.size("all")) - a)
        return let(held, lambda h: _struct(v=F.exists(h, lambda s: s["v"]), y0=F.array_min(F.transform(h, lambda s: s["y0"])),
                                           y1=F.array_max(F.transform(h, lambda s: s["y1"])), ss=F.transform(h, lambda s: _struct(s=s["s"], y0=s["y0"], y1=s["y1"]))))

    lines = marked.withColumn("ls", F.transform("heads", line_of))
    # The walk carries only the heights of the rows and the row of each line; the spans stay where they are.
    kind = "struct<rows:array<struct<v:boolean,y0:double,y1:double>>,at:array<int>>"
    begin = F.struct(F.array().alias("rows"), F.array().alias("at")).cast(kind)

    def add(acc, ln):
        def joins(r):
            height = F.least(r["y1"] - r["y0"], ln["y1"] - ln["y0"])
            return ~r["v"] & (height > 0) & (F.least(r["y1"], ln["y1"]) - F.greatest(r["y0"], ln["y0"]) > height * 0.6)

        found = F.when(ln["v"], 0).otherwise(F.array_position(F.transform(acc["rows"], joins), F.lit(True)).cast("int"))
        own = _struct(v=ln["v"], y0=ln["y0"], y1=ln["y1"])
        grown = F.transform(acc["rows"], lambda r, i: F.when(i + 1 == found, _struct(
            v=r["v"], y0=F.least(r["y0"], ln["y0"]), y1=F.greatest(r["y1"], ln["y1"]))).otherwise(r))
        return F.when(found > 0, _struct(rows=grown, at=F.array_append(acc["at"], found))).otherwise(_struct(
            rows=F.array_append(acc["rows"], own), at=F.array_append(acc["at"], F.size(acc["rows"]) + 1)))

    # Neighbours with one and the same height go to one row in any case, so the walk takes one step for them all.
    boxed = lines.withColumn("hs", F.transform("ls", lambda r: _struct(v=r["v"], y0=r["y0"], y1=r["y1"])))

    def turns(i):
        h, p = F.get("hs", i), F.get("hs", i - 1)
        return (i == 0) | h["v"] | (h["y1"] <= h["y0"]) | (h["y0"] != p["y0"]) | (h["y1"] != p["y1"])

    runs = boxed.withColumn("st", F.when(~F.col("plain"), F.filter(F.sequence(F.lit(0), F.size("ls") - 1), turns)))
    stepped = runs.withColumn("at", F.when(~F.col("plain"), F.aggregate(F.transform("st", lambda i: F.get("hs", i)), begin, add)["at"]))
    of_line = F.transform("ls", lambda _, i: F.get("at", F.size(F.filter("st", lambda first: first <= i)) - 1))
    paired = stepped.withColumn("ps", F.when(~F.col("plain"), F.arrays_zip(F.col("ls").alias("l"), of_line.alias("row"))))

    def row_of(number):
        def spans(held):
            by_x = F.sort_array(F.flatten(F.transform(held, lambda z: z["l"]["ss"])))
            by_span = F.transform(F.sort_array(F.flatten(F.transform(held, lambda z: F.transform(
                z["l"]["ss"], lambda p: F.struct(p["s"]["span"].alias("k"), p.alias("p")))))), lambda r: r["p"])
            vertical = F.exists(held, lambda z: z["l"]["v"])
            top, bottom = F.array_min(F.transform(held, lambda z: z["l"]["y0"])), F.array_max(F.transform(held, lambda z: z["l"]["y1"]))
            return let(F.when(vertical, by_span).otherwise(by_x), lambda ps: F.struct(
                (number - 1).alias("row"), vertical.alias("vertical"), top.alias("y0"), bottom.alias("y1"), F.transform(ps, lambda p: p["s"]).alias("ss"),
                F.transform(ps, lambda p: _struct(y0=p["y0"], y1=p["y1"])).alias("boxes")))

        return let(F.filter("ps", lambda z: z["row"] == number), spans)

    return paired.withColumn("walked", F.when(~F.col("plain"), F.transform(F.sequence(F.lit(1), F.array_max("at")), row_of)))


def _edges(text: Column) -> dict[str, Column]:
    """What the rule of gaps asks of a text: how it ends (1 a blank, 2 a tab, 3 it is a tab) and whether it begins with a blank."""
    blank = [" ", "　"]
    ends = F.when(text == "\t", 3).when(text.endswith("\t"), 2).when(text.endswith(blank[0]) | text.endswith(blank[1]), 1).otherwise(0)
    return {"ends": ends, "begins": text.startswith(blank[0]) | text.startswith(blank[1])}


def gap_signs(ss: Column, vertical: Column) -> Column:
    """For each piece of a row what stands in the gap before it: a tab, a wide blank, a blank or null."""
    def sign(p, s):
        gap, size = s["x0"] - p["x1"], F.greatest(p["size"], s["size"])
        return (F.when((gap > size * 1.5) & (p["ends"] < 2), "\t")
                .when((gap > size * 0.3) & (p["ends"] == 0) & ~s["begins"], F.when(gap > size * 0.8, "　").otherwise(" ")))

    # Not ``concat``: between compiled parts its arrays are put together far more slowly than by ``flatten``.
    before = F.flatten(F.array(F.array(F.get(ss, F.lit(-1))), F.slice(ss, F.lit(1), F.size(ss) - 1)))
    return F.when(vertical, F.transform(ss, lambda _: F.lit(None).cast("string"))).otherwise(F.zip_with(before, ss, sign))


def _signs() -> Column:
    return gap_signs(F.col("ss"), F.col("vertical"))


def gapped_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``joined_baselines`` with the texts of their pieces, each behind the sign of its gap.

    Out: (doc_id, page, block, row, y0, x0, signs, ts, xs, own): ``own`` tells which pieces are tabs themselves, if any.
    """
    signed = rows.withColumn("signs", _signs())
    left = F.when(F.col("vertical"), F.array_min(F.transform("ss", lambda s: s["x0"]))).otherwise(F.get("ss", F.lit(0))["x0"])
    return signed.select("doc_id", "page", "block", "row", "y0", left.alias("x0"), "signs",
                         F.zip_with("signs", "ss", lambda g, s: F.concat_ws("", g, s["text"])).alias("ts"), F.col("ss.x0").alias("xs"),
                         F.when(F.array_contains("ss.ends", 3), F.transform("ss.ends", lambda e: e == 3)).alias("own"))


def _with_gaps() -> Column:
    """The pieces ``ss`` of a row, with a tab in a wide gap (``signs``) and a blank in a visible one."""
    def with_gap(s, i):
        def height(i):
            return [F.when(F.col("boxes").isNull(), F.col(y)).otherwise(F.get("boxes", i)[y]) for y in ("y0", "y1")]

        p, sign, (y0, y1), (p0, p1) = F.get("ss", i - 1), F.get("signs", i), height(i), height(i - 1)
        own = _struct(text=s["text"], size=s["size"], x0=s["x0"], y0=y0, x1=s["x1"], y1=y1, ends=s["ends"], begins=s["begins"])
        filler = _struct(text=sign, size=p["size"], x0=p["x1"], y0=p0, x1=s["x0"], y1=p1, ends=F.when(sign == "\t", 3).otherwise(1), begins=sign != "\t")
        return F.when(sign.isNull(), F.array(own)).otherwise(F.array(filler, own))

    return F.flatten(F.transform("ss", with_gap))


def _gapped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces ``ss`` of each row one by one, with a tab in a wide gap and a blank in a visible one."""
    return rows.withColumn("signs", _signs()).select(*keys, "vertical", F.posexplode(_with_gaps()).alias("pos", "s")).select(
        *keys, "pos", *[f"s.{c}" for c in ("text", "size", "x0", "y0", "x1", "y1")], "vertical")


def page_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, page, lines): the lines of a page in order of their blocks, each with its box and its pieces ``ps``.

    ``rows`` are whole ones of ``joined_baselines``, whose pieces are never taken apart, or rows of ``merge_baselines``.
    """
    keys, piece = ["doc_id", "page"], ["text", "size", "x0", "y0", "x1", "y1", "ends", "begins"]
    if "ss" in rows.columns:
        held = rows.withColumn("signs", _signs()).select(*keys, "block", "row", "vertical", F.explode(F.array(_with_gaps())).alias("ps"))
    else:
        by_pos = F.sort_array(F.collect_list(F.struct("pos", *piece)))
        held = by_page(rows).withColumns(_edges(F.col("text"))).groupBy(*keys, "block", "row").agg(
            F.bool_or("vertical").alias("vertical"), F.transform(by_pos, lambda p: F.struct(*[p[c].alias(c) for c in piece])).alias("ps"))
    line = F.struct("block", "row", "vertical", *[F.array_min(f"ps.{c}").alias(c) for c in ("x0", "y0")], *[F.array_max(f"ps.{c}").alias(c) for c in ("x1", "y1")], "ps")
    return held.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("lines"))


def cut_where(items: Column, breaks) -> Column:
    """An array cut into runs: ``breaks`` of an item and the one before tells where a new one begins."""
    heads = F.filter(F.transform(items, lambda r, i: F.when((i == 0) | breaks(r, F.get(items, i - 1)), i)), lambda i: i.isNotNull())
    return let(heads, lambda hs: F.transform(hs, lambda a, k: F.slice(items, a + 1, F.coalesce(F.get(hs, k + 1), F.size(items)) - a)))


def rows_of_page(lines: Column) -> Column:
    """The rows of a page from its ``lines``: array of (row, vertical, y0, ss), in order of ``row``.

    ``row`` is the place of the row's first line among the lines with text, by height. A line joins the first earlier row that
    it overlaps by more than 60 % of the smaller height. Where no line reaches below the next one's top the page is cut, and
    the walk goes on with no rows to look at.
    """
    solid = F.filter(lines, lambda r: F.exists(r["ps"], lambda p: strip(p["text"]) != ""))
    ordered = F.sort_array(F.transform(solid, lambda r: _struct(y0=r["y0"], x0=r["x0"], block=r["block"], row=r["row"], y1=r["y1"], v=r["vertical"], ps=r["ps"])))
    begin = F.struct(F.array().alias("rows"), F.lit(None).alias("reach"), F.lit(0).alias("at")).cast(
        "struct<rows:array<struct<ln:int,y0:double,y1:double>>,reach:double,at:int>")

    def step(now, ln):
        def joins(r):
            height = F.least(r["y1"] - r["y0"], ln["y1"] - ln["y0"])
            return (height > 0) & (F.least(r["y1"], ln["y1"]) - F.greatest(r["y0"], ln["y0"]) > height * 0.6)

        def placed(rows):
            def joined(head):
                own = _struct(ln=ln["ln"], y0=ln["y0"], y1=ln["y1"])
                grown = F.transform(rows, lambda r: F.when(r["ln"] == head, _struct(
                    ln=r["ln"], y0=F.least(r["y0"], ln["y0"]), y1=F.greatest(r["y1"], ln["y1"]))).otherwise(r))
                return _struct(rows=F.when(head.isNotNull(), grown).otherwise(F.array_append(rows, own)), reach=F.greatest(now["reach"], ln["y1"]),
                               at=F.coalesce(head, ln["ln"]))

            return let(F.get(F.filter(rows, joins), F.lit(0))["ln"], joined)

        live = F.when(F.coalesce(ln["y0"] >= now["reach"], F.lit(False)), begin["rows"]).otherwise(now["rows"])
        return F.when(ln["v"], _struct(rows=now["rows"], reach=now["reach"], at=ln["ln"])).otherwise(let(live, placed))

    def of_lines(every):
        light = F.transform(every, lambda r, i: _struct(ln=i + 1, y0=r["y0"], y1=r["y1"], v=r["v"]))
        members = F.sort_array(F.transform(scan(light, begin, step), lambda now, i: _struct(at=now["at"], i=i)))

        def row(group):
            def pieces(held):
                by_x = F.sort_array(F.flatten(F.transform(held, lambda r, ln: F.transform(r["ps"], lambda p, pos: _struct(
                    x=p["x0"], ln=ln, pos=pos, p=p)))))
                return _struct(row=F.get(group, F.lit(0))["at"], vertical=F.exists(held, lambda r: r["v"]), y0=F.array_min(held["y0"]), ss=F.when(
                    F.size(held) == 1, F.get(held, F.lit(0))["ps"]).otherwise(F.transform(by_x, lambda r: r["p"])))

            return let(F.transform(group, lambda m: F.get(every, m["i"])), pieces)

        return let(members, lambda ms: F.transform(cut_where(ms, lambda m, before: m["at"] != before["at"]), row))

    return let(ordered, of_lines)


def merge_page_rows(pieces: DataFrame) -> DataFrame:
    """Rows of ``merge_baselines`` that lie on one baseline of the page, whatever their blocks, become one row.

    Out: the same columns; ``block`` is 0 and ``row`` as in ``rows_of_page``.
    """
    keys = ["doc_id", "page"]
    rows = page_lines(pieces).select(*keys, F.explode(rows_of_page(F.col("lines"))).alias("r")).select(
        *keys, F.lit(0).alias("block"), "r.row", "r.vertical", "r.ss", F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), F.col("r.ss").alias("boxes"))
    return _gapped(rows, [*keys, "block", "row"])


def row_texts(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "block", "row")) -> DataFrame:
    """Rows as text with their box."""
    return pieces.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.bool_or("vertical").alias("vertical"))


# ---------------------------------------------------------------- lines and blocks

def lines_of(spans: DataFrame) -> DataFrame:
    """Spans put together to lines: text, box, largest size of spans with text, bold of the first of them."""
    solid = F.trim("text") != ""
    bold = (F.col("flags").bitwiseAND(16) != 0)
    return by_page(spans).groupBy("doc_id", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda r: r["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max(F.when(solid, F.col("size"))).alias("size"), F.coalesce(F.min_by(bold, F.when(solid, F.col("span"))), F.lit(False)).alias("bold"),
        F.bool_and(F.when(solid, bold)).alias("all_bold"), F.bool_or(F.when(solid, bold)).alias("any_bold"),
        F.max("size").alias("any_size"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Lines put together to blocks; ``lines`` inside is the array of them in order."""
    one = F.struct("line", "text", "x0", "y0", "x1", "y1", "size", "bold")
    return lines.groupBy("doc_id", "page", "block").agg(
        F.array_sort(F.collect_list(one)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.coalesce(F.max("size"), F.lit(10.0)).alias("size"),
        F.coalesce(F.bool_and("all_bold"), F.lit(True)).alias("all_bold"), F.max("any_size").alias("any_size"))


def block_text(sep: str = "\n") -> Column:
    return F.array_join(F.transform("lines", lambda r: r["text"]), sep)


# ---------------------------------------------------------------- body size, three rules

def body_size_by_spans(spans: DataFrame) -> DataFrame:
    """Most spans with text; the smaller size on a tie."""
    sizes = spans.where(strip(F.col("text")) != "").groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("body"))


def body_size_by_lines(lines: DataFrame) -> DataFrame:
    """Most characters, each line under its largest size; the size seen first on a tie."""
    at = F.struct("page", "block", "line")
    sizes = lines.where(F.col("size").isNotNull()).groupBy("doc_id", F.round("size", 1).alias("size")).agg(
        F.sum(F.length(squeeze(F.col("text")))).alias("n"), F.min(at).alias("at"))
    return _most_first(sizes, ["doc_id"])


def body_size_by_page(spans: DataFrame) -> DataFrame:
    """Most trimmed characters on each page; the size seen first on a tie."""
    text = strip(F.col("text"))
    sizes = by_page(spans.where(text != "")).groupBy("doc_id", "page", F.round("size", 1).alias("size")).agg(
        F.sum(F.length(text)).alias("n"), F.min(F.struct("block", "line", "span")).alias("at"))
    return _most_first(sizes, ["doc_id", "page"])


def _most_first(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The size with the largest n; among equals the one with the smallest ``at``."""
    top = sizes.groupBy(*keys).agg(F.max("n").alias("_top"))
    return sizes.join(top, keys).where(F.col("n") == F.col("_top")).groupBy(*keys).agg(F.min_by("size", "at").alias("body"))


# ---------------------------------------------------------------- headings and outline

def heading_levels(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Level 1-3 of heading blocks by the rank of their size among the larger sizes of the page, 0 for text."""
    text = strip(block_text())
    sized = blocks.join(body, ["doc_id", "page"])
    rank = sized.where(F.col("size") >= F.col("body") * 1.1).groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_set("size"), asc=False).alias("rank"))
    at = F.array_position(F.slice("rank", 1, 3), F.col("size"))
    plain = (F.size("lines") > 2) | (text == "") | (F.length(text) > 120)
    level = (F.when(plain | F.col("rank").isNull(), 0).when((F.col("size") >= F.col("body") * 1.25) & (at > 0), at)
             .when((F.col("size") >= F.col("body") * 1.12) & F.col("all_bold") & (at > 0), F.least(F.lit(3), at)).otherwise(0))
    return sized.join(rank, ["doc_id", "page"], "left").select("doc_id", "page", "block", text.alias("text"),
                                                               level.cast("int").alias("level"))


def structure_tags(blocks: DataFrame, body: DataFrame, cut: int | None = None) -> DataFrame:
    """H1 / H2 / P of each block by its size against the body of the document; ``cut`` shortens the texts."""
    text = strip(block_text(""))
    tag = F.when(F.col("any_size") >= F.col("body") * 1.4, "H1").when(F.col("any_size") >= F.col("body") * 1.15, "H2").otherwise("P")
    return blocks.join(body, "doc_id").where(text != "").select("doc_id", "page", "block", tag.alias("tag"),
                                                                (F.left(text, F.lit(cut)) if cut else text).alias("text"))


def pick_titles(blocks: DataFrame, body: DataFrame, pages: DataFrame) -> DataFrame:
    """The title of each page: upper 40 %, at most two lines and 100 signs, clearly larger than the body."""
    fit = blocks.join(body, ["doc_id", "page"]).join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).where(
        (F.col("y0") <= F.col("height") * 0.4) & (F.size("lines") <= 2) & (F.length(strip(block_text())) <= 100)
        & (F.col("size") >= F.col("body") * 1.2))
    return fit.groupBy("doc_id", "page").agg(F.min_by(
        F.struct("block", strip(block_text()).alias("text")), F.struct(-F.col("size"), F.col("y0"), F.col("block"))).alias("t")).select(
        "doc_id", "page", "t.block", "t.text")


_QUESTION_LABEL = r"^[A-Za-zＡ-Ｚａ-ｚ]{0,2}[\s\x{3000}.．:：]*\p{Nd}{1,4}[\s\x{3000}.．)）]*$"


def outline_lines(lines: DataFrame) -> DataFrame:
    """Lines with text, squeezed, and whether they could be headings at all."""
    text = squeeze(F.col("text"))
    rows = lines.where(F.col("size").isNotNull()).select(
        "doc_id", "page", F.struct("block", "line").alias("at"), text.alias("text"), F.round("size", 1).alias("size"),
        F.coalesce("any_bold", F.lit(False)).alias("bold"), "y0", "y1")
    plausible = (F.length("text").between(2, 80) & ~F.replace("text", F.lit(" ")).rlike(r"^\p{Nd}+$")
                 & ~F.col("text").rlike("[。、,;]$"))
    return rows.withColumn("plausible", plausible)


def standalone_bold(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, at) of short bold lines of body size with air above and nothing else on their baseline.

    Candidates are few; each meets the lines of its own page once.
    """
    fit = lines.join(body, "doc_id").where(
        F.col("plausible") & F.col("bold") & (F.abs(F.col("size") - F.col("body")) <= F.col("body") * 0.04)
        & F.length("text").between(2, 30) & ~F.col("text").rlike(_QUESTION_LABEL)).select("doc_id", "page", "at", "size", "y0")
    other = lines.select("doc_id", "page", F.col("at").alias("o_at"), F.col("y0").alias("o_y0"), F.col("y1").alias("o_y1"))
    crowded = (F.col("o_at") != F.col("at")) & (F.abs(F.col("o_y0") - F.col("y0")) < F.col("size") * 0.5)
    seen = fit.join(other, ["doc_id", "page"]).groupBy("doc_id", "page", "at", "size", "y0").agg(
        F.bool_or(crowded).alias("crowded"), F.max(F.when(F.col("o_y1") <= F.col("y0") + 1, F.col("o_y1"))).alias("top"))
    return seen.where(~F.col("crowded") & (F.col("y0") - F.coalesce("top", F.lit(0.0)) >= F.col("size") * 0.9)).select("doc_id", "page", "at")


def auto_outline(lines: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """A table of contents guessed from the text: (doc_id, seq, level, title, page), pages from one.

    Headings stand out by size or weight; text on many pages is a running header; where too few headings turn
    up, each page gives its most prominent line. ``limit`` keeps the first entries of a document only. The squeezed lines, and
    those of them that can be headings, are used several times and so written once each to the checkpoint folder.
    """
    rows = cut_lineage(outline_lines(lines))
    body = _most_first(rows.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "at")).alias("at")), ["doc_id"])
    alone = standalone_bold(rows, body).withColumn("alone", F.lit(True))
    judged = cut_lineage(rows.where("plausible").join(body, "doc_id").join(alone, ["doc_id", "page", "at"], "left").select(
        "doc_id", "page", "at", "text", "size", "bold", "y0", "body", F.coalesce("alone", F.lit(False)).alias("alone")))
    counts = cut_lineage(pages.groupBy("doc_id").agg(F.count("*").alias("pages")))
    size, body = F.col("size"), F.col("body")
    large = (size >= body * 1.18) | (F.col("bold") & (size >= body * 1.04) & (F.length("text") <= 40)) | F.col("alone")
    heads = judged.where(large)
    often = heads.select("doc_id", "text", "page").distinct().groupBy("doc_id", "text").agg(F.count("*").alias("seen")).join(
        counts, "doc_id").where(F.col("seen") > F.greatest(F.lit(2.0), F.col("pages") * 0.25)).select("doc_id", "text")
    kept = heads.join(often, ["doc_id", "text"], "left_anti")
    tally = kept.groupBy("doc_id").agg(F.count("*").alias("n"))
    few = counts.join(tally, "doc_id", "left").where(
        F.coalesce("n", F.lit(0)) < F.greatest(F.lit(3.0), F.col("pages") * 0.15)).select("doc_id")
    cols = ["doc_id", "page", "at", "text", "size", "y0"]
    normal = kept.join(few, "doc_id", "left_anti").select(*cols)
    slides = judged.join(few, "doc_id", "left_semi").groupBy("doc_id", "page").agg(
        F.min_by(F.struct("at", "text", "y0"), F.struct(-size, F.col("y0"), F.col("at"))).alias("t"), F.first("body").alias("body")
    ).select("doc_id", "page", "t.at", "t.text", (body + 99).alias("size"), "t.y0")
    found = normal.unionByName(slides.select(*cols))
    ranks = found.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("size"), asc=False), 1, 3).alias("rank"))
    level = F.array_position("rank", F.col("size"))
    in_page = Window.partitionBy("doc_id", "page").orderBy("y0", "at")
    ordered = found.join(ranks, "doc_id").withColumn("_before", F.lag("text").over(in_page)).withColumn(
        "_k", F.row_number().over(in_page)).where(~F.col("text").eqNullSafe(F.col("_before")))
    step = 1 << 20
    numbered = running(ordered.withColumn("_pos", F.col("page").cast("bigint") * step + F.col("_k")), ["doc_id"], "_pos",
                       {"seq": ("sum", F.lit(1))}, width=4096 * step)
    return (numbered.where(F.col("seq") <= limit) if limit else numbered).select(
        "doc_id", F.col("seq").cast("int").alias("seq"), F.when(level > 0, level).otherwise(3).cast("int").alias("level"),
        F.col("text").alias("title"), (F.col("page") + 1).alias("page"))


# ---------------------------------------------------------------- running headers, boxes, margins, breaks

def repeating_text(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks in the top or bottom band whose text, digits set aside, recurs on half of the pages or more.

    ``blocks`` is (doc_id, page, block, text, y0, y1). Documents of fewer than three pages have none.
    """
    key = F.regexp_replace(strip(F.col("text")), r"\p{Nd}+", "#")
    band = F.when(F.col("y1") < F.col("height") * 0.09, "top").when(F.col("y0") > F.col("height") * 0.91, "bottom")
    placed = blocks.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).select(
        "doc_id", "page", "block", key.alias("key"), band.alias("band")).where((F.col("key") != "") & F.col("band").isNotNull())
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    often = (placed.groupBy("doc_id", "band", "key").agg(F.countDistinct("page").alias("seen")).join(counts, "doc_id")
             .where((F.col("n") >= 3) & (F.col("seen") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.5 + 0.5)))))
    return placed.join(often.select("doc_id", "band", "key"), ["doc_id", "band", "key"], "left_semi").select(
        "doc_id", "page", "block", "band", "key")


def content_boxes(*parts: DataFrame) -> DataFrame:
    """The box round everything on a page: text with signs, pictures, drawings, marks; empty boxes do not count."""
    every = None
    for part in parts:
        solid = part.where(F.trim("text") != "") if "text" in part.columns else part
        boxes = solid.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select("doc_id", "page", "x0", "y0", "x1", "y1")
        every = boxes if every is None else every.unionByName(boxes)
    return every.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def cheap_scanned(pages: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with fewer than five signs and a picture. ``texts`` is (doc_id, page, chars)."""
    pictured = images.select("doc_id", "page").distinct()
    return pages.select("doc_id", "page").join(pictured, ["doc_id", "page"], "left_semi").join(
        texts, ["doc_id", "page"], "left").where(F.coalesce("chars", F.lit(0)) < 5).select("doc_id", "page")


def document_margins(blocks: DataFrame, pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """One set of margins per document: those of the widest text area, each side kept within 18 pt and 40 %."""
    body = (blocks.where(strip(F.col("text")) != "").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
            .join(scanned, ["doc_id", "page"], "left_anti")
            .where((F.col("y1") > F.col("height") * 0.09) & (F.col("y0") < F.col("height") * 0.91)))
    w, h = F.col("width"), F.col("height")

    def kept(value, full):
        return F.greatest(F.lit(18.0), F.least(value, full * 0.4))

    per_page = body.groupBy("doc_id", "page", "width", "height").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    sides = per_page.groupBy("doc_id").agg(
        F.min(kept(F.col("x0"), w)).alias("left"), F.min(kept(F.col("y0"), h)).alias("top"),
        F.min(kept(w - F.col("x1"), w)).alias("right"), F.min(kept(h - F.col("y1"), h)).alias("bottom"))
    return sides.withColumn("bottom", F.least("bottom", F.greatest("top", F.lit(72.0))))


def section_breaks(blocks: DataFrame, pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc_id, page, breaks): whether a new section starts after the page.

    The next page comes by an equal join on page + 1, so long documents stay spread out.
    """
    text = strip(F.col("text")) != ""
    low = (blocks.where(text).join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
           .where(F.col("y1") < F.col("height") * 0.91).groupBy("doc_id", "page").agg(F.max("y1").alias("low")))
    sides = pages.select("doc_id", "page", "width", "height").join(
        scanned.withColumn("scan", F.lit(True)), ["doc_id", "page"], "left").join(low, ["doc_id", "page"], "left")
    after = sides.select("doc_id", (F.col("page") - 1).alias("page"), F.col("width").alias("nw"), F.col("height").alias("nh"),
                         F.coalesce("scan", F.lit(False)).alias("nscan"), F.lit(True).alias("more"))
    other = (F.abs(F.col("width") - F.col("nw")) > 1) | (F.abs(F.col("height") - F.col("nh")) > 1) | \
        F.coalesce("scan", F.lit(False)) | F.col("nscan")
    short = F.col("low").isNull() | (F.col("low") < F.col("height") * 0.80)
    return sides.join(after, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(F.col("more"), other | short).otherwise(False).alias("breaks"))


def block_alignment(blocks: DataFrame) -> DataFrame:
    """l, ctr or r: from how far the edges and centres of the lines spread."""
    def spread(value):
        values = F.transform("lines", value)
        return F.array_max(values) - F.array_min(values)

    left, right = spread(lambda r: r["x0"]), spread(lambda r: r["x1"])
    centre = spread(lambda r: (r["x0"] + r["x1"]) / 2)
    align = (F.when((F.size("lines") < 2) | (left < 2.0), "l").when(centre < 2.5, "ctr").when(right < 2.5, "r").otherwise("l"))
    return blocks.select("doc_id", "page", "block", align.alias("align"))


# ---------------------------------------------------------------- blocks that belong together

def _first_word_width(text: Column, size: Column) -> Column:
    word = F.regexp_extract(F.ltrim(text), r"^[A-Za-z0-9’'\-.,:;/%$#@&+=_()\[\]]+", 0)
    return F.when(F.ltrim(text) == "", 0.0).when(word != "", F.length(word) * size * 0.55).otherwise(size)


_WIDE_SIGN = r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}\x{ac00}-\x{d7af}]"


def join_block_lines(blocks: DataFrame, hyphens: bool = True, force_hard: bool = False) -> DataFrame:
    """The text of each block with wrapped lines joined and real breaks kept.

    A break is real before a list item, or where the next word would have fitted on the line. With ``hyphens``
    a word cut at the line end is put together; without, the slide rule applies and it stays as it is.
    """
    right = F.array_max(F.transform("lines", lambda r: r["x1"]))
    ready = blocks.withColumn("_right", right).withColumn("_n", F.size("lines"))

    def piece(ln, i):
        nxt = F.get(F.col("lines"), i + 1)
        this, follow = F.rtrim(ln["text"]), F.ltrim(nxt["text"])
        size, gap = F.coalesce(ln["size"], F.lit(10.0)), F.col("_right") - ln["x1"]
        fits = (gap >= _first_word_width(follow, size) + size * 0.3) & (gap > size * 1.2)
        hard = F.lit(True) if force_hard else follow.rlike(BULLET_OR_ROMAN) | fits
        wide = F.right(this, F.lit(1)).rlike(_WIDE_SIGN) | F.left(follow, F.lit(1)).rlike(_WIDE_SIGN)
        out = F.when(i + 1 == F.col("_n"), ln["text"]).when(hard, F.concat(ln["text"], F.lit("\n")))
        if hyphens:
            out = out.when(this.endswith("-") & F.left(follow, F.lit(1)).rlike(r"^\p{Ll}"),
                           F.substring(this, F.lit(1), F.length(this) - 1))
        return out.when((this != "") & (follow != "") & ~wide, F.concat(ln["text"], F.lit(" "))).otherwise(ln["text"])

    return ready.select("doc_id", "page", "block", F.array_join(F.transform("lines", piece), "").alias("text"))


def _page_blocks(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """The blocks of a page in order of height and left edge."""
    key = F.struct(F.bround("y0").alias("ry"), F.col("x0").alias("rx"), *fields)
    return by_page(blocks).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(key)).alias("bs"))


def merge_row_blocks(blocks: DataFrame) -> DataFrame:
    """One-line blocks on one baseline become one: (doc_id, page, row, blocks, x0, y0, x1, y1).

    A block joins the nearest of the last eight rows that ends at most 160 pt to its left. A sweep cuts the page where no
    block before reaches below the top of those that follow: nothing joins across a cut, so only the few blocks between two
    cuts are walked together.
    """
    keys = ["doc_id", "page"]
    kind = "array<struct<n:int,v:boolean,x0:double,y0:double,x1:double,y1:double,ids:array<int>>>"
    vertical = F.col("vertical") if "vertical" in blocks.columns else F.lit(False)
    single = by_page(blocks.select(*keys, "block", F.bround("y0").alias("ry"), F.col("x0").alias("rx"), "y0", "x1", "y1",
                                   F.size("lines").alias("n"), vertical.alias("v")))
    order = Window.partitionBy(*keys).orderBy("ry", "rx", "block")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Blocks further on in this order begin at ry - 0.5 or below.
    cut = F.sum(F.coalesce(F.col("ry") - 0.5 >= F.col("_reach"), F.lit(False)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = single.withColumn("_reach", reach).withColumn("_part", cut).groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(
        F.struct("ry", "rx", "block", "n", "v", "y0", "x1", "y1"))).alias("bs"))

    def add(rows, b):
        count = F.size(rows)
        recent = F.slice(rows, F.greatest(count - 7, F.lit(1)), F.lit(8))

        def joins(r):
            h = F.least(r["y1"] - r["y0"], b["y1"] - b["y0"])
            return ((r["n"] == 1) & ~r["v"] & (h > 0) & (F.least(r["y1"], b["y1"]) - F.greatest(r["y0"], b["y0"]) > h * 0.6)
                    & (b["rx"] >= r["x1"] - 1) & (b["rx"] - r["x1"] < 160))

        back = F.array_position(F.reverse(F.transform(recent, joins)), F.lit(True))
        at = F.when((b["n"] == 1) & ~b["v"] & (back > 0), count - back + 1).otherwise(0)
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == at, _struct(
            n=r["n"], v=r["v"], x0=F.least(r["x0"], b["rx"]), y0=F.least(r["y0"], b["y0"]), x1=F.greatest(r["x1"], b["x1"]),
            y1=F.greatest(r["y1"], b["y1"]), ids=F.array_append(r["ids"], b["block"]))).otherwise(r))
        own = _struct(n=b["n"], v=b["v"], x0=b["rx"], y0=b["y0"], x1=b["x1"], y1=b["y1"], ids=F.array(b["block"]))
        return F.when(at > 0, grown).otherwise(F.array_append(rows, own))

    walked = parts.select(*keys, "_part", F.posexplode(F.aggregate("bs", F.array().cast(kind), add)).alias("_at", "r"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_at")) - 1
    return walked.select(*keys, place.alias("row"), F.col("r.ids").alias("blocks"), "r.x0", "r.y0", "r.x1", "r.y1")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks the page wraps into one paragraph: (doc_id, page, para, blocks, x0, y0, x1, y1, size).

    A block joins one of the last six when it sits at line spacing in the same type and weight, is no list
    item, does not start further left, and the line above ran up to the right edge of the page's text.
    """
    first, last = F.col("lines")[0], F.element_at("lines", -1)
    wide = F.array_max(F.transform(F.filter("lines", lambda r: F.length(strip(r["text"])) >= 15), lambda r: r["x1"]))
    flat = blocks.select(
        "doc_id", "page", "block", "x0", "y0", "x1", "y1", "size", wide.alias("wide"), first["x0"].alias("fx0"),
        first["y0"].alias("fy0"), starts_like_item(F.ltrim(first["text"])).alias("item"), first["bold"].alias("fbold"),
        last["x0"].alias("lx0"), last["x1"].alias("lx1"), last["y1"].alias("ly1"), last["bold"].alias("lbold"))
    fields = ["block", "y0", "x1", "y1", "size", "wide", "fx0", "fy0", "item", "fbold", "lx0", "lx1", "ly1", "lbold"]
    pages = _page_blocks(flat, fields).withColumn("edge", F.array_max(F.transform("bs", lambda b: b["wide"])))
    kind = ("array<struct<x0:double,y0:double,x1:double,y1:double,size:double,lx0:double,lx1:double,ly1:double,"
            "lbold:boolean,ids:array<int>>>")

    def add(paras, b):
        count = F.size(paras)
        recent = F.slice(paras, F.greatest(count - 5, F.lit(1)), F.lit(6))

        def joins(p):
            gap = b["fy0"] - p["ly1"]
            return ((F.abs(p["size"] - b["size"]) <= 0.6) & gap.between(p["size"] * -0.3, p["size"] * 0.7)
                    & (p["lx1"] >= F.col("edge") - p["size"] * 1.5) & ~b["item"] & (b["fx0"] >= F.bround(p["lx0"]) - 2.0)
                    & (p["lbold"] == b["fbold"]))

        back = F.array_position(F.reverse(F.transform(recent, joins)), F.lit(True))
        at = F.when(F.col("edge").isNotNull() & (back > 0), count - back + 1).otherwise(0)
        grown = F.transform(paras, lambda p, i: F.when(i + 1 == at, _struct(
            x0=F.least(p["x0"], b["rx"]), y0=F.least(p["y0"], b["y0"]), x1=F.greatest(p["x1"], b["x1"]),
            y1=F.greatest(p["y1"], b["y1"]), size=F.greatest(p["size"], b["size"]), lx0=b["lx0"], lx1=b["lx1"], ly1=b["ly1"],
            lbold=b["lbold"], ids=F.array_append(p["ids"], b["block"]))).otherwise(p))
        own = _struct(x0=b["rx"], y0=b["y0"], x1=b["x1"], y1=b["y1"], size=b["size"], lx0=b["lx0"], lx1=b["lx1"],
                      ly1=b["ly1"], lbold=b["lbold"], ids=F.array(b["block"]))
        return F.when(at > 0, grown).otherwise(F.array_append(paras, own))

    return pages.select("doc_id", "page", F.posexplode(F.aggregate("bs", F.array().cast(kind), add)).alias("para", "r")).select(
        "doc_id", "page", "para", F.col("r.ids").alias("blocks"), "r.x0", "r.y0", "r.x1", "r.y1", "r.size")


# ---------------------------------------------------------------- reading order

def reading_order(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, element, position): top to bottom, two-column pages column by column.

    A gutter is the first x, in steps of 3 pt between 30 % and 70 % of the width, that no narrow element
    crosses and that has two or more on both sides. Wide elements between the columns cut them into bands.
    """
    item = F.struct("element", "x0", "y0", "x1", "y1")
    page = by_page(elements).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("es")).join(
        pages.select("doc_id", "page", F.col("width").alias("w")), ["doc_id", "page"])
    narrow = F.filter("es", lambda e: e["x1"] - e["x0"] < F.col("w") * 0.55)
    xs = F.filter(F.sequence(F.floor(F.col("w") * 0.3).cast("int"), F.floor(F.col("w") * 0.7).cast("int"), F.lit(3)),
                  lambda x: x < F.floor(F.col("w") * 0.7))

    def splits(x):
        left = F.size(F.filter("narrow", lambda e: e["x1"] <= x))
        right = F.size(F.filter("narrow", lambda e: e["x0"] >= x))
        return (left >= 2) & (right >= 2) & (left + right == F.size("narrow"))

    found = page.withColumn("narrow", narrow).withColumn("g", F.when(
        (F.size("es") >= 3) & (F.size("narrow") >= 4), F.get(F.filter(xs, splits), F.lit(0))))
    g, w = F.col("g"), F.col("w")

    def is_wide(e):
        return (e["x1"] - e["x0"] >= w * 0.55) | ((e["x0"] < g) & (g < e["x1"]))

    def column(e):
        return F.when(is_wide(e), 2).when(e["x1"] <= g + 1, 0).otherwise(1)

    cols = F.filter("es", lambda e: ~is_wide(e))
    shaped = found.withColumns({
        "top": F.array_min(F.transform(cols, lambda e: e["y0"])), "bottom": F.array_max(F.transform(cols, lambda e: e["y1"])),
        "both": F.exists(cols, lambda e: column(e) == 0) & F.exists(cols, lambda e: column(e) == 1)})

    def between(e):
        return is_wide(e) & ~(e["y1"] <= F.col("top") + 2) & ~(e["y0"] >= F.col("bottom") - 2)

    cut = shaped.withColumn("cuts", F.array_sort(F.transform(F.filter("es", between), lambda e: _struct(
        y0=e["y0"], element=e["element"]))))

    def key(e):
        zero = F.lit(0)
        simple = _struct(a=zero, b=zero, c=zero, y=F.bround(e["y0"] / 3), x=e["x0"], n=e["element"])
        part = F.when(is_wide(e) & (e["y1"] <= F.col("top") + 2), 0).when(
            is_wide(e) & (e["y0"] >= F.col("bottom") - 2), 2).otherwise(1)
        own = _struct(y0=e["y0"], element=e["element"])
        band = F.when(part != 1, 0).when(is_wide(e), F.size(F.filter("cuts", lambda c: c < own))).otherwise(
            F.size(F.filter("cuts", lambda c: c["y0"] <= e["y0"])))
        columns = _struct(a=part, b=band, c=column(e), y=e["y0"], x=F.lit(0.0), n=e["element"])
        return F.when(g.isNotNull() & F.col("both"), columns).otherwise(simple)

    return cut.select("doc_id", "page", F.posexplode(F.array_sort(F.transform("es", key))).alias("position", "k")).select(
        "doc_id", "page", F.col("k.n").alias("element"), "position")


def block_order(blocks: DataFrame, cut: int | None = None) -> DataFrame:
    """Blocks as a screen reader takes them: native order, blank ones counted but left out; ``cut`` shortens the texts."""
    text = strip(F.col("b.text"))
    pages = by_page(blocks).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("bs"))
    return pages.select("doc_id", "page", F.posexplode("bs").alias("i", "b")).where(strip(F.col("b.text")) != "").select(
        "doc_id", "page", (F.col("i") + 1).alias("order"), (F.left(text, F.lit(cut)) if cut else text).alias("text"))


def merge_line_rects(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of single runs joined to one box per line where gaps stay below 0.9 of the height.

    ``rects`` is (keys, x0, y0, x1, y1), the boxes of one selection.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    sets = rects.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(mid.alias("m"), "x0", "y0", "x1", "y1"))).alias("rs"))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"

    def own(r):
        return _struct(x0=r["x0"], y0=r["y0"], x1=r["x1"], y1=r["y1"])

    def to_lines(lines, r):
        def fits(ln):
            shared = F.least(ln["y1"], r["y1"]) - F.greatest(ln["y0"], r["y0"])
            return (r["m"] > ln["y0"]) & (r["m"] < ln["y1"]) & (shared > F.least(ln["y1"] - ln["y0"], r["y1"] - r["y0"]) * 0.5)

        at = F.array_position(F.transform(lines, fits), F.lit(True))
        grown = F.transform(lines, lambda ln, i: F.when(i + 1 == at, _struct(
            y0=ln["y0"], y1=ln["y1"], rs=F.array_append(ln["rs"], own(r)))).otherwise(ln))
        return F.when(at > 0, grown).otherwise(F.array_append(lines, _struct(y0=r["y0"], y1=r["y1"], rs=F.array(own(r)))))

    def to_boxes(boxes, r):
        last = _last(boxes)
        near = r["x0"] - last["x1"] < (last["y1"] - last["y0"]) * 0.9
        grown = _struct(x0=last["x0"], y0=F.least(last["y0"], r["y0"]), x1=F.greatest(last["x1"], r["x1"]),
                        y1=F.greatest(last["y1"], r["y1"]))
        return F.when((F.size(boxes) > 0) & near, _replace_last(boxes, grown)).otherwise(F.array_append(boxes, own(r)))

    lines = F.aggregate("rs", F.array().cast(f"array<struct<y0:double,y1:double,rs:array<{box}>>>"), to_lines)
    merged = F.flatten(F.transform(lines, lambda ln: F.aggregate(F.array_sort(ln["rs"]), F.array().cast(f"array<{box}>"), to_boxes)))
    return sets.select(*keys, F.posexplode(merged).alias("part", "b")).select(*keys, "part", "b.*")



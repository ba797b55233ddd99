"""Review comments: threading, filters, sorting, quoting, reports, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.labels import (MANAGED_TYPES, TEXT_MARKUP, body_text, lookup, state_label, type_label,
                                         STATE_LABELS)
from folioframe.functions.text import csv_line, escape_markup, strip
from folioframe.operators.runs import text_under
from folioframe.operators.scale import first_per_key

# ---------------------------------------------------------------- threading


def thread_replies(annots: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold responses into the marks they answer; returns (marks, orphans).

    A response with a state sets the state of its parent (the last one wins, "none" clears it); the others
    become replies in order. A response whose parent is missing stays a comment of its own. The replies stay a
    table keyed by parent, so a mark with very many replies is never one row.
    """
    states = responses.where(F.coalesce("state", F.lit("")) != "").groupBy("doc_id", F.col("in_reply_to").alias("id")).agg(
        F.max_by("state", "seq").alias("_state"))
    counts = responses.where(F.coalesce("state", F.lit("")) == "").groupBy(
        "doc_id", F.col("in_reply_to").alias("id")).agg(F.count("*").alias("replies"))
    marks = (annots.join(states, ["doc_id", "id"], "left").join(counts, ["doc_id", "id"], "left")
             .withColumn("state", F.when(F.col("_state").isNull(), F.col("state"))
                         .when(F.col("_state") != "none", F.col("_state")))
             .withColumn("replies", F.coalesce("replies", F.lit(0))).drop("_state"))
    parents = annots.select("doc_id", F.col("id").alias("in_reply_to"))
    orphans = responses.join(parents, ["doc_id", "in_reply_to"], "left_anti")
    return marks, orphans


def replies_of(annots: DataFrame, responses: DataFrame) -> DataFrame:
    """The reply rows of existing marks, in order of ``seq``."""
    parents = annots.select("doc_id", F.col("id").alias("in_reply_to"))
    return responses.where(F.coalesce("state", F.lit("")) == "").join(parents, ["doc_id", "in_reply_to"], "left_semi")


def managed(annots: DataFrame) -> DataFrame:
    """Only the kinds of mark the model covers: no popups, links, widgets."""
    return annots.where(F.col("type").isin(MANAGED_TYPES))


def repair_ids(annots: DataFrame, order: list[str]) -> DataFrame:
    """Give blank and repeated names a new one; the first holder, across pages, keeps its name.

    The first holder comes from an aggregate per name (partial per task), not from a window, so a name that a
    third of all marks carry is no single group.
    """
    position = F.struct(*[F.col(c) for c in order])
    first = annots.where(F.coalesce("id", F.lit("")) != "").groupBy("doc_id", "id").agg(F.min(position).alias("_first"))
    fresh = F.concat(F.lit("ff-"), F.substring(F.sha2(F.concat_ws(":", "doc_id", *order), 256), 1, 12))
    return (annots.join(first, ["doc_id", "id"], "left")
            .withColumn("id", F.when(F.col("_first") == position, F.col("id")).otherwise(fresh)).drop("_first"))


# ---------------------------------------------------------------- filters, counts, order


def filter_comments(annots: DataFrame, *, checked: str = "all", state: str = "all", kind: str = "all",
                    author: str = "all", text: str = "") -> DataFrame:
    """The comment list filter. A kind that the data does not hold is ignored, like an unset filter."""
    out = annots
    if checked in ("checked", "unchecked"):
        out = out.where(F.coalesce("checked", F.lit(False)) == F.lit(checked == "checked"))
    if state == "none":
        out = out.where(F.coalesce("state", F.lit("")) == "")
    elif state != "all":
        out = out.where(F.col("state") == state)
    if kind != "all":
        out = out.where((F.col("type") == kind) | ~annots.where(F.col("type") == kind).exists())
    if author != "all":
        out = out.where(F.col("author") == author)
    if text:
        blank = F.lit("")
        words = F.concat_ws(" ", *[F.coalesce(c, blank) for c in ("text", "contents", "author", "subject")])
        out = out.where(F.contains(F.lower(words), F.lit(text.lower())))
    return out


def list_counts(annots: DataFrame, visible: DataFrame) -> DataFrame:
    """Visible and total marks, authors and kinds, per document."""
    totals = annots.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.countDistinct(F.when(F.col("author") != "", F.col("author"))).alias("authors"),
        F.countDistinct("type").alias("kinds"))
    shown = visible.groupBy("doc_id").agg(F.count("*").alias("visible"))
    return totals.join(shown, "doc_id", "left").withColumn("visible", F.coalesce("visible", F.lit(0)))


def report_order() -> list[Column]:
    return [F.col("page"), F.col("rect")[1], F.col("rect")[0]]


def comment_order(mode: str = "page") -> list[Column]:
    """Sort keys of the comment list; names in Japanese collation, ties by page and height."""
    by_page = [F.col("page"), F.col("rect")[1]]
    blank = F.lit("")
    keys = {"author": F.collate(F.coalesce("author", blank), "ja"), "type": F.collate(type_label(F.col("type")), "ja"),
            "state": F.coalesce("state", blank), "created": F.coalesce(F.col("created").cast("string"), blank)}
    return ([keys[mode]] if mode in keys else []) + by_page


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """Every row with its place in its list (``_rank``); with ``n`` only the first rows, as on a screen, cut before the shuffle."""
    if n:
        return first_per_key(df, keys, order, n)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# ---------------------------------------------------------------- the words under a mark


def quoted_text(annots: DataFrame, runs: DataFrame, centres: Column | None = None) -> DataFrame:
    """(doc_id, id, quote): the characters whose centre lies under each quad, pieces trimmed and joined by a space.

    ``runs`` and ``centres`` are those of ``runs.text_under``.
    """
    quads = (annots.where(F.col("type").isin(TEXT_MARKUP + ["redact"]))
             .select("doc_id", "page", "id", F.posexplode("quads").alias("quad", "q")).where(F.size("q") == 8))
    xs, ys = [F.col("q")[i] for i in (0, 2, 4, 6)], [F.col("q")[i] for i in (1, 3, 5, 7)]
    boxes = quads.select("doc_id", "page", "id", "quad", F.least(*xs).alias("bx0"), F.least(*ys).alias("by0"),
                         F.greatest(*xs).alias("bx1"), F.greatest(*ys).alias("by1"))
    pieces = text_under(runs, boxes, centres).groupBy("doc_id", "page", "id", "quad", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "t"))), lambda r: r["t"]), "").alias("t"))
    per_quad = pieces.groupBy("doc_id", "id", "quad").agg(strip(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "t"))), lambda r: r["t"]), "\n")).alias("t"))
    return per_quad.where(F.col("t") != "").groupBy("doc_id", "id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("quad", "t"))), lambda r: r["t"]), " ").alias("quote"))


# ---------------------------------------------------------------- reports as ordered lines
#
# A report is a table of lines with sort keys. Writing sorts ranges of it in parallel; no document is gathered
# into one row.


# Fixed values.
CSV_HEADER = ["ページ", "種類", "作成者", "主題", "状態", "チェック済", "本文", "対象テキスト", "返信数", "色", "作成日時",
              "x0", "y0", "x1", "y1"]


def _csv_values() -> list[Column]:
    blank = F.lit("")

    def rect(i):
        return F.round(F.coalesce(F.col("rect")[i], F.lit(0.0)), 1)

    return [
        (F.col("page") + 1).alias("ページ"), type_label(F.col("type")).alias("種類"),
        F.coalesce("author", blank).alias("作成者"), F.coalesce("subject", blank).alias("主題"),
        state_label(F.col("state")).alias("状態"), F.when(F.col("checked"), "✓").otherwise("").alias("チェック済"),
        body_text(F.col("text"), F.col("contents")).alias("本文"), F.coalesce("quote", blank).alias("対象テキスト"),
        F.coalesce("replies", F.lit(0)).alias("返信数"), F.coalesce("stroke", blank).alias("色"),
        F.coalesce(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), blank).alias("作成日時"),
        rect(0).alias("x0"), rect(1).alias("y0"), rect(2).alias("x1"), rect(3).alias("y1")]


def _numbered(annots: DataFrame) -> DataFrame:
    return annots.withColumn("_y", F.col("rect")[1]).withColumn("_x", F.col("rect")[0])


def markdown_lines(annots: DataFrame, replies: DataFrame, names: DataFrame, colour_tags: dict[str, str] | None = None,
                   ) -> DataFrame:
    """The Markdown report as (doc_id, page, y, x, id, part, pos, line): sorted, the lines are the file.

    ``names`` is (doc_id, name). Parts: 0 title, 1 page heading, 2 the mark, 3 its replies, 4 the closing blank.
    """
    marks = _numbered(annots)
    blank = F.lit("")
    total = marks.groupBy("doc_id").agg(F.count("*").alias("n"))
    low = F.lit(float("-inf"))
    title = total.join(names, "doc_id").select(
        "doc_id", F.lit(-1).alias("page"), low.alias("_y"), low.alias("_x"), blank.alias("id"), F.lit(0).alias("part"),
        F.posexplode(F.array(F.concat(F.lit("# "), "name"), blank,
                             F.concat(F.lit("注釈 "), F.col("n").cast("string"), F.lit(" 件")), blank)).alias("pos", "line"))
    pages = marks.select("doc_id", "page").distinct().select(
        "doc_id", "page", low.alias("_y"), low.alias("_x"), blank.alias("id"), F.lit(1).alias("part"),
        F.posexplode(F.array(blank, F.concat(F.lit("## "), (F.col("page") + 1).cast("string"), F.lit(" ページ")),
                             blank)).alias("pos", "line"))
    tag = lookup(colour_tags, F.lower("stroke")) if colour_tags else F.lit(None).cast("string")
    filled = F.coalesce("author", blank) != ""
    state = F.coalesce(lookup(STATE_LABELS, F.col("state")), F.col("state"))
    head = F.concat_ws(" · ", type_label(F.col("type")), F.when(filled, F.col("author")),
                       F.when(tag != "", F.concat(F.lit("#"), tag)),
                       F.when(F.coalesce("state", blank) != "", F.concat(F.lit("［"), state, F.lit("］"))))
    body, quote = body_text(F.col("text"), F.col("contents")), F.coalesce("quote", blank)
    none = F.array().cast("array<string>")
    text = F.concat(
        F.array(F.concat(F.lit("**"), head, F.lit("**"))),
        F.when(quote != "", F.concat(F.array(blank), F.transform(F.split(quote, "\n"), lambda r: F.concat(F.lit("> "), r))))
        .otherwise(none),
        F.when(body != "", F.array(blank, body)).otherwise(none))
    mark = marks.select("doc_id", "page", "_y", "_x", "id", F.lit(2).alias("part"), F.posexplode(text).alias("pos", "line"))
    end = marks.select("doc_id", "page", "_y", "_x", "id", F.lit(4).alias("part"), F.lit(0).alias("pos"), blank.alias("line"))
    who = F.when(F.coalesce(F.col("r.author"), blank) != "", F.col("r.author")).otherwise("返信")
    said = F.concat(F.lit("- **"), who, F.lit("**: "), F.coalesce(F.col("r.contents"), blank))
    answers = (marks.alias("m").join(replies.alias("r"), (F.col("m.doc_id") == F.col("r.doc_id"))
                                     & (F.col("m.id") == F.col("r.in_reply_to")))
               .select("m.doc_id", "m.page", "m._y", "m._x", "m.id", F.lit(3).alias("part"), "r.seq",
                       F.posexplode(F.array(blank, said)).alias("k", "line"))
               .select("doc_id", "page", "_y", "_x", "id", "part", (F.col("seq") * 2 + F.col("k")).alias("pos"), "line"))
    return title.unionByName(pages).unionByName(mark).unionByName(answers).unionByName(end)


def summary_lines(annots: DataFrame, replies: DataFrame, names: DataFrame) -> DataFrame:
    """The comment summary as HTML, in the same line form as the Markdown report."""
    marks = _numbered(annots)
    blank, low = F.lit(""), F.lit(float("-inf"))
    total = marks.groupBy("doc_id").agg(F.count("*").alias("n"))
    title = total.join(names, "doc_id").select(
        "doc_id", F.lit(-1).alias("page"), low.alias("_y"), low.alias("_x"), blank.alias("id"), F.lit(0).alias("part"),
        F.lit(0).alias("pos"),
        F.concat(F.lit("<h1>注釈一覧</h1><div class='meta'>"), escape_markup(F.col("name")), F.lit(" — "),
                 F.col("n").cast("string"), F.lit(" 件</div>")).alias("line"))
    pages = marks.select("doc_id", "page").distinct().select(
        "doc_id", "page", low.alias("_y"), low.alias("_x"), blank.alias("id"), F.lit(1).alias("part"), F.lit(0).alias("pos"),
        F.concat(F.lit("<h2>"), (F.col("page") + 1).cast("string"), F.lit(" ページ</h2>")).alias("line"))

    def tag(name, value):
        return F.when(value != "", F.concat(F.lit(f"<{name}>"), escape_markup(value),
                                            F.lit(f"</{name.split(' ')[0]}>"))).otherwise(blank)

    head = F.concat_ws(" · ", type_label(F.col("type")),
                       F.when(F.coalesce("author", blank) != "", escape_markup(F.col("author"))),
                       F.when(F.coalesce("state", blank) != "",
                              F.coalesce(lookup(STATE_LABELS, F.col("state")), F.col("state"))),
                       F.when(F.col("checked"), "✓"))
    open_item = F.concat(F.lit("<div class='item' style='border-left-color:"),
                         escape_markup(F.coalesce("stroke", F.lit("#cccccc"))), F.lit("'><div class='head'>"), head,
                         F.lit("</div>"), tag("blockquote", F.coalesce("quote", blank)),
                         tag("div class='body'", body_text(F.col("text"), F.col("contents"))))
    mark = marks.select("doc_id", "page", "_y", "_x", "id", F.lit(2).alias("part"), F.lit(0).alias("pos"),
                        open_item.alias("line"))
    end = marks.select("doc_id", "page", "_y", "_x", "id", F.lit(4).alias("part"), F.lit(0).alias("pos"),
                       F.lit("</div>").alias("line"))
    who = F.when(F.coalesce(F.col("r.author"), blank) != "", F.col("r.author")).otherwise("返信")
    answers = (marks.alias("m").join(replies.alias("r"), (F.col("m.doc_id") == F.col("r.doc_id"))
                                     & (F.col("m.id") == F.col("r.in_reply_to")))
               .select("m.doc_id", "m.page", "m._y", "m._x", "m.id", F.lit(3).alias("part"), F.col("r.seq").alias("pos"),
                       F.concat(F.lit("<div class='reply'>↳ <b>"), escape_markup(who), F.lit("</b>: "),
                                escape_markup(F.coalesce(F.col("r.contents"), blank)), F.lit("</div>")).alias("line")))
    return title.unionByName(pages).unionByName(mark).unionByName(answers).unionByName(end)


def csv_lines(annots: DataFrame) -> DataFrame:
    """The comment CSV: a header per document and one line per mark, with the keys to sort by."""
    zero, blank = F.lit(0.0), F.lit("")
    part, pos = F.lit(0).alias("part"), F.lit(0).alias("pos")
    head = annots.select("doc_id").distinct().select(
        "doc_id", F.lit(-1).alias("page"), zero.alias("_y"), zero.alias("_x"), blank.alias("id"), part, pos,
        F.lit(",".join(CSV_HEADER)).alias("line"))
    return head.unionByName(_numbered(annots).select(
        "doc_id", "page", "_y", "_x", "id", part, pos, csv_line(*_csv_values()).alias("line")))


# ---------------------------------------------------------------- change detection

VOLATILE = ["modified", "created", "createdPdf", "xref", "image", "layout"]


def canonical(columns: list[str], numbers: list[str]) -> Column:
    """A comparable form of a mark: keys in order, numbers to two places, volatile columns left out."""
    kept = sorted(c for c in columns if c not in VOLATILE and not c.startswith("_"))
    return F.to_json(F.struct(*[
        (F.format_string("%.2f", F.round(F.col(c), 2) + F.lit(0.0)) if c in numbers else F.col(c)).alias(c) for c in kept]))


def baseline_diff(base: DataFrame, wanted: DataFrame, form: str = "form") -> DataFrame:
    """Per (doc_id, id): insert, update, delete, move (pictures change in place) or unchanged.

    Both sides carry type and a canonical ``form``; only its 64-bit hash and length travel with the keys.
    """
    def keyed(df, side):
        return df.select("doc_id", "id", F.col("type").alias(f"{side}_type"), F.xxhash64(form).alias(f"{side}_hash"),
                         F.length(form).alias(f"{side}_size"))

    both = keyed(base, "b").join(keyed(wanted, "w"), ["doc_id", "id"], "full")
    same = (F.col("b_hash") == F.col("w_hash")) & (F.col("b_size") == F.col("w_size"))
    action = (F.when(F.col("b_hash").isNull(), "insert").when(F.col("w_hash").isNull(), "delete")
              .when(same, "unchanged").when(F.col("w_type") == "image", "move").otherwise("update"))
    return both.select("doc_id", "id", action.alias("action"))


def draft_offers(drafts: DataFrame, current: DataFrame) -> DataFrame:
    """Drafts worth offering: same page count, some marks, other content once volatile columns are dropped.

    Both sides are (doc_id, page_count, id, form); contents compare as counts and sums of row hashes, so no
    document is gathered.
    """
    def prints(df):
        h = F.xxhash64("id", "form")
        return df.groupBy("doc_id").agg(F.max("page_count").alias("page_count"), F.count("id").alias("n"),
                                        F.bit_xor(h).alias("x"),
                                        F.sum(F.pmod(h, F.lit(2147483647))).alias("s"))

    d, c = prints(drafts).alias("d"), prints(current).alias("c")
    differs = (F.col("d.n") != F.col("c.n")) | ~F.col("d.x").eqNullSafe(F.col("c.x")) | ~F.col("d.s").eqNullSafe(F.col("c.s"))
    return d.join(c, "doc_id").where((F.col("d.n") > 0) & (F.col("d.page_count") == F.col("c.page_count")) & differs).select(
        "doc_id", F.col("d.n").alias("draft_marks"), F.col("c.n").alias("marks"))


def rebind(engine: DataFrame, mine: DataFrame) -> DataFrame:
    """The marks of the file whose id is not among mine, then mine."""
    return engine.join(mine.select("doc_id", "id"), ["doc_id", "id"], "left_anti").unionByName(mine)


def remove_marks(marks: DataFrame, kinds: list[str] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Take out marks by kind, on all pages or on those of a (doc_id, page) table."""
    doomed = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    if pages is None:
        return marks.where(~doomed)
    return marks.join(pages.withColumn("_hit", F.lit(True)), ["doc_id", "page"], "left").where(
        ~(doomed & F.coalesce("_hit", F.lit(False)))).drop("_hit")


def count_stamps(marks: DataFrame) -> DataFrame:
    """Pages that carry each kind of stamp, per document; a kind counts once per page."""
    return marks.select("doc_id", "kind", "page").distinct().groupBy("doc_id", "kind").agg(F.count("*").alias("pages"))


def apply_patch(target: Column, patch: Column, nested: list[str]) -> Column:
    """Deep patch of maps: nested maps merge key by key, everything else is replaced. Both sides are
    map<string, map<string, string>> for ``nested`` groups; later keys win."""
    return F.map_zip_with(target, patch, lambda k, a, b: F.when(
        a.isNotNull() & b.isNotNull() & k.isin(nested),
        F.map_zip_with(a, b, lambda _k, x, y: F.coalesce(y, x))).otherwise(F.coalesce(b, a)))

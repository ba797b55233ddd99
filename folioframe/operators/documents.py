"""Whole-document facts: statistics, text export, metadata, permissions, accessibility, outline repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import strip, tokens, without_space
from folioframe.operators.scale import running

# Permission bits of a file and the words for each use.
PERMISSION_BITS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "form": 256, "accessibility": 512,
                   "assemble": 1024, "printHQ": 2048}
PERMISSION_LABELS = [("modify", "内容の変更"), ("annotate", "注釈・書き込み"), ("form", "フォームへの入力"),
                     ("assemble", "ページの追加・削除・並べ替え"), ("copy", "文字のコピー"), ("print", "印刷")]


def statistics(texts: DataFrame) -> DataFrame:
    """(doc_id, page, text) to pages, characters without blanks, words, pages without text, bytes.

    A word is a run between blanks that holds an ASCII letter or digit. Pages are measured where they lie; only
    numbers are shuffled.
    """
    measured = texts.select("doc_id", F.length(without_space(F.col("text"))).alias("c"), F.octet_length("text").alias("b"),
                            F.size(F.filter(tokens(F.col("text")), lambda w: w.rlike("[A-Za-z0-9]"))).alias("w"))
    return measured.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("c").alias("characters"), F.sum("w").alias("words"),
        F.count_if(F.col("c") == 0).alias("pages_without_text"), F.sum("b").alias("bytes"))


def text_export(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The plain-text export as rows (doc_id, page, line, text): a banner, the lines, a blank line per page.

    Sorted by the first three columns the rows are the file; nothing is gathered per document.
    """
    key = pages.select("doc_id", "page")
    banner = F.concat(F.lit("===== "), (F.col("page") + 1).cast("string"), F.lit(" ページ ====="))
    return (key.select("doc_id", "page", F.lit(-2).alias("line"), banner.alias("text"))
            .unionByName(lines.select("doc_id", "page", "line", "text"))
            .unionByName(key.select("doc_id", "page", F.lit(1000000).alias("line"), F.lit("").alias("text"))))


def describe(docs: DataFrame, pages: DataFrame, annots: DataFrame, toc: DataFrame) -> DataFrame:
    """One row per document: its facts with the number of pages, marks and outline entries."""
    def counted(df, name):
        return df.groupBy("doc_id").agg(F.count("*").alias(name))

    out = docs
    for df, name in ((pages, "page_count"), (annots, "annot_count"), (toc, "toc_count")):
        out = out.join(counted(df, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def restrictions(bits: Column) -> Column:
    """Labels of the uses a file does not allow."""
    uses = F.array(*[F.struct(F.lit(PERMISSION_BITS[k]).alias("bit"), F.lit(v).alias("label")) for k, v in PERMISSION_LABELS])
    return F.transform(F.filter(uses, lambda u: bits.bitwiseAND(u["bit"]) == 0), lambda u: u["label"])


def permission_bits(allowed: dict[str, Column]) -> Column:
    """The bits to write; a use not mentioned is allowed."""
    total = F.lit(0)
    for name, bit in PERMISSION_BITS.items():
        given = F.coalesce(allowed[name], F.lit(True)) if name in allowed else F.lit(True)
        total = total.bitwiseOR(F.when(given, bit).otherwise(0))
    return total


METADATA = ["title", "author", "subject", "keywords"]


def set_metadata(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the keys that (doc_id, title, author, …) names; a null column there leaves the value as it is."""
    named = [c for c in METADATA if c in changes.columns]
    new = changes.select("doc_id", *[F.col(c).alias(f"_{c}") for c in named])
    return docs.join(new, "doc_id", "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in named}).drop(*[f"_{c}" for c in named])


def scrub(docs: DataFrame, *, metadata: bool = True, xml_metadata: bool = True) -> DataFrame:
    """Blank the chosen groups of document facts."""
    blank = {c: F.lit("") for c in METADATA if metadata and c in docs.columns}
    if xml_metadata and "xml_metadata" in docs.columns:
        blank["xml_metadata"] = F.lit("")
    return docs.withColumns(blank) if blank else docs


def scrub_links(links: DataFrame, remove: bool = False) -> DataFrame:
    return links.where(F.lit(False)) if remove else links


def scrub_fields(fields: DataFrame, reset: bool = False) -> DataFrame:
    return fields.withColumn("value", F.lit(None).cast("string")) if reset else fields


def alt_inventory(images: DataFrame) -> DataFrame:
    """One row per placed picture, with the text that stands for it."""
    return images.select("doc_id", "page", "seq", "xref", "x0", "y0", "x1", "y1", "alt",
                         (F.coalesce("alt", F.lit("")) == "").alias("missing"))


def set_alt(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Give pictures their text by (doc_id, xref); every placement of the picture gets it."""
    new = texts.select("doc_id", "xref", F.col("alt").alias("_alt"))
    return images.join(new, ["doc_id", "xref"], "left").withColumn("alt", F.coalesce("_alt", "alt")).drop("_alt")


def picture_pages(page_texts: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page): the pages with pictures and no text. ``page_texts`` is (doc_id, page, chars)."""
    return (images.select("doc_id", "page").distinct()
            .join(page_texts.where(F.col("chars") > 0).select("doc_id", "page"), ["doc_id", "page"], "left_anti"))


def audit(docs: DataFrame, page_texts: DataFrame, images: DataFrame) -> DataFrame:
    """Accessibility findings per document: ``issues`` in report order, counts, and whether it passed.

    ``scanned_pages`` are all pages without text, from one, null where there are none; ``picture_pages`` gives them as rows.
    """
    pictures = images.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if(
        F.coalesce("alt", F.lit("")) == "").alias("without_alt"))
    count = picture_pages(page_texts, images).groupBy("doc_id").agg(
        F.count("*").alias("scanned"), F.array_sort(F.collect_list(F.col("page") + 1)).alias("scanned_pages"))
    facts = docs.join(pictures, "doc_id", "left").join(count, "doc_id", "left").withColumns({
        "images": F.coalesce("images", F.lit(0)), "without_alt": F.coalesce("without_alt", F.lit(0)),
        "scanned": F.coalesce("scanned", F.lit(0))})

    def issue(cond, name, severity, title):
        return F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"), title.alias("title")))

    issues = F.array_compact(F.array(
        issue(~F.coalesce("tagged", F.lit(False)), "tags", "high", F.lit("タグ（論理構造）がありません")),
        issue(F.coalesce("lang", F.lit("")) == "", "lang", "medium", F.lit("文書の言語が指定されていません")),
        issue(F.col("without_alt") > 0, "alt", "high", F.concat(
            F.lit("代替テキストのない画像が "), F.col("without_alt").cast("string"), F.lit(" 個あります"))),
        issue(F.col("scanned") > 0, "scanned", "high", F.concat(
            F.lit("テキストのない画像ページが "), F.col("scanned").cast("string"), F.lit(" ページあります"))),
        issue(strip(F.coalesce("title", F.lit(""))) == "", "title", "low", F.lit("文書のタイトルが設定されていません"))))
    return facts.select("doc_id", "images", "without_alt", "scanned", "scanned_pages", issues.alias("issues")).withColumn(
        "passed", F.size("issues") == 0)


def repair_outline(toc: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Levels step down one at a time, pages stay inside the document.

    The walk "level = min(level, previous + 1)" has a closed form: the running minimum of (level − position),
    plus the position, never more than position + 1. So a running minimum does it, chunk by chunk.
    """
    clean = toc.withColumn("_l", F.greatest(F.lit(1), F.col("level")))
    ranked = running(clean, ["doc_id"], "seq", {"_k": ("sum", F.lit(1))}).withColumn("_k", F.col("_k") - 1)
    low = running(ranked.withColumn("_d", F.col("_l") - F.col("_k")), ["doc_id"], "seq", {"_m": ("min", F.col("_d"))})
    level = F.least(F.col("_k") + 1, F.col("_m") + F.col("_k"))
    return low.join(page_counts, "doc_id").select(
        "doc_id", "seq", level.cast("int").alias("level"), "title",
        F.greatest(F.lit(1), F.least(F.col("pages"), F.col("page"))).cast("int").alias("page"))

"""Personal data in text lines: detection with check digits, boxes, redaction marks and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.checks import luhn_ok, my_number_ok, phone_ok
from folioframe.functions.text import find_all, fold_width, let, pieces_at, scan
from folioframe.operators.scale import points_in_boxes

# What each kind looks like after folding. \p{Nd} also takes digits outside ASCII.
_D = r"\p{Nd}"
_NO_BEFORE, _NO_AFTER = r"(?<![\p{Nd}-])", r"(?![\p{Nd}-])"
PATTERNS = {
    "card": rf"{_NO_BEFORE}(?:{_D}{{4}}[- ]?){{3}}{_D}{{1,4}}{_NO_AFTER}",
    "mynumber": rf"{_NO_BEFORE}{_D}{{4}}[- ]?{_D}{{4}}[- ]?{_D}{{4}}{_NO_AFTER}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "postal": rf"(?:〒(?U:\s)?)?{_NO_BEFORE}{_D}{{3}}-{_D}{{4}}{_NO_AFTER}",
    "phone": rf"{_NO_BEFORE}(?:\+81[- ]?|\(?0){_D}{{1,4}}(?:[- ]|\)|-?\()?{_D}{{1,4}}(?:[- ]|\))?{_D}{{3,4}}{_NO_AFTER}",
}
LABELS = {"email": "メールアドレス", "phone": "電話番号", "postal": "郵便番号", "mynumber": "マイナンバー",
          "card": "クレジットカード番号"}


def find_personal_info(lines: DataFrame, keys: list[str], kinds: list[str] | None = None) -> DataFrame:
    """One row per hit in a text line: keys, kind, label, start, end, text (as written, not folded).

    The gate in front (an @, or three digits in a row with an optional sign between) keeps the patterns away
    from lines that cannot match.
    """
    wanted = [k for k in PATTERNS if kinds is None or k in kinds]
    label = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])
    folded = lines.select(*keys, F.col("text").alias("_raw"), fold_width(F.col("text")).alias("_text"))
    gated = folded.where(F.col("_text").rlike(r"@|\p{Nd}{3}|\+81"))

    def tagged(kind):
        return F.transform(find_all(F.col("_text"), PATTERNS[kind]), lambda h: F.struct(
            F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value")))

    def trusted(h):
        return F.when(h["kind"] == "card", luhn_ok(h["value"])).when(h["kind"] == "mynumber", my_number_ok(h["value"])
                      ).when(h["kind"] == "phone", phone_ok(h["value"])).otherwise(F.lit(True))

    found = gated.select(*keys, "_raw", *[F.filter(tagged(k), trusted).alias(f"_{k}") for k in wanted])
    found = found.withColumn("_taken", F.col(f"_{wanted[0]}"))
    for kind in wanted[1:]:  # in order of trust: of two that overlap the first stays
        found = found.withColumn("_taken", F.when(F.size("_taken") == 0, F.col(f"_{kind}")).when(F.size(f"_{kind}") == 0, F.col("_taken")).otherwise(
            F.concat("_taken", free_of(F.col(f"_{kind}"), F.col("_taken")))))
    texts = F.zip_with("_taken", pieces_at(F.col("_raw"), F.col("_taken")), lambda h, text: F.struct(
        h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end"), text.alias("text")))
    return (found.select(*keys, F.explode(texts).alias("hit"))
            .select(*keys, "hit.kind", label[F.col("hit.kind")].alias("label"), "hit.start", "hit.end", "hit.text"))


def free_of(hits: Column, taken: Column) -> Column:
    """The hits that overlap none of ``taken``; both are arrays of disjoint struct(..., start, end). All are sorted by their
    start once; the farthest end before a hit and the nearest start after it tell whether it is free."""
    def judged(both):
        ends = scan(both, F.lit(-1), lambda most, x: F.when(x["held"], F.greatest(most, x["h"]["end"])).otherwise(most))
        starts = F.reverse(scan(F.reverse(both), F.lit(2**31 - 1), lambda least, x: F.when(x["held"], F.least(least, x["h"]["start"])).otherwise(least)))
        rows = F.arrays_zip(both.alias("x"), ends.alias("before"), starts.alias("after"))
        free = F.filter(rows, lambda r: ~r["x"]["held"] & (r["before"] <= r["x"]["h"]["start"]) & (r["after"] >= r["x"]["h"]["end"]))
        return F.transform(free, lambda r: r["x"]["h"])

    def marked(items, held):
        return F.transform(items, lambda h: F.struct(h["start"].alias("at"), F.lit(held).alias("held"), h.alias("h")))

    return let(F.array_sort(F.concat(marked(hits, False), marked(taken, True))), judged)


def hit_boxes(hits: DataFrame, chars: DataFrame, line_keys: list[str]) -> DataFrame:
    """The box around the characters of every hit; characters without extent add nothing, empty boxes are dropped."""
    solid = chars.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    h, c = hits.alias("h"), solid.alias("c")
    on = (F.col("c.seq") >= F.col("h.start")) & (F.col("c.seq") < F.col("h.end"))
    for key in line_keys:
        on = on & (F.col(f"h.{key}") == F.col(f"c.{key}"))
    return (h.join(c, on).groupBy(*[F.col(f"h.{k}") for k in hits.columns])
            .agg(F.min("c.x0").alias("x0"), F.min("c.y0").alias("y0"), F.max("c.x1").alias("x1"),
                 F.max("c.y1").alias("y1")))


def redaction_marks(items: DataFrame, pages: DataFrame, pad: float = 0.5, overlay: str = "") -> DataFrame:
    """Boxes as redaction marks; boxes on pages that do not exist and empty boxes are left out."""
    return (items.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
            .join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
            .select("doc_id", "page", F.lit("redact").alias("type"),
                    (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"),
                    (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"),
                    F.lit(overlay).alias("overlay")))


def apply_redactions(chars: DataFrame, marks: DataFrame) -> DataFrame:
    """Drop the characters whose centre lies under a mark."""
    boxes = marks.selectExpr("doc_id", "page", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1")
    centred = chars.withColumns({"_cx": (F.col("x0") + F.col("x1")) / 2, "_cy": (F.col("y0") + F.col("y1")) / 2})
    inside = (F.col("p._cx") >= F.col("b.bx0")) & (F.col("p._cx") < F.col("b.bx1")) & \
             (F.col("p._cy") >= F.col("b.by0")) & (F.col("p._cy") < F.col("b.by1"))
    return points_in_boxes(centred, boxes, ["doc_id", "page"], "_cx", "_cy", inside, "left_anti").drop("_cx", "_cy")


def line_texts(chars: DataFrame) -> DataFrame:
    """Lines of text rebuilt from their characters (one visual line to a group)."""
    return chars.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda r: r["c"]), "").alias("text"))


def redaction_report(annots: DataFrame) -> DataFrame:
    """Marks applied and pages touched, per document."""
    return (annots.where(F.col("type") == "redact").groupBy("doc_id", "page").agg(F.count("*").alias("n"))
            .groupBy("doc_id").agg(F.sum("n").alias("applied"), F.count("*").alias("pages")))

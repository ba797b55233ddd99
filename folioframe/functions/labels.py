"""Fixed names of kinds, states and uses, and the short texts built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TYPE_LABELS = {
    "highlight": "ハイライト", "underline": "下線", "squiggly": "波線", "strikeout": "取消線",
    "areaHighlight": "範囲塗り", "freetext": "テキスト", "note": "付箋", "line": "線", "square": "矩形",
    "circle": "円", "polygon": "多角形", "polyline": "折れ線", "ink": "手書き", "stamp": "スタンプ",
    "redact": "墨消し", "caret": "挿入",
}
STATE_LABELS = {"accepted": "承諾", "rejected": "却下", "completed": "完了", "cancelled": "取り消し"}
STATE_NAMES = {"accepted": "Accepted", "rejected": "Rejected", "completed": "Completed", "cancelled": "Cancelled",
               "none": "None"}
MANAGED_TYPES = ["note", "freetext", "line", "square", "circle", "polygon", "polyline", "highlight", "underline",
                 "squiggly", "strikeout", "stamp", "caret", "ink", "redact"]
TEXT_MARKUP = ["highlight", "underline", "squiggly", "strikeout"]
MEASURE_LABELS = {"distance": "距離", "perimeter": "周囲長", "area": "面積", "angle": "角度", "radius": "半径",
                  "volume": "体積", "count": "カウント"}
AREA_UNITS = {"mm": "mm²", "cm": "cm²", "m": "m²", "in": "in²", "ft": "ft²", "pt": "pt²"}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key]


def type_label(kind: Column) -> Column:
    return F.coalesce(lookup(TYPE_LABELS, kind), kind, F.lit(""))


def state_label(state: Column) -> Column:
    return F.coalesce(lookup(STATE_LABELS, state), F.lit(""))


def body_text(text: Column, contents: Column) -> Column:
    """A mark's own words: its text, then its contents where they differ."""
    own, said = F.coalesce(text, F.lit("")), F.coalesce(contents, F.lit(""))
    return F.when(own == "", said).when((said == "") | (said == own), own).otherwise(F.concat(own, F.lit("\n"), said))


def comment_summary(kind: Column, text: Column, contents: Column, subject: Column) -> Column:
    def filled(c):
        return F.coalesce(c, F.lit("")) != ""

    return (F.when(kind == "freetext", F.when(filled(text), text).otherwise("（空のテキスト）"))
            .when(filled(contents), contents)
            .when(filled(subject), F.concat(F.lit("「"), subject, F.lit("」")))
            .otherwise("（コメントなし）"))


def measure_unit(kind: Column, unit: Column) -> Column:
    plain = F.coalesce(unit, F.lit(""))
    return (F.when(kind == "count", "").when(kind == "angle", "°")
            .when(kind == "area", F.coalesce(lookup(AREA_UNITS, plain), F.concat(plain, F.lit("²"))))
            .when(kind == "volume", F.concat(plain, F.lit("³"))).otherwise(plain))

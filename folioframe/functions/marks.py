"""Colours, file dates and font names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_rgb(text: Column) -> Column:
    """"#RRGGBB" to array(r, g, b) between 0 and 1."""
    plain = F.ltrim(text, F.lit("#"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(*[
        F.conv(F.substring(plain, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5)]))


def rgb_to_hex(parts: Column) -> Column:
    """Grey (1), RGB (3) or CMYK (4) parts to "#rrggbb"; empty gives null."""
    def byte(v):
        return F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v * 255).cast("int")))), 2, "0"))

    def code(a, b, c):
        return F.concat(F.lit("#"), byte(a), byte(b), byte(c))

    p = [F.get(parts, F.lit(i)) for i in range(4)]
    cmyk = [(1 - p[i]) * (1 - p[3]) for i in range(3)]
    return (F.when(F.size(parts) == 1, code(p[0], p[0], p[0])).when(F.size(parts) == 4, code(*cmyk))
            .when(F.size(parts) >= 3, code(*p[:3])))


def packed_to_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.bitwiseAND(0xFFFFFF)), 6, "0")


def grey(rgb: Column) -> Column:
    """One grey part by the usual weights of light."""
    return rgb[0] * 0.3 + rgb[1] * 0.59 + rgb[2] * 0.11


def pdf_date(text: Column) -> Column:
    """"D:YYYYMMDDHHmmSS…" as a timestamp without zone; the offset is dropped, missing parts are zero."""
    digits = F.regexp_extract(F.regexp_replace(text, "^D:", ""), "^[0-9]*", 0)
    padded = F.left(F.rpad(digits, 14, "0"), F.lit(14))
    return F.when(F.length(digits) >= 8, F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


# Fixed values, in order of precedence: what a file calls a font and what an office program calls it.
FONTS = [
    (r"ms[-_]?p?mincho|ＭＳ.*明朝|msmincho", "ＭＳ Ｐ明朝"), (r"ms[-_]?p?gothic|ＭＳ.*ゴシック|msgothic", "ＭＳ Ｐゴシック"),
    (r"yugothic|游ゴシック|yu?gothic", "游ゴシック"), (r"yumincho|游明朝|yu?mincho", "游明朝"), (r"meiryo|メイリオ", "メイリオ"),
    (r"biz?ud?p?gothic|bizudpgothic", "BIZ UDPゴシック"), (r"biz?ud?p?mincho|bizudpmincho", "BIZ UDP明朝"),
    (r"hiragino.*(kaku|gothic)|ヒラギノ角", "ヒラギノ角ゴ ProN"), (r"hiragino.*(min|mincho)|ヒラギノ明朝", "ヒラギノ明朝 ProN"),
    (r"heiseimin|ipamincho|ipa?p?mincho|mincho|serif.*jp|notoserifcjk|notoserifjp|min(?:-|$)|明朝", "游明朝"),
    (r"gothic|notosans.*(cjk|jp)|sourcehansans|kozgo|goshic|kaku|ゴシック|sans.*jp|ipagothic|ipa?p?gothic", "游ゴシック"),
    (r"timesnewroman|times", "Times New Roman"), (r"arial|helvetica", "Arial"), (r"calibri", "Calibri"),
    (r"cambria", "Cambria"), (r"century", "Century"), (r"courier", "Courier New"), (r"consolas", "Consolas"),
    (r"verdana", "Verdana"), (r"tahoma", "Tahoma"), (r"georgia", "Georgia"), (r"segoe", "Segoe UI"),
    (r"symbol", "Symbol"), (r"wingdings", "Wingdings"),
]


def clean_font(name: Column) -> Column:
    """The name without its subset tag."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def office_font(name: Column) -> Column:
    """A font name an office program knows; unknown names are split at their capitals."""
    raw = clean_font(name)
    low = F.replace(F.lower(raw), F.lit(" "), F.lit(""))
    tidy = F.regexp_replace(F.get(F.split(raw, "[-,]"), F.lit(0)), "(?<=[a-z])(?=[A-Z])", " ")
    out = F.when(tidy == "", "游ゴシック").otherwise(tidy)
    for pattern, label in reversed(FONTS):
        out = F.when(low.rlike(pattern), label).otherwise(out)
    return out

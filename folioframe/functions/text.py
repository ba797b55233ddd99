"""Text as column expressions: folding, masking, positions, joining of lines, escaping."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width signs folded one to one, so that positions stay the same.
FOLD_FROM = "０１２３４５６７８９＠．－―‐ー−（）＋　"
FOLD_TO = "0123456789@.-----()+ "

# Every decimal digit of Unicode, and its value as an ASCII digit.
_DECIMALS = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.decimal(c, None) is not None]
_DECIMAL_FROM = "".join(_DECIMALS)
_DECIMAL_TO = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)

CJK = r"[\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]"
# Fixed value: how a list item may start.
BULLET = (r"^(?:[・•●○▪■◆◇★☆※\-–—‣◦▶▷]|[（(]?\p{Nd}+[\.\)）．、]|[①-⑳]"
          r"|[（(][0-9a-zA-Zぁ-んァ-ン一-龥０-９]+[）)])")
BULLET_OR_ROMAN = BULLET[:-1] + r"|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][\.．、]?)"
# What str.split() and str.strip() take as white space.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def fold_width(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def digits_of(text: Column) -> Column:
    """The decimal digits of a text, in ASCII."""
    return F.translate(F.regexp_replace(text, r"\P{Nd}", ""), _DECIMAL_FROM, _DECIMAL_TO)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_space(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, start: Column, step, piece: int = 256) -> Column:
    """The states after each item, in order. Items are taken in pieces, since an array that grows by one is copied each time."""
    def append(acc, item):
        return let(step(acc["now"], item), lambda now: F.struct(now.alias("now"), F.array_append(acc["out"], now).alias("out")))

    def empty(state, of):
        return F.struct(state.alias("now"), F.filter(F.array(of), lambda _: F.lit(False)).alias("out"))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / piece).cast("int")),
                         lambda i: F.slice(items, i * piece + 1, piece))
    none = F.filter(F.array(start), lambda _: F.lit(False))
    whole = F.aggregate(pieces, empty(start, none), lambda acc, held: let(
        F.aggregate(held, empty(acc["now"], start), append),
        lambda part: F.struct(part["now"].alias("now"), F.array_append(acc["out"], part["out"]).alias("out"))))
    return F.when(F.size(items) > 0, F.flatten(whole["out"])).otherwise(none)


def find_all(text: Column, pattern: str) -> Column:
    """Every match as struct(start, end, value): matches from extraction, offsets from the pieces between them."""
    gaps = F.split(text, pattern, -1)

    def placed(matches):
        ends = scan(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m)), F.lit(0),
                    lambda at, size: at + size)
        return F.zip_with(ends, matches, lambda end, value: F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def pieces_at(text: Column, places: Column, block: int = 4096) -> Column:
    """The parts of a text at an array of struct(start, end): looked up in blocks of the text, not from its beginning."""
    def part(blocks, h):
        first = F.floor(h["start"] / block).cast("int")
        near = F.concat(F.get(blocks, first), F.coalesce(F.get(blocks, first + 1), F.lit("")))
        return F.when(h["end"] - first * block <= 2 * block, F.substring(near, h["start"] - first * block + 1, h["end"] - h["start"])).otherwise(
            F.substring(text, h["start"] + 1, h["end"] - h["start"]))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}"), F.lit(0)), lambda blocks: F.transform(places, lambda h: part(blocks, h)))


def find_overlapping(text: Column, needle: Column) -> Column:
    """0-based offsets of every occurrence, overlapping ones too."""
    size = F.length(needle)
    last = F.length(text) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, size) == needle)


def offsets_of(text: Column, needle: str) -> Column:
    """0-based offsets of a literal, overlapping ones too: a look-ahead split, linear in the text."""
    pieces = F.split(text, f"(?={quote(needle)})", -1)
    starts = F.aggregate(pieces, F.array(F.lit(0)),
                         lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    return F.filter(starts, lambda at: F.substring(text, at + 1, F.lit(len(needle))) == needle)


def quote(needle: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in needle)


def mask(text: Column) -> Column:
    """Keep both ends, star the letters and digits between: enough to recognise an entry in a list."""
    size = F.length(text)
    keep = F.greatest(F.lit(2), F.floor(size / 4)).cast("int")
    starred = F.transform(characters(text), lambda c, i: F.when(
        (i >= keep) & (i < size - keep) & c.rlike("[0-9０-９A-Za-z]"), F.lit("*")).otherwise(c))
    return F.when(size <= 4, text).otherwise(F.array_join(starred, ""))


def join_lines(text: Column) -> Column:
    """Text copied line by line as running text: hyphenated words rejoined, no space beside CJK."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\ue000-\uf8ff]", "")
    rows = F.filter(F.transform(F.split(clean, "\n"), strip), lambda r: r != "")

    def glue(out, row):
        tight = F.right(out, F.lit(1)).rlike(CJK) | F.left(row, F.lit(1)).rlike(CJK)
        return (F.when(out == "", row)
                .when(out.rlike("[a-z]-$") & row.rlike("^[a-z]"),
                      F.concat(F.substring(out, F.lit(1), F.length(out) - 1), row))
                .otherwise(F.concat(out, F.when(tight, F.lit("")).otherwise(F.lit(" ")), row)))

    return F.regexp_replace(F.aggregate(rows, F.lit(""), glue), "[ \t]{2,}", " ")


def citation(text: Column, title: Column, page: Column) -> Column:
    """A quotation with its source; ``page`` counts from one."""
    body, name, number = join_lines(text), F.regexp_replace(title, r"(?i)\.pdf$", ""), page.cast("string")
    japanese = body.rlike(CJK) | name.rlike(CJK)
    return F.when(japanese, F.concat(F.lit("「"), body, F.lit("」（"), name, F.lit("、"), number, F.lit("ページ）"))).otherwise(
        F.concat(F.lit('"'), body, F.lit('" ('), name, F.lit(", p. "), number, F.lit(")")))


def guess_language(text: Column) -> Column:
    """Mostly Latin letters means English, anything else Japanese."""
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(latin > F.length(text) * 0.5, "en-US").otherwise("ja-JP")


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def escape_fdf(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")),
                     F.lit(")"), F.lit("\\)"))


def unescape_fdf(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")")),
                     F.lit("\\\\"), F.lit("\\"))


def csv_field(value: Column) -> Column:
    """Quote a value only where a comma, quote or line end asks for it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
                  ).otherwise(text)


def number_text(value: Column) -> Column:
    """A double in plain digits from 0.0001 up to ten quadrillions, where a cast turns to powers of ten much earlier."""
    size = F.abs(value)
    plain = F.regexp_replace(value.cast("string").cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), plain).otherwise(value.cast("string"))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])


def starts_like_item(text: Column) -> Column:
    return text.rlike(BULLET)


# Private-use bullets of symbol fonts, and letters that are bullets only in such fonts.
SYMBOL_BULLETS = {
    0xF0B7: "•", 0xF0A7: "▪", 0xF0D8: "➢", 0xF0FC: "✓", 0xF076: "❖", 0xF0A8: "◻", 0xF06C: "●",
    0xF06E: "■", 0xF0A1: "○", 0xF06F: "□", 0xF0E0: "→", 0xF0E8: "➔", 0xF0FB: "✗", 0xF071: "❑",
}
LETTER_BULLETS = {"o": "◦", "§": "▪", "Ø": "➢", "ü": "✓", "v": "❖", "n": "■", "l": "●"}


def bullet_character(text: Column, font: Column) -> Column:
    first = F.left(text, F.lit(1))
    face = F.lower(F.coalesce(font, F.lit("")))
    table = F.create_map(*[F.lit(v) for k, b in SYMBOL_BULLETS.items() for v in (chr(k), b)])
    letters = F.create_map(*[F.lit(v) for kv in LETTER_BULLETS.items() for v in kv])
    return (F.when(F.coalesce(text, F.lit("")) == "", "•")
            .when(table[first].isNotNull(), table[first])
            .when(face.rlike("wingdings|symbol") & letters[first].isNotNull(), letters[first])
            .when(first.rlike(r"[\uf000-\uf0ff]"), "•")
            .when(face.startswith("courier") & (first == "o"), "◦")
            .otherwise(text))

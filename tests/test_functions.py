"""Column functions against known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe.functions import checks, geometry, marks, measure, sheet, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values()) or (0,)], schema or "z int")
    return df.select(column.alias("v")).first()["v"]


def points(*pairs):
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in pairs])


def test_scale_and_measures(spark):
    factor = measure.scale_factor(F.lit(100.0), F.lit(5.0))
    square = points((0, 0), (100, 0), (100, 100), (0, 100))
    assert one(spark, measure.distance(points((0, 0), (200, 0)), factor)) == 10
    assert one(spark, measure.area(square, factor)) == 25
    assert one(spark, measure.perimeter(square, factor)) == 20
    assert one(spark, measure.perimeter(points((0, 0), (100, 0)), factor)) == 5
    assert one(spark, measure.perimeter(points((0, 0), (100, 0)), factor, always_close=True)) == 10
    assert one(spark, measure.volume(square, factor, F.lit(2.0))) == 50
    assert one(spark, measure.radius(points((0, 0), (100, 0)), factor)) == 5
    assert one(spark, measure.angle(points((100, 0), (0, 0), (0, 100)))) == pytest.approx(90)
    assert one(spark, measure.area(points((0, 0), (1, 1)), factor)) == 0
    assert one(spark, measure.calibrate(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)), F.lit(2.0), F.lit("yard")))["unit"] == "mm"


def test_check_digits(spark):
    assert one(spark, checks.luhn_ok(F.lit("4111 1111 1111 1111")))
    assert not one(spark, checks.luhn_ok(F.lit("4111 1111 1111 1112")))
    assert not one(spark, checks.luhn_ok(F.lit("411111111111")))
    assert one(spark, checks.my_number_ok(F.lit("1234-5678-9018")))
    assert not one(spark, checks.my_number_ok(F.lit("1234-5678-9012")))
    for number, fine in (("090-1234-5678", True), ("+81 3-1234-5678", True), ("0312345678", False), ("09012345678", True), ("03-123-45", False)):
        assert one(spark, checks.phone_ok(F.lit(number))) is fine, number


def test_text(spark):
    assert one(spark, text.fold_width(F.lit("０９０－１２３４"))) == "090-1234"
    assert one(spark, text.mask(F.lit("090-1234-5678"))) == "090-****-*678"
    assert one(spark, text.mask(F.lit("1234"))) == "1234"
    assert one(spark, text.join_lines(F.lit("a hyphen-\nated word\nand 日本\n語"))) == "a hyphenated word and 日本語"
    assert one(spark, text.citation(F.lit("契約"), F.lit("書.pdf"), F.lit(3))) == "「契約」（書、3ページ）"
    assert one(spark, text.citation(F.lit("deal"), F.lit("doc.PDF"), F.lit(3))) == '"deal" (doc, p. 3)'
    found = one(spark, text.find_all(F.col("t"), "[0-9]+"), t="a12b3c")
    assert [(r["start"], r["end"], r["value"]) for r in found] == [(1, 3, "12"), (4, 5, "3")]
    assert one(spark, text.offsets_of(F.col("t"), "aa"), t="aaa-aa") == [0, 1, 4]
    assert one(spark, text.find_overlapping(F.col("t"), F.lit("aa")), t="aaa-aa") == [0, 1, 4]
    assert one(spark, text.csv_line(F.lit('a"b'), F.lit("c,d"), F.lit(1))) == '"a""b","c,d",1'
    assert one(spark, text.strip(F.lit("　 a b\t\n"))) == "a b"


@pytest.mark.parametrize("cell, kind, value, fmt", [
    ("2024/3/5", "date", 45356.0, "yyyy/m/d"), ("2024年3月5日", "date", 45356.0, "yyyy/m/d"), ("2024/13/5", None, None, None),
    ("007", None, None, None), ("1234567890123456", None, None, None), ("12.5", "number", 12.5, "0.00"), ("−3", "number", -3.0, "General"),
    ("¥12,340,000", "number", 12340000.0, '"¥"#,##0'), ("12,340円", "number", 12340.0, '#,##0"円"'), ("(1,200)", "number", -1200.0, "#,##0"),
    ("△5", "number", -5.0, "0"), ("12.5%", "number", 0.125, "0.0%"), ("3千円", "number", 3000.0, "0"), ("2百万円", "number", 2000000.0, "0"),
    ("text", None, None, None), ("", None, None, None), ("1.2.3", None, None, None)])
def test_recognise(spark, cell, kind, value, fmt):
    row = sheet.recognise(spark.createDataFrame([(cell,)], "text string")).first()
    assert (row["kind"], row["value"], row["format"]) == (kind, value, fmt)


def test_sheet_references(spark):
    for letters, index in (("A", 0), ("Z", 25), ("AA", 26), ("XFD", 16383)):
        assert one(spark, sheet.column_index(F.lit(letters))) == index
        assert one(spark, sheet.column_letters(F.col("i")), i=index) == letters
    assert one(spark, sheet.parse_range(F.lit("1:3"))).asDict() == {"r0": 0, "c0": 0, "r1": 2, "c1": 16383}
    assert one(spark, sheet.parse_range(F.lit("A:C"))).asDict() == {"r0": 0, "c0": 0, "r1": 1048575, "c1": 2}
    assert one(spark, sheet.parse_range(F.lit("nonsense!"))) is None
    assert one(spark, sheet.serial_to_timestamp(F.lit(45356.5))) == dt.datetime(2024, 3, 5, 12)
    assert one(spark, sheet.serial_to_timestamp(F.lit(1.0))) == dt.datetime(1900, 1, 1)
    assert one(spark, sheet.serial_to_timestamp(F.lit(0.0), date1904=True)) == dt.datetime(1904, 1, 1)


@pytest.mark.parametrize("n, fmt, label", [
    (4, "decimal", "4"), (4, "decimalZero", "04"), (28, "lowerLetter", "ab"), (3, "upperLetter", "C"), (1994, "upperRoman", "MCMXCIV"),
    (9, "lowerRoman", "ix"), (3, "decimalEnclosedCircle", "③"), (21, "decimalEnclosedCircle", "(21)"), (12, "decimalFullWidth", "１２"),
    (23, "japaneseCounting", "二十三"), (10, "japaneseCounting", "十"), (105, "ideographDigital", "一〇五"), (2, "aiueo", "い"), (2, "iroha", "ろ"),
    (22, "ordinal", "22nd"), (12, "ordinal", "12th"), (5, "none", ""), (5, "bullet", "•")])
def test_list_numbers(spark, n, fmt, label):
    assert one(spark, sheet.format_number(F.col("n"), F.lit(fmt)), n=n) == label


def test_colours_dates_fonts(spark):
    assert one(spark, marks.hex_to_rgb(F.lit("#ff0033"))) == [1.0, 0.0, 0.2]
    assert one(spark, marks.rgb_to_hex(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.2)))) == "#ff0033"
    assert one(spark, marks.rgb_to_hex(F.array(F.lit(0.5)))) == "#808080"
    assert one(spark, marks.rgb_to_hex(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == "#ff0000"
    assert one(spark, marks.pdf_date(F.lit("D:20240305091500+09'00'"))) == dt.datetime(2024, 3, 5, 9, 15)
    assert one(spark, marks.pdf_date(F.lit("20240305"))) == dt.datetime(2024, 3, 5)
    assert one(spark, marks.pdf_date(F.lit("D:2024"))) is None
    assert one(spark, marks.office_font(F.lit("ABCDEF+HiraginoKaku-W3"))) == "ヒラギノ角ゴ ProN"


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_rotation_there_and_back(spark, turn):
    rect = F.array(*[F.lit(v) for v in (10.0, 20.0, 110.0, 60.0)])
    r, w, h = F.lit(turn), F.lit(595.0), F.lit(842.0)
    view = geometry.rect_to_view(rect, r, w, h)
    assert one(spark, geometry.rect_to_page(view, r, w, h)) == [10.0, 20.0, 110.0, 60.0]
    if turn == 90:
        assert one(spark, view) == [842.0 - 60, 10.0, 842.0 - 20, 110.0]


def test_geometry(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.overlap_fraction([F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)], [F.lit(v) for v in (5.0, 0.0, 20.0, 10.0)])) == 0.5
    assert one(spark, geometry.bounds(points((1, 5), (3, 2)), 1.0)) == [0.0, 1.0, 4.0, 6.0]
    assert one(spark, geometry.translated(box(0, 0, 2, 2), F.lit(1.0), F.lit(3.0))) == [1.0, 3.0, 3.0, 5.0]
    assert one(spark, geometry.scaled_points(points((5, 5)), box(0, 0, 10, 10), box(0, 0, 20, 40))) == [[10.0, 20.0]]
    polygon = points((0, 0), (10, 0), (10, 10), (0, 10))
    assert one(spark, geometry.point_in_polygon(F.lit(5.0), F.lit(5.0), polygon))
    assert not one(spark, geometry.point_in_polygon(F.lit(15.0), F.lit(5.0), polygon))
    assert one(spark, geometry.encloses(box(0, 0, 10, 10), box(-0.5, 0, 10.5, 10)))

"""Dirty input and long results: nothing ends a job, nothing is cut unless asked for."""

from pyspark.sql import functions as F

from folioframe.functions import sheet
from folioframe.operators import review, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_references_beyond_whole_numbers_are_no_cells(spark):
    for text in ("A99999999999", "ABCDEFGHIJ1", "", "A0x"):
        assert one(spark, sheet.parse_ref(F.lit(text))) is None
    assert one(spark, sheet.parse_range(F.lit("1:99999999999"))) is None
    assert tuple(one(spark, sheet.parse_ref(F.lit("$B$3")))) == (2, 1)


def test_letters_of_any_column(spark):
    names = {0: "A", 25: "Z", 26: "AA", 18278: "AAAA", 475253: "ZZZZ", 475254: "AAAAA", 12356630: "AAAAAA"}
    for index, letters in names.items():
        assert one(spark, sheet.column_index(F.lit(letters))) == index
        assert one(spark, sheet.column_letters(F.lit(index).cast("bigint"))) == letters


def test_full_width_digits_are_numbers(spark):
    cells = spark.createDataFrame([("１２３",), ("¥１,２３４",), ("2024年１月２日",), ("x１",)], "text string")
    kinds = {r["text"]: (r["kind"], r["value"]) for r in sheet.recognise(cells).collect()}
    assert kinds["１２３"] == ("number", 123.0) and kinds["¥１,２３４"] == ("number", 1234.0)
    assert kinds["2024年１月２日"][0] == "date" and kinds["x１"][0] is None


def test_a_blank_phrase_is_found_nowhere(spark):
    lines = spark.createDataFrame([(1, 0, 0, "ab cd")], "doc_id int, page int, line int, text string")
    assert search.exact_hits(lines, "  ").count() == 0 and search.exact_hits(lines, "cd").count() == 1


def test_ranks_cover_the_whole_list(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    assert review.ranked(rows, ["k"], [F.col("id")]).count() == 1000
    assert review.ranked(rows, ["k"], [F.col("id")], 40).count() == 80

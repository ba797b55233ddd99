"""Results that hold everything they are about."""

from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.operators import documents, takeoff
from folioframe.streaming import edits


def test_every_page_without_text_is_listed(spark):
    docs = spark.createDataFrame([(1, True, "en", "t"), (2, True, "en", "t")], "doc_id int, tagged boolean, lang string, title string")
    images = spark.createDataFrame([(1, p, "a") for p in range(12)], "doc_id int, page int, alt string")
    texts = spark.createDataFrame([(1, 3, 5)], "doc_id int, page int, chars int")
    found = {r["doc_id"]: r for r in documents.audit(docs, texts, images).collect()}
    assert found[1]["scanned_pages"] == [1, 2, 3, *range(5, 13)] and found[1]["scanned"] == 11
    assert found[2]["scanned_pages"] is None and found[2]["passed"]


def test_large_totals_are_written_in_plain_digits(spark):
    numbers = spark.createDataFrame([(v,) for v in (0.0, -2.5, 1e7, 30483036.0, -12345678.9012, 9007199254740993.0, 0.00025, 1e16, None)], "v double")
    assert [r[0] for r in numbers.select(text.number_text(F.col("v"))).collect()] == [
        "0.0", "-2.5", "10000000.0", "30483036.0", "-12345678.9012", "9007199254740992.0", "0.00025", "1.0E16", None]
    items = spark.createDataFrame([(1, 0, "area", v) for v in (2e7, 1e7)], "doc_id int, page int, kind string, v double").selectExpr(
        "doc_id", "page", "'S' AS subject", "'measure' AS tool", "struct(kind, v AS value, 'm' AS unit, '' AS label) AS measure", "'' AS contents",
        "array(0D, 0D) AS rect", "struct('#000000' AS stroke) AS style", "cast(v AS string) AS seq")
    assert takeoff.summary_csv(takeoff.summarise(items)).first()["line"].split(",")[3] == "30000000.0"
    assert {r["line"].split(",")[3] for r in takeoff.detail_csv(items).collect()} == {"10000000.0", "20000000.0"}


def test_a_stream_reads_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "id * 2 AS twice")
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        stream = edits.read_events(spark, str(tmp_path), name, "id bigint, twice bigint")
        assert edits.to_table(stream, name=name).count() == 20

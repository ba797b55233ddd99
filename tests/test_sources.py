"""Files read and written."""

import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioframe.sources import files, xfdf


def test_inventory_by_content_then_name(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.docx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    with zipfile.ZipFile(tmp_path / "c.dat", "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("other.xml", "<x/>")
    (tmp_path / "e.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "f.md").write_bytes(b"# x")
    (tmp_path / "g.exe").write_bytes(b"MZ")
    got = files.inventory(files.read_binary(spark, str(tmp_path)))
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in got.collect()}
    assert kinds == {"a.bin": "pdf", "b.docx": "ole", "c.dat": "xlsx", "d.docx": "unknown", "e.PNG": "image", "f.md": "text", "g.exe": "unknown"}


def test_texts_in_four_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿契約".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("契約書".encode("cp932"))
    (tmp_path / "c.txt").write_bytes("plain".encode())
    (tmp_path / "d.txt").write_bytes(b"\x81\x20ok\xff\xff\xff")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "契約" and got["b.txt"] == "契約書" and got["c.txt"] == "plain" and "ok" in got["d.txt"]


def test_xfdf_in(spark, tmp_path):
    (tmp_path / "one.xfdf").write_text(
        '<?xml version="1.0"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'
        '<highlight page="0" rect="10,700,110,720" color="#ff0000" title="A" state="Accepted" coords="10,720,110,720,10,700,110,700"><contents> hi </contents></highlight>'
        '<text page="1" rect="0,0,10,10"><contents>note</contents></text><ink page="0" rect="0,0,9,9" inklist="1,2,3,4;5,6"/>'
        '<polygon page="0" rect="0,0,9,9" vertices="1,2;3,4"/><unknown page="0" rect="0,0,1,1"/><circle page="7" rect="0,0,1,1"/></annots></xfdf>')
    nodes = xfdf.read_nodes(spark, str(tmp_path)).withColumn("doc_id", F.lit(1).cast("bigint"))
    pages = spark.createDataFrame([(1, 0, 842.0), (1, 1, 842.0)], "doc_id bigint, page int, height double")
    got = {r["type"]: r for r in xfdf.to_marks(nodes, pages).collect()}
    assert set(got) == {"highlight", "note", "ink", "polygon"}
    assert got["highlight"]["rect"] == [10.0, 122.0, 110.0, 142.0] and got["highlight"]["state"] == "accepted"
    assert got["highlight"]["contents"] == "hi" and got["highlight"]["quads"] == [[10.0, 122.0, 110.0, 122.0, 10.0, 142.0, 110.0, 142.0]]
    assert got["ink"]["strokes"] == [[[1.0, 840.0], [3.0, 838.0]]] and got["polygon"]["points"] == [[1.0, 840.0], [3.0, 838.0]]
    assert got["note"]["style"]["stroke"] == "#e0403a"


def test_lines_written_in_order(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 3 AS doc_id", "id AS pos", "cast(id AS string) AS line")
    files.write_lines(df, str(tmp_path / "out"), ["pos"], mark=True)
    for doc in range(3):
        parts = sorted((tmp_path / "out" / f"doc_id={doc}").glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert text.startswith("﻿")
        assert [int(v) for v in text.lstrip("﻿").split()] == list(range(doc, 500, 3))


def test_xfdf_keeps_the_order_and_rejects_what_is_no_number(spark, tmp_path):
    (tmp_path / "a.xfdf").write_text(
        '<?xml version="1.0"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><text page="9"/></fields><!-- <ink page="0"/> --><annots>'
        '<text page="0" title=\'A "q" &amp; &lt;b> \'><contents>no&lt;te <![CDATA[</text> & ]]></contents></text><highlight page="0" opacity="abc"/>'
        '<ink page="0" inklist="1,2;x,3"/><text page="0"/><square page="0" rect="1,2,3"/><circle page="1.5"/><polygon page="0" vertices="1,y;2,3"/>'
        '<textual page="0"/><highlight page="0" coords="1,2,3,nan"/><line page="0" width=""/><square page=" 0 " width=" 2 "><popup page="0"/></square>'
        '<circle page="0" title="a &nope; b"/></annots></xfdf>')
    (tmp_path / "b.xfdf").write_text("no xml at all")
    nodes = xfdf.read_nodes(spark, str(tmp_path)).withColumn("doc_id", F.lit(1).cast("bigint"))
    bad = {r["seq"]: (r["tag"], r["problem"]) for r in xfdf.rejects(nodes).collect()}
    assert bad == {1: ("highlight", "opacity"), 2: ("ink", "inklist"), 4: ("square", "rect"), 5: ("circle", "page"), 6: ("polygon", "vertices"),
                   7: ("highlight", "coords"), 8: ("line", "width"), 10: ("circle", "xml")}
    pages = spark.createDataFrame([(1, 0, 100.0)], "doc_id bigint, page int, height double")
    got = [(r["seq"], r["type"], r["author"], r["contents"]) for r in xfdf.to_marks(nodes, pages).orderBy("seq").collect()]
    assert got == [(0, "note", 'A "q" & <b> ', "no<te </text> &"), (3, "note", "", ""), (9, "square", "", "")]


def test_reports_in_shards_with_an_index(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 7 AS doc_id", "id AS pos", "concat(id % 7, ' ', id) AS line")
    index = files.write_shards(df, str(tmp_path / "out"), ["pos"], 3).collect()
    held = {int(p.name.split("=")[1]): [f.read_text().splitlines() for f in p.glob("part-*")] for p in (tmp_path / "out").glob("shard=*")}
    assert len(held) == 3 and all(len(x) == 1 for x in held.values())
    for doc in range(7):
        found = [held[r["shard"]][0][r["first_line"]: r["first_line"] + r["lines"]] for r in sorted(index, key=lambda r: r["shard"]) if r["doc_id"] == doc]
        assert sum(found, []) == [f"{doc} {i}" for i in range(doc, 500, 7)]


def test_local_files_start_no_process_each(spark, tmp_path):
    """Hadoop's local file system starts three a document: 900 here; a folder is not listed in a task of its own either."""
    def started():
        return int(re.search(r"processes (\d+)", Path("/proc/stat").read_text())[1])

    df = spark.range(3000).selectExpr("id % 300 AS doc_id", "id AS pos", "cast(id AS string) AS line").cache()
    files.write_lines(df, str(tmp_path / "warm"), ["pos"])
    before = started()
    files.write_lines(df, f"file://{tmp_path}/out", ["pos"])
    assert started() - before < 300
    assert len(list((tmp_path / "out").glob("doc_id=*/part-*.txt"))) >= 300 and not list(tmp_path.rglob(".*")) and (tmp_path / "out" / "_SUCCESS").exists()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert spark.read.text(str(tmp_path / "out")).count() == 3000
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages) <= 128
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_local_files_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    keys = ["a/b=c", "100% [x] é:", "", None, "契約", "long"]
    rows = [(k, i, None if i == 3 else f"{k} {i}\nä") for k in keys for i in range(40000 if k == "long" else 5)]
    df = spark.createDataFrame(rows, "name string, pos int, line string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # four ranges
    try:
        for way in ("ours", "theirs"):
            if way == "theirs":
                monkeypatch.setattr(files, "_local_folder", lambda spark, path: None)
            for part in (df.where("name = 'long'"), df):  # the second writes over the first
                files.write_lines(part, str(tmp_path / way), ["pos"], key="name")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    texts = {way: {f.name: "".join(p.read_text() for p in sorted(f.glob("part-*"))) for f in (tmp_path / way).glob("name=*")} for way in ("ours", "theirs")}
    assert texts["ours"] == texts["theirs"] and len(texts["ours"]) == 5
    assert len(list((tmp_path / "ours" / "name=long").glob("part-*"))) > 1
    read = [sorted(map(tuple, spark.read.text(str(tmp_path / way)).select("name", "value").where("name is null or name <> 'long'").collect()), key=str)
            for way in ("ours", "theirs")]
    assert read[0] == read[1] and len(read[0]) == 5 * 9


def test_a_failed_report_leaves_the_former_one(spark, tmp_path):
    df = spark.range(20).selectExpr("id % 3 AS doc_id", "id AS pos", "cast(id AS string) AS line")
    files.write_lines(df, str(tmp_path / "out"), ["pos"])
    with pytest.raises(Exception, match="no line"):
        files.write_lines(df.withColumn("line", F.when(F.col("pos") == 7, F.raise_error(F.lit("no line"))).otherwise(F.col("line"))), str(tmp_path / "out"), ["pos"])
    assert spark.read.text(str(tmp_path / "out")).count() == 20 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_an_element_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.xfdf").write_text('<xfdf><annots><text page="0"/></annots></xfdf>')
    nodes = xfdf.read_nodes(spark, str(tmp_path)).withColumn("doc_id", F.lit(1).cast("bigint"))
    pages = spark.createDataFrame([(1, 0, 100.0)], "doc_id bigint, page int, height double")
    marks = xfdf.to_marks(nodes, pages)
    assert marks._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1 and marks.count() == 1

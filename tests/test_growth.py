"""Steps whose work has to grow with their input, beside plain Python and under generous limits."""

import re
import time

from pyspark.sql import functions as F

from folioframe.operators import layout, scale, tables
from folioframe.plans import catalogue
from folioframe.plans import files as plan_files
from folioframe.session import cut_lineage


def _walked(blocks):
    """The rule of merge_row_blocks, one page after the other, as a plain walk over (block, x0, y0, x1, y1)."""
    rows = []
    for block, x0, y0, x1, y1 in sorted(blocks, key=lambda b: (round(b[2]), b[1], b[0])):
        for r in reversed(rows[-8:]):
            h = min(r["y1"] - r["y0"], y1 - y0)
            if h > 0 and min(r["y1"], y1) - max(r["y0"], y0) > h * 0.6 and x0 >= r["x1"] - 1 and x0 - r["x1"] < 160:
                r.update(y0=min(r["y0"], y0), y1=max(r["y1"], y1), x1=max(r["x1"], x1))
                r["ids"].append(block)
                break
        else:
            rows.append({"y0": y0, "y1": y1, "x1": x1, "ids": [block]})
    return [r["ids"] for r in rows]


def _blocks(spark, rows):
    frame = spark.createDataFrame(rows, "page int, block int, x0 double, y0 double, x1 double, y1 double")
    return frame.select(F.lit(1).alias("doc_id"), "*", F.array(F.lit(0)).alias("lines"))


def test_row_blocks_of_crossing_heights(spark):
    pages = [[(i, float(i * 37 % 300), float(i * i * (7 + p) % 90) / 2, float(i * 37 % 300 + 10 + i % 30), float(i * i * (7 + p) % 90) / 2 + 4 + i % 9)
              for i in range(60)] for p in range(12)]
    got = layout.merge_row_blocks(_blocks(spark, [(p, *b) for p, bs in enumerate(pages) for b in bs])).collect()
    for p, bs in enumerate(pages):
        assert [r["blocks"] for r in sorted((r for r in got if r["page"] == p), key=lambda r: r["row"])] == _walked(bs)


def test_row_blocks_of_a_long_page(spark):
    rows = [(0, i, float(i % 2 * 50), float(i // 2 * 10), float(i % 2 * 50 + 40), float(i // 2 * 10 + 8)) for i in range(16000)]
    begin = time.time()
    got = layout.merge_row_blocks(_blocks(spark, rows)).agg(F.count("*"), F.max("row"), F.min(F.size("blocks"))).first()
    assert tuple(got) == (8000, 7999, 2) and time.time() - begin < 15


def _moved(frame):
    """How many shuffles a frame takes."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_and_spans_of_a_page_are_moved_once(spark):
    page = "doc_id int, page int, tbl int, seq int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(d, p, 0, r * 3 + c, 10.0 + 50 * c, 10.0 + 20 * r, 60.0 + 50 * c, 30.0 + 20 * r)
                                   for d in range(3) for p in range(2) for r in range(4) for c in range(3)], page)
    spans = spark.createDataFrame([(d, p, r * 3 + c, 0, k, f"{r}{c}{k} ", 12.0 + 50 * c + 9 * k, 13.0 + 20 * r, 20.0 + 50 * c + 9 * k, 25.0 + 20 * r)
                                   for d in range(3) for p in range(2) for r in range(4) for c in range(3) for k in range(2)],
                                  "doc_id int, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double")
    frame = tables.ruled_cells(boxes.repartition(4, "doc_id", "page"), spans.repartition(4, "doc_id", "page"), False)
    got = {(r["doc_id"], r["page"], r["row"], r["col"]): r["text"] for r in frame.collect()}
    assert got == {(d, p, r, c): f"{r}{c}0 {r}{c}1" for d in range(3) for p in range(2) for r in range(4) for c in range(3)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _moved(tables.ruled_cells(boxes.repartition(4, "doc_id", "page"), spans.repartition(4, "doc_id", "page"), False)) <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_nearest_cell_takes_what_lies_between(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0.0, 0.0, 40.0, 20.0), (1, 0, 0, 1, 0, 1, 60.0, 0.0, 100.0, 20.0)],
                                  "doc_id int, page int, tbl int, seq int, r0 int, c0 int, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 0, b, 0, 0, "t", x - 1, 9.0, x + 1, 11.0) for b, x in enumerate((10.0, 45.0, 55.0, 90.0, 300.0))],
                                  "doc_id int, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r["block"]: r["c0"] for r in tables.cell_spans(spans, cells, nearest=True).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert {r["block"]: r["c0"] for r in tables.cell_spans(spans, cells).collect()} == {0: 0, 3: 1}


def _plan(spark, frame):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_moved_before_they_are_cut_into_words(spark, data):
    plan = _plan(spark, lambda: catalogue.QUERIES["style_runs"](spark, data))
    assert plan.split("Exchange hashpartitioning(doc_id")[0].count("Generate") == 2


def test_characters_of_hits_stay_with_their_page(spark, data):
    assert "hashpartitioning(doc_id" in (plan := _plan(spark, lambda: catalogue.QUERIES["search_hits"](spark, data)))
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, page#\d+, line#", plan)


def test_whole_pages_write_no_spans_down(spark, data, monkeypatch):
    held = []
    monkeypatch.setattr(tables, "cut_lineage", lambda df: held.append(df.columns) or df)
    catalogue.QUERIES["whole_page_tables"](spark, data)
    assert held and not [columns for columns in held if "pos" in columns]


def test_charts_are_not_cut_between_files(spark, data, tmp_path, monkeypatch):
    """Of two series in a file without the root, Spark's reader loses one; forty ranges would cut every chart."""
    monkeypatch.setattr(plan_files, "scratch_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        catalogue.QUERIES["chart_series"](spark, data)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    charts = [[p.read_text() for p in folder.glob("*.txt")] for folder in (tmp_path / "charts").glob("doc_id=*")]
    assert charts and all(len(c) == 1 and c[0].startswith("<c:chart") and c[0].endswith("</c:chart>\n") for c in charts)


def test_reports_are_read_in_few_tasks_and_without_partition_values(spark, data):
    plan = _plan(spark, lambda: catalogue.QUERIES["report_files"](spark, data))
    assert "Coalesce" in plan and "FileScan text" in plan and "FileScan text [doc_id" not in plan
    plan = _plan(spark, lambda: catalogue.QUERIES["xfdf_round_trip"](spark, data))
    assert "Coalesce" in plan


def test_pages_with_inserts_read_the_texts_once(spark, data):
    for name in ("insert_page", "insert_document"):
        assert "Generate" not in _plan(spark, lambda: catalogue.QUERIES[name](spark, data))  # noqa: B023


def test_a_table_of_one_file_is_cut_into_several_parts_a_core(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert scale.spread(docs, "doc_id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_editable_lines_are_made_from_their_words_once(spark, data):
    plan = _plan(spark, lambda: catalogue.QUERIES["editable_lines"](spark, data))
    assert plan.count("Generate") == 2 and "Join" not in plan


def test_outline_lines_are_put_together_once(spark, data, monkeypatch):
    held = []
    monkeypatch.setattr(layout, "cut_lineage", lambda df: held.append(df.columns) or cut_lineage(df))
    catalogue.QUERIES["auto_outline"](spark, data)
    assert "plausible" in held[0]


def test_column_starts_of_a_tab_table_are_worked_out_once(spark, data):
    """Inside the inner functions they would be worked out for each cell of the table."""
    assert "filter(aggregate(" not in _plan(spark, lambda: catalogue.QUERIES["sheet_tables"](spark, data))


def test_words_of_a_sheet_are_gathered_once(spark, data):
    """By the heights of a block, then by block and by table: not line by line, and not once more by row."""
    assert _plan(spark, lambda: catalogue.QUERIES["sheet_tables"](spark, data)).count("partial_collect_list") == 3


def _joined(spans):
    """The rule of merge_baselines for one block, line after line, over (line, span, x0, y0, y1, vertical)."""
    rows, at = [], {}
    for line in sorted({s[0] for s in spans}):
        own = [s for s in spans if s[0] == line]
        y0, y1, vertical = min(s[3] for s in own), max(s[4] for s in own), any(s[5] for s in own)
        for i, r in enumerate(rows):
            h = min(r[1] - r[0], y1 - y0)
            if not vertical and not r[2] and h > 0 and min(r[1], y1) - max(r[0], y0) > h * 0.6:
                r[:2] = [min(r[0], y0), max(r[1], y1)]
                break
        else:
            i = len(rows)
            rows.append([y0, y1, vertical])
        at |= {(line, s[1]): i for s in own}
    return at


def test_baselines_of_plain_and_of_crossing_blocks(spark):
    blocks = []
    for b in range(40):
        plain, rows = b % 2 == 0, []
        for line in range(12):
            for span in range(1 + (line + b) % 3):
                y0 = float(line // 3 * 14) if plain else float((line * 7 + b * 5 + span * (b % 4)) % 23)
                y1 = y0 + 11 if plain else y0 + (line * 5 + b) % 9
                rows.append((line, span, float((line * 37 + span * 11) % 60), y0, y1, b % 10 == 3 and line == 4))
        blocks.append(rows)
    frame = spark.createDataFrame([(1, 0, b, n, s, f"{n}.{s}|", 10.0, x0, y0, x0 + 9, y1, 1.0 if v else 0.0) for b, rows in enumerate(blocks) for n, s, x0, y0, y1, v in rows],
                                  "doc_id int, page int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double, dir_y double")
    got = {}
    for r in layout.merge_baselines(frame).where(F.contains("text", F.lit("|"))).collect():
        line, span = map(int, r["text"].rstrip("|").split("."))
        got[r["block"], line, span] = (r["row"], r["x0"], r["y0"], r["y1"], r["vertical"])
    for b, rows in enumerate(blocks):
        at = _joined(rows)
        upright = {at[s[:2]]: False for s in rows} | {at[s[:2]]: True for s in rows if s[5]}
        for n, s, x0, y0, y1, _ in rows:
            assert got[b, n, s] == (at[n, s], x0, y0, y1, upright[at[n, s]])

"""Pages that are gathered once: the same sheets from whole rows as from their pieces, and no words one by one."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import layout, tables
from folioframe.plans import catalogue, corpus

SPAN = "doc_id int, page int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double"


def _page(rng, page, plain):
    """Blocks side by side and over each other, wide and narrow gaps, blank words and words that are tabs."""
    rows = []
    for block in range(14):
        left, top = rng.choice([40.0, 180.0, 320.0]), (block // 2) * 30.0 if plain else rng.randint(0, 180) * 1.0
        for line in range(3):
            x = left
            y0 = top if plain else top + line * rng.choice([0.0, 4.0, 11.0])
            for span in range(rng.randint(1, 3)):
                text = rng.choice(["12", "¥1,200", "word", "of ", " begin", "\t", "  ", "end\t", ""])
                width = 5.0 * max(len(text), 1)
                rows.append((1, page, block, line, span, text, 10.0, x, y0, x + width, y0 + (10.0 if plain else rng.choice([9.0, 10.0, 14.0]))))
                x += width + rng.choice([0.0, 2.0, 4.0, 9.0, 20.0, 60.0])
    return rows


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(5)
    return spark.createDataFrame([r for page in range(10) for r in _page(rng, page, page % 2 == 0)], SPAN)


@pytest.fixture(scope="module")
def boxes(spark):
    at = lambda t, s: (60.0 + 70 * (s % 2) + 150 * t, 50.0 + 15 * (s // 2) + 60 * t)
    rows = [(1, page, t, s, x, y, x + 70, y + 15) for page in (0, 1, 2, 3, 12) for t in (0, 1) for s in range(4) for x, y in [at(t, s)]]
    rows += [(1, 4, 0, 0, 50.0, 30.0, 200.0, 50.0), (1, 4, 0, 1, 50.0, 50.0, 120.0, 70.0), (1, 4, 0, 2, 120.0, 50.0, 200.0, 70.0)]
    return spark.createDataFrame(rows, "doc_id int, page int, tbl int, seq int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("mode", ["page", "single", "tables"])
def test_whole_rows_give_the_sheets_of_their_pieces(spark, spans, boxes, mode):
    held = spans.groupBy("doc_id", "page", "block").agg(F.collect_list(F.struct(*spans.columns[3:])).alias("spans"))
    got = [sorted(map(repr, tables.page_sheets(rows, boxes, mode).collect())) for rows in (
        layout.merge_baselines(spans), layout.joined_baselines(spans), layout.joined_baselines(held))]
    assert len(got[0]) > 50 and got[0] == got[1] == got[2]


def test_cells_of_a_page_equal_a_plain_walk(spark, spans, boxes):
    """Each piece goes to the first cell that holds its centre; a cell's lines stand by height."""
    pieces = layout.merge_baselines(spans)
    cells = tables.grid(boxes)
    want = {}
    held = [r for r in pieces.collect() if r["text"] != "\t"]
    for c in sorted(cells.collect(), key=lambda c: (c["seq"], c["tbl"], c["r0"], c["c0"])):
        own = [p for p in held if p["page"] == c["page"] and c["x0"] - 1 <= (p["x0"] + p["x1"]) / 2 <= c["x1"] + 1 and c["y0"] - 1 <= (p["y0"] + p["y1"]) / 2 <= c["y1"] + 1]
        held = [p for p in held if p not in own]
        lines = {}
        for p in sorted(own, key=lambda p: (p["x0"], p["pos"], p["text"])):
            lines.setdefault((p["block"], p["row"]), []).append(p)
        made = sorted((round(min(p["y0"] for p in ps)), ps[0]["x0"], key, "".join(p["text"] for p in ps).replace("\t", " ").strip()) for key, ps in lines.items()
                      if any(p["text"].strip() for p in ps))
        want[c["page"], c["tbl"], c["r0"], c["c0"]] = "\n".join(text for *_, text in made).strip()
    got = tables.ruled_cells(boxes, pieces.withColumnsRenamed({"row": "line", "pos": "span"}), False)
    assert {(r["page"], r["tbl"], r["row"], r["col"]): r["text"] for r in got.collect()} == want and any(want.values())


def test_words_of_whole_pages_are_never_rows(spark, data):
    """Words stand in their blocks and blocks in their page: what is exploded are lines, blocks and cells."""
    plan = catalogue.QUERIES["whole_page_tables"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(split(" not in plan and "span#" not in plan
    assert plan.count("Window [") == 0 and plan.count("collect_list") <= 4


def test_tables_are_put_on_their_grid_once(spark, data):
    """What the cells of a page are is worked out in one place and brought to its lines, without a join or a second walk."""
    for name in ("ruled_cells", "column_types", "nearest_cells"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Scan parquet") == 1 and plan.count("aggregate(") == 2, name


def test_lines_of_several_cells_and_pages_without_lines(spark):
    """A line over two cells is cut between them, centres up to 1 pt outside count, and cells without text stay."""
    boxes = spark.createDataFrame([(d, 0, 0, s, 10.0 + 50 * (s % 2), 10.0 + 20 * (s // 2), 60.0 + 50 * (s % 2), 30.0 + 20 * (s // 2)) for d in (1, 2) for s in range(4)],
                                  "doc_id int, page int, tbl int, seq int, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 0, 0, 0, i, text, x - 4, y - 4, x + 4, y + 4) for i, (text, x, y) in enumerate([
        ("a", 20.0, 20.0), ("b", 60.5, 20.0), ("c", 61.5, 20.0), ("d", 110.9, 20.0), ("out", 111.1, 20.0), ("\t", 30.0, 20.0)])] + [
        (1, 0, 1, 0, 0, "low", 16.0, 41.0, 24.0, 49.0), (1, 0, 2, 0, 0, "top", 16.0, 31.0, 24.0, 39.0), (1, 0, 3, 0, 0, "  ", 70.0, 41.0, 78.0, 49.0)],
        "doc_id int, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["doc_id"], r["row"], r["col"]): (r["kind"], r["text"]) for r in tables.ruled_cells(boxes, spans).collect()}
    assert got == {(1, 0, 0): ("s", "ab"), (1, 0, 1): ("s", "cd"), (1, 1, 0): ("s", "top\nlow"), (1, 1, 1): ("e", ""),
                   **{(2, r, c): ("e", "") for r in (0, 1) for c in (0, 1)}}


def test_documents_that_come_twice_share_their_blocks(spark, tmp_path):
    """Words of both copies lie in one block, as they do where words are rows."""
    text = " ".join(f"w{i}" for i in range(60)) + "\nshort line\n\n" + "x " * 50
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text[30:], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    words = corpus.words(spark, str(tmp_path)).withColumns({"block": F.col("line") * 100 + F.floor(F.col("span") / 6), "line": F.col("span")})
    rows = [sorted(map(repr, layout.merge_baselines(held).collect())) for held in (words, corpus.word_blocks(spark, str(tmp_path), 6))]
    assert rows[0] == rows[1] and any("'w1'" in r for r in rows[0])

"""Rows over whole pages, runs under boxes, edited lines, long lines of hits, sums through a table: against plain walks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioframe.functions.text import find_all, pieces_at, scan
from folioframe.operators import layout, pages, privacy, runs, scale, search, tables

PIECE = "doc_id int, page int, block int, row int, pos int, text string, size double, x0 double, y0 double, x1 double, y1 double, vertical boolean"


def walked_rows(lines):
    """Every line joins the first row it overlaps by more than 60 % of the smaller height; the plain quadratic walk."""
    found = []
    for ln in sorted(lines, key=lambda r: (r["y0"], r["x0"], r["block"], r["row"])):
        for row in found:
            if not ln["vertical"] and not row["vertical"]:
                height = min(row["y1"] - row["y0"], ln["y1"] - ln["y0"])
                if height > 0 and min(row["y1"], ln["y1"]) - max(row["y0"], ln["y0"]) > 0.6 * height:
                    row["members"].append(ln["id"])
                    row["y0"], row["y1"] = min(row["y0"], ln["y0"]), max(row["y1"], ln["y1"])
                    break
        else:
            found.append({**ln, "members": [ln["id"]]})
    return sorted(sorted(r["members"]) for r in found)


def test_rows_of_a_page_whatever_their_blocks(spark):
    rng = random.Random(2)
    data, lines = [], {}
    for page in range(12):
        for i in range(40):
            x0, y0 = rng.choice([50.0, 200.0, 350.0]) + i / 100, rng.randint(0, 60) * 7.0
            height = rng.choice([9.0, 10.0, 12.0, 24.0, 0.0])
            upright = rng.random() < 0.1
            data.append((1, page, i % 5, i, 0, f"w{i}", 10.0, x0, y0, x0 + 20, y0 + height, upright))
            lines.setdefault(page, []).append({"id": f"w{i}", "x0": x0, "y0": y0, "y1": y0 + height, "block": i % 5, "row": i, "vertical": upright})
    merged = layout.merge_page_rows(spark.createDataFrame(data, PIECE))
    got = {}
    for r in merged.where("text like 'w%'").collect():
        got.setdefault(r["page"], {}).setdefault(r["row"], []).append(r["text"])
    for page, of in lines.items():
        assert sorted(sorted(x) for x in got[page].values()) == walked_rows(of)


def test_columns_in_blocks_of_their_own_make_one_table(spark):
    data = [(1, 0, block, line, 0, f"{name}{line}", 10.0, 50.0 + 150 * block, 40.0 + 14 * line, 80.0 + 150 * block, 50.0 + 14 * line, False)
            for block, name in enumerate("abc") for line in range(3)]
    boxes = spark.createDataFrame([(1, 0, t, s, 50.0 + 100 * (s % 2), 200.0 + 20 * (s // 2), 150.0 + 100 * (s % 2), 220.0 + 20 * (s // 2))
                                   for t in (0, 1) for s in range(4 if t == 0 else 1)],
                                  "doc_id int, page int, tbl int, seq int, x0 double, y0 double, x1 double, y1 double")
    data += [(1, 0, 9, 0, 0, "12", 10.0, 60.0, 205.0, 70.0, 215.0, False), (1, 0, 10, 0, 0, "below", 10.0, 50.0, 300.0, 90.0, 310.0, False)]
    found = tables.page_sheets(spark.createDataFrame(data, PIECE), boxes).collect()
    cells = {(r["row"], r["col"]): (r["kind"], r["text"]) for r in found}
    assert {k: v for k, v in cells.items() if k[0] < 3} == {(r, c): ("s", f"{'abc'[c]}{r}") for r in range(3) for c in range(3)}
    assert {k: v for k, v in cells.items() if k[0] >= 3} == {(3, 0): ("n", "12"), (3, 1): ("e", ""), (4, 0): ("e", ""), (4, 1): ("e", ""), (5, 0): ("s", "below")}
    sheets = {r["sheet"] for r in tables.page_sheets(spark.createDataFrame(data, PIECE), boxes, "tables").collect()}
    assert sheets == {"ページ1-表1", "ページ1-表2"}


def test_runs_under_boxes_equal_characters_under_boxes(spark):
    rng = random.Random(3)
    chars, boxes = [], []
    for line in range(30):
        x = 10.0
        for seq in range(rng.randint(0, 60)):
            if rng.random() < 0.05:
                x = rng.uniform(0, 200)  # right to left, or set over other characters
            up = rng.choice([0.0, 0.0, 0.0, 3.0])
            chars.append((1, 0, line // 4, line, seq, rng.choice("abcdef"), x, line * 9.0 + up, x + rng.uniform(1, 6), line * 9.0 + 8 + up))
            x += 5
    for i in range(60):
        x, y = rng.uniform(0, 200), rng.uniform(0, 250)
        boxes.append((1, 0, i, x, y, x + rng.uniform(0, 120), y + rng.uniform(0, 60)))
    df = spark.createDataFrame(chars, "doc_id int, page int, block int, line int, seq int, c string, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame(boxes, "doc_id int, page int, i int, bx0 double, by0 double, bx1 double, by1 double")
    got = {}
    for r in runs.text_under(runs.runs_of(df), rects).orderBy("line", "seq").collect():
        got[r["i"]] = got.get(r["i"], "") + r["t"]
    for _, _, i, a, b, c, d in boxes:
        under = [(ln, seq, ch) for _, _, _, ln, seq, ch, x0, y0, x1, y1 in chars if a <= (x0 + x1) / 2 < c and b <= (y0 + y1) / 2 < d]
        assert got.get(i, "") == "".join(ch for _, _, ch in sorted(under))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64])
def test_lower_bound(spark, n):
    values = [float(i * 2) for i in range(n)]
    df = spark.createDataFrame([(x / 2,) for x in range(-2, 4 * n + 4)], "x double").withColumn("v", F.array(*[F.lit(v) for v in values]).cast("array<double>"))
    for r in df.select("x", runs.lower_bound(F.col("v"), F.col("x")).alias("at")).collect():
        assert r["at"] == sum(v < r["x"] for v in values)


def test_edited_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, "cat and cat, concat"), (1, 0, 1, "a c"), (1, 0, 2, "at end"), (1, 0, 3, "the ca-"), (1, 0, 4, "t sat"), (2, 0, 0, "none")],
                                  "doc_id int, page int, line int, text string")
    hits = search.exact_hits(lines, "cat")
    got = {r["line"]: (r["text"], r["edits"]) for r in search.edited_lines(lines, hits, "dog$1").collect()}
    assert got == {0: ("dog$1 and dog$1, condog$1", 3), 3: ("the dog$1", 1), 4: ("dog$1 sat", 1)}
    both = search.exact_hits(lines, "cat, concat a")
    assert {r["line"]: r["text"] for r in search.edited_lines(lines, both, "X").collect()} == {0: "cat and X", 1: "X c"}


def test_every_relaxed_hit_has_a_context(spark):
    text = ["some wor", "d is here, w o r d", "and w", "ord"]
    chars = [(1, 0, 0, ln, seq, c, 5.0 * seq, 20.0 * ln, 5.0 * seq + 5, 20.0 * ln + 10) for ln, t in enumerate(text) for seq, c in enumerate(t)]
    df = spark.createDataFrame(chars, "doc_id int, page int, block int, line int, seq int, c string, x0 double, y0 double, x1 double, y1 double")
    hits = search.relaxed_hits(df, "word")
    found = {(r["hit"], r["part"]): (r["context"], r["at"], r["size"]) for r in search.hit_contexts(hits, runs.runs_of(df), "word").collect()}
    assert found == {(0, 0): ("some wor", 5, 3), (0, 1): ("d is here, w o r d", 0, 1), (1, 0): ("d is here, w o r d", 11, 7), (2, 0): ("and w", 4, 1), (2, 1): ("ord", 0, 3)}


def test_a_line_of_many_hits(spark):
    rng = random.Random(4)
    words = [rng.choice(["a@b.com", "123-4567", "03-1234-5678", "4111 1111 1111 1111", "x"]) for _ in range(20_000)]
    line = "；".join(words)
    found = privacy.find_personal_info(spark.createDataFrame([(1, line)], "k int, text string"), ["k"]).collect()
    kind = {"a@b.com": "email", "123-4567": "postal", "03-1234-5678": "phone", "4111 1111 1111 1111": "card"}
    at, want = 0, []
    for w in words:
        if w in kind:
            want.append((at, at + len(w), kind[w], w))
        at += len(w) + 1
    assert sorted((r["start"], r["end"], r["kind"], r["text"]) for r in found) == want


def test_hits_free_of_others_equal_the_pairwise_test(spark):
    rng = random.Random(8)

    def disjoint():
        out, at = [], 0
        while at < 400:
            at += rng.randint(0, 12)
            size = rng.randint(1, 15)
            out.append((at, at + size))
            at += size
        return out

    data = [(i, disjoint(), disjoint()) for i in range(40)] + [(40, [], [(1, 2)]), (41, [(1, 2)], [])]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(data, f"k int, h {kind}, t {kind}").select("k", privacy.free_of(F.col("h"), F.col("t")).alias("f"))
    got = {r["k"]: [tuple(x) for x in r["f"]] for r in df.collect()}
    for k, hits, taken in data:
        assert sorted(got[k]) == [h for h in hits if not any(h[0] < t[1] and t[0] < h[1] for t in taken)]


def test_scan_and_pieces_across_their_blocks(spark):
    text = "".join(random.Random(1).choice("abcé 1") for _ in range(9000))
    spots = [(m.start(), m.end()) for m in re.finditer("[abc]+", text)] + [(0, 9000), (4090, 4100), (100, 8500)]
    df = spark.createDataFrame([(text, spots, list(range(1000)))], "t string, s array<struct<start:int,end:int>>, n array<int>")
    r = df.select(pieces_at(F.col("t"), F.col("s")).alias("p"), scan(F.col("n"), F.lit(0), lambda a, x: a + x).alias("sums"),
                  F.transform(find_all(F.col("t"), "[abc]+"), lambda h: h["end"]).alias("ends")).first()
    assert r["p"] == [text[a:b] for a, b in spots] and r["ends"] == [b for _, b in spots[:-3]]
    assert r["sums"] == [i * (i + 1) // 2 for i in range(1000)]


def test_sum_through_a_table_of_far_apart_keys(spark):
    rng = random.Random(6)
    keys = rng.sample(range(-10**15, 10**15), 500)
    df = spark.createDataFrame([(k, rng.randint(0, 9)) for k in keys], "k bigint, v int")
    total, want = 0, {}
    for r in sorted(df.collect()):
        total += r["v"]
        want[r["k"]] = total
    assert {r["k"]: r["s"] for r in scale.running_through(df, "k", F.col("v"), "s").collect()} == want
    assert scale.running_through(df.limit(0), "k", F.col("v"), "s").count() == 0
    book = spark.createDataFrame([(d * 10**12, p) for d in range(4) for p in range(d + 1)], "doc_id bigint, page int")
    labels = pages.bates(book, "A", production=True)
    assert sorted(r["label"] for r in labels.collect()) == [f"A{n:06d}" for n in range(1, 11)]
    assert "SinglePartition" not in labels._jdf.queryExecution().executedPlan().toString()


def test_sheet_names_are_those_of_one_after_the_other(spark):
    from folioframe.functions.sheet import sheet_base_name

    rng = random.Random(9)
    names = [rng.choice(["A", "a", "A_2", "a_2_2", "Sheet", "", "x" * 40, "x" * 29 + "_2", "x" * 31, "B/C", "B_C", "'B_C'", "A_3"]) for _ in range(120)]
    table = spark.createDataFrame([(i % 3, i, n) for i, n in enumerate(names)], "doc_id int, seq int, name string")
    base = {r["seq"]: r["b"] for r in table.select("seq", sheet_base_name(F.col("name")).alias("b")).collect()}
    want, taken = {}, {k: set() for k in range(3)}
    for i in range(120):
        name, n = base[i], 2
        while name.lower() in taken[i % 3]:
            name = base[i][: 31 - len(f"_{n}")] + f"_{n}"
            n += 1
        taken[i % 3].add(name.lower())
        want[i] = name
    assert {r["seq"]: r["sheet"] for r in tables.sheet_names(table).collect()} == want


def test_collation_takes_any_number_of_names(spark):
    from folioframe.operators import forms

    data = [(d, 0, i, f"n{(i * 7 + d) % 500}", f'v"{d}') for d in range(3) for i in range(400)] + [(9, 0, 0, "", "unnamed"), (0, 1, 0, "n0", "last")]
    fields = spark.createDataFrame(data, "doc_id bigint, page int, seq int, name string, value string")
    order = []
    for _, _, _, name, _ in sorted(data[:-2]):
        if name not in order:
            order.append(name)
    labels = spark.createDataFrame([(d, f"f{d}") for d in (0, 1, 2, 9)], "doc_id bigint, name string")
    lines = {r["doc_id"]: r["line"] for r in forms.collate_lines(fields, labels).collect()}
    assert lines[None] == ",".join(["ファイル", *order]) and lines[9] == "f9" + "," * len(order)
    held = {(d, n): v for d, _, _, n, v in sorted(data) if n}
    for d in range(3):
        assert lines[d] == ",".join([f"f{d}", *['"' + held[d, n].replace('"', '""') + '"' if '"' in held.get((d, n), "") else held.get((d, n), "") for n in order]])

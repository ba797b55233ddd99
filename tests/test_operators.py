"""Operators on small fixtures, against hand-worked results and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import compare, documents, forms, layout, pages, privacy, review, scale, search, tables, takeoff
from folioframe.streaming import edits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def page_rows(spark, counts, width=595.0, height=842.0, size=100):
    data = [(d, p, width, height, 0, size) for d, n in counts.items() for p in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, page int, width double, height double, rotation int, bytes bigint")


@pytest.mark.parametrize("width, levels", [(3, 1), (4, 2), (1000, 1)])
def test_running_matches_plain_walk(spark, width, levels):
    rng = random.Random(5)
    data = [(k, p, rng.randint(-5, 9)) for k in (1, 2) for p in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(data, "k int, p int, v int")
    got = scale.running(df, ["k"], "p", {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, width, levels)
    want = []
    for k in (1, 2):
        seen = []
        for _, p, v in [d for d in data if d[0] == k]:
            seen.append(v)
            want.append((k, p, sum(seen), min(seen), max(seen)))
    assert rows(got, "k", "p", "s", "lo", "hi") == want
    before = {(k, p): None for k, p, _ in data}
    for (a, b) in zip(data, data[1:]):
        if a[0] == b[0]:
            before[(b[0], b[1])] = a[2]
    prev = scale.previous(df, ["k"], "p", ["v"], width=width, levels=levels)
    assert {(r["k"], r["p"]): r["prev_v"] for r in prev.collect()} == before


def test_personal_data_vectors(spark):
    lines = ["電話 ０３－１２３４－５６７８ 携帯 090-1234-5678", "mail: taro.yamada@example.co.jp", "〒100-0001 東京都", "番号 1234-5678-9018",
             "Visa 4111 1111 1111 1111", "order 1234-5678-9012 total 123456789012 2024-03-05 12,340,000"]
    df = spark.createDataFrame(list(enumerate(lines)), "ln int, text string")
    found = rows(privacy.find_personal_info(df, ["ln"]), "ln", "kind", "text")
    assert found == [(0, "phone", "090-1234-5678"), (0, "phone", "０３－１２３４－５６７８"), (1, "email", "taro.yamada@example.co.jp"),
                     (2, "postal", "〒100-0001"), (3, "mynumber", "1234-5678-9018"), (4, "card", "4111 1111 1111 1111")]
    only = privacy.find_personal_info(df, ["ln"], ["postal"])
    assert rows(only, "ln", "kind") == [(2, "postal")]


def test_takeoff_vectors(spark):
    m = "struct<kind:string,value:double,unit:string>"
    data = [(0, "床", None, ("area", 25.0, "m"), "#ff0000", 0), (2, "床", None, ("area", 10.5, "m"), "#00ff00", 1), (1, "", None, ("distance", 3.0, "m"), None, 2),
            (0, "扉", "count", None, "#0000ff", 3), (0, "扉", "count", None, "#0000ff", 4), (0, "x", None, None, None, 5)]
    df = spark.createDataFrame(data, f"page int, subject string, tool string, measure {m}, stroke string, seq int").withColumn(
        "style", F.struct("stroke"))
    got = takeoff.summarise(df)
    assert rows(got, "label", "count", "total", "kind", "unit", "summable") == [
        ("床", 2, 35.5, "area", "m²", True), ("扉", 2, 0.0, "count", "", False), ("距離", 1, 3.0, "distance", "m", True)]
    assert [r["pages"] for r in got.where("label = '床'").collect()] == [[1, 3]]
    assert takeoff.totals(got).first().asDict() == {"groups": 3, "items": 5}


@pytest.mark.parametrize("spec, want", [("1-2, 3-", [[0, 1], [2]]), ("１〜２、３", [[0, 1], [2]]), ("9", None), ("", None), ("3-1", None), ("x", None), ("-", [[0, 1, 2]])])
def test_page_ranges(spark, spec, want):
    got = pages.parse_ranges(spark.createDataFrame([(1, spec, 3)], "doc_id int, spec string, pages int")).collect()
    if want is None:
        assert [r["page"] for r in got] == [None] and got[0]["error"]
    else:
        groups = {}
        for r in sorted(got, key=lambda r: r["pos"]):
            groups.setdefault(r["grp"], []).append(r["page"])
        assert list(groups.values()) == want


def test_booklet_vectors(spark):
    got = pages.booklet(page_rows(spark, {5: 5, 8: 8}))
    sides = {}
    for d, side, slot, page in rows(got, "doc_id", "side", "slot", "page"):
        sides.setdefault(d, {}).setdefault(side, []).append(page)
    assert list(sides[5].values()) == [[-1, 0], [1, -1], [-1, 2], [3, 4]]
    assert list(sides[8].values()) == [[7, 0], [1, 6], [5, 2], [3, 4]]


@pytest.mark.parametrize("n, back, order", [(6, True, [0, 5, 1, 4, 2, 3]), (5, True, [0, 4, 1, 3, 2]), (5, False, [0, 3, 1, 4, 2])])
def test_duplex_vectors(spark, n, back, order):
    got = pages.duplex_order(page_rows(spark, {1: n}), back)
    assert [p for _, p in rows(got, "new_page", "page")] == order


def test_replace_and_spreads(spark):
    old = page_rows(spark, {1: 4})
    targets = spark.createDataFrame([(1, 1), (1, 3)], "doc_id bigint, page int")
    got = pages.replace_pages(old, targets, page_rows(spark, {1: 3}), first=1)
    assert rows(got.na.fill(-1), "page", "source_page") == [(0, -1), (1, 1), (2, -1), (3, 2)]
    short = pages.replace_pages(old, targets, page_rows(spark, {1: 2}), first=1)
    assert {r["error"] for r in short.collect()} == {"source too short"}
    wide = page_rows(spark, {1: 1}, 842.0, 595.0).unionByName(page_rows(spark, {1: 2}).where("page = 1"))
    cut = pages.split_spreads(wide, right_to_left=True)
    assert rows(cut, "new_page", "page", "half") == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    assert cut.where("new_page = 0").first()["box"] == [421.0, 0.0, 842.0, 595.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_split_by_size_is_greedy(spark, seed):
    rng = random.Random(seed)
    sizes = {d: [rng.choice([0, 10, 30, 70, 250]) for _ in range(rng.randint(1, 30))] for d in range(6)}
    df = spark.createDataFrame([(d, p, b) for d, bs in sizes.items() for p, b in enumerate(bs)], "doc_id bigint, page int, bytes bigint")
    want = []
    for d, bs in sizes.items():
        start, part = 0, 0
        while start < len(bs):
            end = start
            while end + 1 < len(bs) and sum(bs[start:end + 2]) <= 200:
                end += 1
            want.append((d, part, start, end))
            start, part = end + 1, part + 1
    assert rows(pages.split_by_size(df, 200), "doc_id", "part", "a", "b") == sorted(want)


def test_outline_repair_matches_walk(spark):
    rng = random.Random(3)
    data = [(d, s, rng.randint(-1, 6), "t", rng.randint(-2, 9)) for d in range(5) for s in range(20)]
    toc = spark.createDataFrame(data, "doc_id bigint, seq int, level int, title string, page int")
    counts = toc.select("doc_id").distinct().withColumn("pages", F.lit(6))
    want, last = [], {}
    for d, s, level, _, page in data:
        level = min(max(1, level), last.get(d, 0) + 1)
        last[d] = level
        want.append((d, s, level, max(1, min(6, page))))
    assert rows(documents.repair_outline(toc, counts), "doc_id", "seq", "level", "page") == want


def test_touching_cells_match_flood_fill(spark):
    rng = random.Random(7)
    cells = {(x, y) for x in range(14) for y in range(14) if rng.random() < 0.55}
    df = spark.createDataFrame([(1, 0, x * 12, y * 12, x * 12 + 12, y * 12 + 12) for x, y in cells], "doc_id bigint, page int, x0 int, y0 int, x1 int, y1 int")
    want, left = [], set(cells)
    while left:
        stack = [left.pop()]
        group = list(stack)
        while stack:
            x, y = stack.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.discard(n)
                    stack.append(n)
                    group.append(n)
        xs, ys = [g[0] for g in group], [g[1] for g in group]
        want.append((min(xs) * 12, min(ys) * 12, max(xs) * 12 + 12, max(ys) * 12 + 12))
    assert rows(compare.merge_touching(df), "x0", "y0", "x1", "y1") == sorted(want)


def line_df(spark, lines):
    data = [(1, 0, b, b, 0, t, "F", s, 16 if bold else 0, 0, x0, y0, x0 + len(t) * s * 0.5, y0 + s) for b, (t, s, bold, x0, y0) in enumerate(lines)]
    return spark.createDataFrame(data, "doc_id bigint, page int, block int, line int, span int, text string, font string, size double, flags int, color int, "
                                       "x0 double, y0 double, x1 double, y1 double")


def test_paragraphs_and_joined_text(spark):
    lines = [("this line is long enough to reach the right edge of it", 10.0, False, 50.0, 100.0), ("and this one stops", 10.0, False, 50.0, 113.0),
             ("1. an item", 10.0, False, 50.0, 126.0), ("far away", 10.0, False, 50.0, 300.0)]
    blocks = layout.blocks_of(layout.lines_of(line_df(spark, lines)))
    assert rows(layout.merge_paragraphs(blocks), "para", "blocks") == [(0, [0, 1]), (1, [2]), (2, [3])]
    one = line_df(spark, [("a hyphen-", 10.0, False, 50.0, 100.0), ("ated word that is long", 10.0, False, 50.0, 113.0), ("• item", 10.0, False, 50.0, 126.0)])
    joined = layout.join_block_lines(layout.blocks_of(layout.lines_of(one.withColumn("block", F.lit(0)))))
    assert joined.first()["text"].startswith("a hyphen")
    assert joined.first()["text"].endswith("\n• item")


def test_rows_on_a_baseline(spark):
    lines = [("label", 10.0, False, 50.0, 100.0), ("below", 10.0, False, 50.0, 120.0), ("value", 10.0, False, 200.0, 101.0), ("x", 10.0, False, 79.0, 120.0)]
    pieces = layout.merge_baselines(line_df(spark, lines).withColumn("block", F.lit(0)))
    assert rows(layout.row_texts(pieces), "row", "text") == [(0, "label\tvalue"), (1, "below x")]
    two = tables.text_tables(layout.merge_baselines(line_df(spark, [
        ("a", 10.0, False, 50.0, 100.0), ("b", 10.0, False, 200.0, 100.0), ("c", 10.0, False, 52.0, 120.0), ("1,200", 10.0, False, 204.0, 120.0)]).withColumn("block", F.lit(0))))
    assert rows(two, "row", "col", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "1,200")]


def test_bold_headings_stand_alone(spark):
    body = [("plain text of the body, long enough to count for something", 10.0, False, 50.0, 60.0 + 14 * i) for i in range(8)]
    lines = body[:3] + [("Chapter one", 10.0, True, 50.0, 140.0), ("text after it", 10.0, False, 50.0, 154.0), ("Q3", 10.0, True, 50.0, 200.0),
                        ("same line", 10.0, True, 50.0, 240.0), ("more", 10.0, False, 200.0, 241.0), ("runs on", 10.0, True, 50.0, 168.0)]
    ls = layout.outline_lines(layout.lines_of(line_df(spark, lines)))
    body_size = ls.select("doc_id").distinct().withColumn("body", F.lit(10.0))
    alone = layout.standalone_bold(ls, body_size).join(ls, ["doc_id", "page", "at"])
    assert rows(alone, "text") == [("Chapter one",)]


def test_search_is_relaxed_and_overlapping(spark):
    data = []
    for ln, textline in enumerate(["契 約 金", "額 aa a b"]):
        for i, c in enumerate(textline):
            data.append((1, 0, 0, ln, i, c, 10.0 * i, 20.0 * ln, 10.0 * i + 10, 20.0 * ln + 10))
    chars = spark.createDataFrame(data, "doc_id bigint, page int, block int, line int, seq int, c string, x0 double, y0 double, x1 double, y1 double")
    hits = search.relaxed_hits(chars, "契約 金額")
    assert rows(hits, "hit", "part", "x0", "y0", "x1") == [(0, 0, 0.0, 0.0, 50.0), (0, 1, 0.0, 20.0, 10.0)]
    assert len(search.relaxed_hits(chars, "aa").select("hit").distinct().collect()) == 2


def test_replies(spark):
    marks = spark.createDataFrame([(1, "a", None), (1, "b", "accepted")], "doc_id bigint, id string, state string")
    answers = spark.createDataFrame([(1, "a", 1, None, "hi"), (1, "a", 2, "rejected", ""), (1, "a", 3, "completed", ""), (1, "b", 4, "none", ""), (1, "z", 5, None, "lost")],
                                    "doc_id bigint, in_reply_to string, seq bigint, state string, contents string")
    got, orphans = review.thread_replies(marks, answers)
    assert {(r["id"], r["state"], r["replies"]) for r in got.collect()} == {("a", "completed", 1), ("b", None, 0)}
    assert rows(orphans, "contents") == [("lost",)]
    same = review.baseline_diff(got.withColumns({"type": F.lit("note"), "form": F.lit("x")}), got.withColumns({"type": F.lit("note"), "form": F.lit("x")}))
    assert {r["action"] for r in same.collect()} == {"unchanged"}


def test_form_text_keeps_the_first_parenthesis(spark):
    text = "<< /T (a) /V (x) >>\n<< /T (b) /V (y\\) z) >>\n<< /T (c) >>"
    got = forms.read_values(spark.createDataFrame([(1, text), (2, '{"n": "v"}')], "doc_id bigint, text string"))
    assert rows(got, "doc_id", "name", "value") == [(1, "a", "x"), (1, "b", "y\\"), (2, "n", "v")]
    lines = [(1, 0, i, "s", 50.0, y, 50.0 + w, y + h) for i, (y, w, h) in enumerate([(100.0, 200.0, 1.0), (95.0, 200.0, 20.0), (300.0, 30.0, 1.0), (400.0, 100.0, 20.0)])]
    drawings = spark.createDataFrame(lines, "doc_id bigint, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert rows(forms.detect(drawings), "y0", "y1") == [(82.0, 100.0), (400.0, 420.0)]


def test_list_markers(spark):
    paras = spark.createDataFrame([(1, i, 0, 0, lv, None) for i, lv in enumerate([0, 1, 1, 0, 1, 2, 1])], "doc_id bigint, seq bigint, list_id bigint, num_id bigint, lvl int, override_start int")
    levels = spark.createDataFrame([(1, 0, 0, "upperRoman", "%1.", 1), (1, 0, 1, "decimal", "%1.%2", 1), (1, 0, 2, "lowerLetter", "%3)", 1)],
                                   "doc_id bigint, list_id bigint, lvl int, fmt string, template string, start int")
    got = [m for _, m in rows(tables.list_markers(paras, levels), "seq", "marker")]
    assert got == ["I.", "I.1", "I.2", "II.", "II.1", "a)", "II.2"]


def test_stream_of_sessions_is_the_batch_of_closed_ones(spark, data):
    from folioframe.plans import catalogue

    batch = catalogue.QUERIES["edit_sessions"](spark, data)
    stream = catalogue.QUERIES["edit_sessions_stream"](spark, data)
    done = {(r["doc_id"], r["first_seq"], r["last_seq"], r["edits"]) for r in stream.collect()}
    every = {(r["doc_id"], r["first_seq"], r["last_seq"], r["edits"]) for r in batch.collect()}
    assert done and done <= every and len(every - done) < len(every) * 0.1


def test_requests_come_out_in_order(spark, data):
    from folioframe.plans import catalogue

    out = catalogue.QUERIES["ordered_requests_stream"](spark, data)
    assert out.count() == spark.read.parquet(f"{data}/conversations.parquet").count()
    assert edits.current_marks is not None


def test_personal_data_across_visual_lines_is_redacted(spark, tmp_path):
    """A card number and an address that the 80-character layout cuts in two, and one address that it leaves whole."""
    from folioframe.plans import privacy as plans

    card, mail, near = "4111 1111 1111 1111", "someone.long@example.org", "a@example.com"
    text = "first\n" + "x" * 69 + " " + card + " " + "y" * 58 + " " + mail + " end\n\n" + near + " z"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    marks = plans.pii_redaction_marks(spark, str(tmp_path)).collect()
    assert len(marks) == 5
    left = {r["line"]: r["text"] for r in plans.redacted_lines(spark, str(tmp_path)).collect()}
    assert "".join(left[k] for k in sorted(left)) == "first" + "x" * 69 + "  " + "y" * 58 + "  end z"

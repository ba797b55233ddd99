"""Filter audit, fill-in-middle and near-duplicate groups against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from folioframe.llm import fill_middle, filter_audit, language, licenses, near_dedup, ngram_join, queries, toxicity

DOCS = "doc_id bigint, text string, lang string, n bigint, form string, part string, node int, bucket int, key string, mask int, root int, output int"
WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(a, b, c, *[None] * 9) for a, b, c in rows], DOCS).repartition(3)


def odd_rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeéüÄZ") for _ in range(rnd.randint(1, 7)))
    base = [word() for _ in range(120)]
    long = " ".join(word() for _ in range(40_000))
    texts = [None, "", " \t\n ", "one", "two  words\n", " lead", "日本語 🙂 x　y\x85z\x1c ", long, " ".join(base), "\n".join(base),
             " ".join(base[:110]) + " # end", "A<P>b c d", "x <S>", "SHOUT LOUD " * 60, "same " * 300, "<P", "P> <M", "a " * 100]
    rows = [(i * 7, t, [None, "en", "", "fr"][i % 4]) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, " ".join(base), "en"), (None, None, None), (7, "another text of a repeated key here", "en"), (1000, "A<P>b c d", "de")]


# ---------------------------------------------------------------- 11: filter audit

def brute_audit(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for key, q, t in labels:
        good[key] |= q == 1
        toxic[key] |= t == 1
    firsts = {}
    for key, text, _ in rows:
        if key is not None:
            firsts[text or ""] = min(firsts.get(text or "", key), key)
    parts = defaultdict(list)
    for key, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and firsts[text] < key}
        parts[lang or ""].append(({f for f in fails if fails[f]}, int(good[key]) if key is not None else 0, int(toxic[key]) if key is not None else 0))
    out = {}
    for part, held in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in held) - len(gone),
                                                   sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(share[f])
    return out


def found_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.REPORT] for r in df.collect()}


def test_audit_equals_applying_all_orders(spark, data):
    rows = odd_rows()
    labels = [(0, 1, 0), (7, 0, 1), (7, 1, None), (56, 1, 1), (56, 1, 1), (None, 1, 1), (9999, 1, 1), (91, None, None)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert found_audit(filter_audit.audit(table(spark, rows), marks)) == brute_audit(rows, labels)
    assert filter_audit.audit(table(spark, []), marks).count() == 0
    none = found_audit(filter_audit.audit(table(spark, rows), marks.limit(0)))
    assert all(v[4] == v[5] == 0 for v in none.values()) and len(none) == 600 * len({r[2] or "" for r in rows})
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    given = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found_audit(queries.QUERIES["op11_filter_audit"](spark, data)) == brute_audit(docs, given)


def test_survivors_of_all_subsets():
    import numpy as np

    counts = np.random.default_rng(3).integers(0, 50, (32, 3))
    states = filter_audit.survivors(counts)
    for subset in range(32):
        assert (states[subset] == sum((counts[m] for m in range(32) if m & subset == 0), np.zeros(3, int))).all()


# ---------------------------------------------------------------- 12: fill in the middle

def brute_middle(key, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    parts = SPACE.findall(text)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_equals_brute_force_and_comes_back(spark):
    texts = [r[1] for r in odd_rows()]
    rows = odd_rows() + [(i, texts[i % len(texts)], None) for i in range(2000, 2400)]
    df = table(spark, rows)
    turned = fill_middle.restore(fill_middle.rewrite(df))
    assert set(turned.columns) == {*df.columns, "prefix_chars", "middle_chars", "restored"}
    found = turned.collect()
    assert len(found) == len(rows) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_middle(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert fill_middle.restore(fill_middle.rewrite(table(spark, []))).count() == 0


def test_rotations_at_the_edges():
    text = "ab <é> c".encode()
    for form in ("psm", "spm"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                out = bytes(fill_middle.arranged(text, a, b, form))
                p, m, s = b"<P>" + text[:a], b"<M>" + text[a:b], b"<S>" + text[b:]
                assert out == (p + s + m if form == "psm" else s + p + m) and fill_middle.restored(out, form) == text


# ---------------------------------------------------------------- 13: near duplicates

def brute_groups(rows, words=4, percent=80):
    sets = []
    for _, text, _ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return Counter((key, len(sets[i]), key if not sets[i] else least.get(top(i)), key == (key if not sets[i] else least.get(top(i))))
                   for i, (key, *_) in enumerate(rows))


def same_groups(df, rows):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()) == brute_groups(rows)


def test_near_duplicates_of_odd_rows(spark):
    assert same_groups(near_dedup.groups(table(spark, odd_rows())), odd_rows())
    assert near_dedup.groups(table(spark, [])).count() == 0
    alone = [(1, None, None), (1, "", None), (None, " ", None), (2, "", None)]
    assert same_groups(near_dedup.groups(table(spark, alone)), alone)


def test_near_duplicates_on_given_tables(spark, data):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert same_groups(queries.QUERIES["op13_minhash_near_dedup"](spark, data), rows)


@pytest.mark.parametrize("block", [8, 128])
def test_chains_are_whole_whatever_the_center(spark, monkeypatch, block):
    """Neighbours of a chain are similar, its ends are not, and the least node of a bucket may be similar to few others."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", 2 * block)
    rnd = random.Random(4)
    rows, key = [], 0
    for chain in range(6):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        for step in range(25):
            rows.append((key, " ".join(words), None))
            words = list(words)
            words[(step * 7) % 60] = f"n{rnd.randrange(10**6)}"
            key += 1
        for _ in range(5):  # unrelated
            rows.append((key, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(50)), None))
            key += 1
    rnd.shuffle(rows)
    assert same_groups(near_dedup.groups(table(spark, rows)), rows)


def test_rest_and_star_links_find_every_pair_between_components(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 40, dtype=np.uint64)
    sets = []
    for _ in range(300):
        own = base.copy()
        own[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(0, 2**60, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node bigint, grams binary")
    star = {(r["node"], r["center"]) for r in near_dedup.star_links(spark.createDataFrame([(i, i % 3) for i in range(3, 300)], "node bigint, center bigint"), held, 80).collect()}
    assert star == {(i, i % 3) for i in range(3, 300) if similar(sets[i], sets[i % 3])}
    rest = spark.createDataFrame([(5, i, i) for i in range(300)] + [(6, i, 0) for i in range(300)], "bucket bigint, node bigint, root bigint")
    root = list(range(300))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    links = near_dedup.rest_links(rest, held, 80)
    found = {r["node"]: r["root"] for r in near_dedup._merged(None, links).collect()}
    assert {i: found.get(i, i) for i in range(300)} == {i: top(i) for i in range(300)}
    assert links.where(F.col("node") == F.col("center")).count() < links.count()


def test_keys_for_the_wanted_recall():
    m = near_dedup.keys_for(80, 0.9999)
    assert (1 - (1 - 0.8 ** 2) ** m) ** 2 >= 0.9999 > (1 - (1 - 0.8 ** 2) ** (m - 1)) ** 2


# ---------------------------------------------------------------- earlier operators: what was lost or wrong

def notice(label, first=True):
    return next(t for n, t in (licenses.NOTICES if first else licenses.NOTICES[::-1]) if n == label)


def test_notices_between_stray_hits_and_no_false_labels(spark):
    stray = " ".join(["the software"] * 100)
    texts = {1: f"{stray} {notice('mit')} {stray}", 2: notice("lgpl"), 3: notice("cc-by"), 4: notice("cc-by-sa"), 5: notice("gpl"), 6: stray,
             7: f"{notice('mit')} {notice('mit')}", 8: f"{notice('isc')} x {notice('apache')}", 9: None, 10: notice("bsd").upper()}
    rows = spark.createDataFrame([(k, t, 77) for k, t in texts.items()], "doc_id bigint, text string, row bigint")
    found = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert {k: r["labels"] for k, r in found.items()} == {1: "mit", 2: "lgpl", 3: "cc-by", 4: "cc-by-sa", 5: "gpl", 6: "", 7: "mit",
                                                          8: "apache,isc", 9: "", 10: "bsd"}
    assert {r["row"] for r in found.values()} == {77}
    spans = licenses.spans(rows).where("verified and not phrase and row is not null").collect()
    assert sum(r["label"] == "mit" for r in spans) == 3


def test_base_places_and_planted_notices_of_a_whole_table(spark, data):
    rnd = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for i, (key, text) in enumerate(rows):
        if i % 4 == 0:
            label, words = rnd.choice([n for n in licenses.NOTICES if len(n[1].split()) > 20])
            broken = words.split()
            broken.insert(rnd.randrange(5, len(broken) - 5), "inserted")
            planted[key] = label
            rows[i] = (key, (text or "") + "\n" + " ".join(broken) + "\n" + (text or "")[:500])
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    word = re.compile(licenses.WORD)
    for key, text in rows:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split())
        r = found[key]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)) and r["base_labels"] == ",".join(sorted({x[1] for x in at}))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["labels"] == ",".join(sorted({x[1] for x in at} | ({planted[key]} if key in planted else set())))


def test_samples_are_bounded_whatever_repeats(spark):
    rows = spark.createDataFrame([(1, f"t{i}", "en") for i in range(20_000)] + [(i, "x", "en") for i in range(2, 900)], "doc_id bigint, text string, lang string")
    for seed in ("doc_id", "lang"):
        assert language.sample(rows, "lang", F.col(seed).cast("string"), 250).count() == (250 if seed == "doc_id" else 1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, label int")
    docs = spark.createDataFrame([(i % 40, f"word{i} bad" if i % 2 else f"good{i}") for i in range(4000)], "doc_id bigint, text string")
    assert toxicity.train(docs, labels) is not None


def test_separator_texts_stay_in_the_near_duplicate_stage(spark):
    rows = [(1, "\x1c\x1d"), (2, "\x1c"), (3, ""), (4, None), (5, "a b c d e f"), (6, "a b c d e f"), (7, "\x01"), (8, "\x01"), (9, "　\x85")]
    kept = ngram_join.first_of_groups(spark.createDataFrame([(*r, "k", "i") for r in rows], "doc_id bigint, text string, text_key string, _id string"))
    assert kept.columns == ["doc_id", "text", "text_key", "_id"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 9]

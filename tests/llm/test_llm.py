"""The training-data operators against brute force, exact round trips and held-out rows, on small tables with odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import byte_bpe, fingerprints, language, licenses, mixing, nearest, ngram_join, quality, queries, token_files, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score int, row int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows, a repeated key, and names that operators use themselves."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    base = [word() for _ in range(60)]
    near = base[:58] + ["other", "end"]
    texts = [None, "", "   \n\t ", "one", "Hello, world!  It's 日本語 🙂\n\n x　y\x85z\x1c", long, " ".join(base), " ".join(base), " ".join(near),
             " ".join(base) + "\nmore\nMIT License here. Apache license? CC-BY 4.0", "THE gnu General Public License\nx."]
    rows = [(i, t, "en" if i % 2 else "fr", ["a", "b", None][i % 3], len(t or ""), "s", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, None, None, None, None, None, None, None), (None, "words without a key", None, "a", 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---------------------------------------------------------------- 3, 4: tokens

@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_reference_library(docs, empty, reference_encoding):
    found = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, spans=True), RANKS)
    assert found.columns == [*docs.columns, "n_tokens", "ids", "char_starts", "char_ends", "decoded"]
    for r in found.collect():
        text = r["text"] or ""
        assert list(r["ids"]) == reference_encoding.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]).decode() == text
        whole, at = reference_encoding.decode_with_offsets(r["ids"]) if text else ("", [])
        assert whole == text and all(a <= b < e for a, b, e in zip(r["char_starts"], at, r["char_ends"]))
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    packed = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, packed=True)
    two = byte_bpe.decode(packed, RANKS).select("text", "n_tokens", "ids", "decoded")
    one = byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).select("text", "n_tokens", "ids", "decoded")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert one.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).isEmpty()
    for r in byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).select("text", "n_split", "n_tokens").collect():
        parts = [reference_encoding.decode_single_token_bytes(i) for i in reference_encoding.encode_ordinary(r["text"] or "")]
        assert r["n_tokens"] == len(parts) and r["n_split"] == sum(p[0] & 0xC0 == 0x80 for p in parts)


def test_tokens_come_back_from_the_byte_table():
    data, offsets = byte_bpe.token_bytes(RANKS)
    ranks = byte_bpe.load_ranks(RANKS)
    assert all(data[offsets[r]: offsets[r + 1]].tobytes() == t for t, r in ranks.items()) and len(set(byte_bpe.byte_characters().values())) == 256


def test_byte_bpe_random_blanks_and_signs(reference_encoding):
    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab e's\n\t 1é日🙂!   \x85\x1c") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    ids, ends = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i]: ends[i + 1]].tolist() == reference_encoding.encode_ordinary(t)


def test_split_characters_are_whole_after_decoding(reference_encoding):
    ids = reference_encoding.encode_ordinary("a🙂日本é")
    assert "".join(byte_bpe.decode_parts([[i] for i in ids], RANKS)) == "a🙂日本é"


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    token_files.write(docs, str(tmp_path / "t"), path, end_id=2)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, w in zip(got, want, strict=True):
        ids = [*model.encode(w[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (w[0], start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    token_files.write(empty, str(tmp_path / "e"), path, end_id=2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_blocks_keep_any_number():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 2**32, 700), rng.integers(0, 5, 300), [7] * 10, np.array([2**32 - 1, 0]), rng.integers(0, 2**16, 999)])
    ends = np.array([0, 0, 1, 257, 900, 1012, 2011])
    payloads, starts = token_files.pack(ids, ends)
    raw, at = np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([0, *map(len, payloads)])
    back, _ = token_files.unpack(raw, np.concatenate([a + s for a, s in zip(at, starts)]).astype(np.int64))
    assert (back == ids).all()


# ---------------------------------------------------------------- 2, 7, 8: classifiers

def test_language_held_out(spark, data):
    got = queries.QUERIES["op2_language_id"](spark, data)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(docs, empty):
    model = language.train(docs)
    rows = language.predict(docs, *model).collect()
    assert len(rows) == len(odd_rows()) and all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows)
    nothing = language.train(empty)
    assert nothing[0] == [] and {r["lang_pred"] for r in language.predict(docs, *nothing).collect()} == {"und"}
    assert language.predict(empty, *model).count() == 0


def test_toxicity_learns_from_labels_and_generalises(spark, empty, docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(("la", "to", "ri", "ne", "su", "mek")) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(700):
        words = [word() for _ in range(rnd.randint(5, 120))]
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["wretchface", "gobblebrain", "snarkhole"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.train(table, table.where("doc_id < 500").select("doc_id", "label"))
    rated = toxicity.score(table.where("doc_id >= 500"), model).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["label"]) for r in rated]) > 0.95
    odd = [r["score"] for r in toxicity.score(spark.createDataFrame([("la to wretchfacee ri ne",), ("la to ri ne su",)], "text string").coalesce(1), model).collect()]
    assert odd[0] > odd[1]
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("label")))).collect()} == {0.0}


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(table)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.score(table, model).collect() if r["doc_id"] in labels]
    assert np.mean([(r["score"] >= quality.THRESHOLD) == bool(labels[r["doc_id"]]) for r in rows]) > 0.98
    assert all(a > 0.5 for a in model.accuracy.values())


def test_quality_of_odd_rows(docs, empty):
    rows = quality.score(docs, quality.train(docs)).collect()
    assert len(rows) == len(odd_rows()) and all(r["score"] == 0.5 for r in rows if not (r["text"] or "").strip())
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_quality_sample_is_of_distinct_texts(spark, monkeypatch):
    """One poor text makes up most of the poor side: its other texts are still drawn, and copies never go to the driver twice."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(("la", "to", "ri", "ne", "su")) for _ in range(rnd.randint(1, 4)))
    good = [" ".join(word() for _ in range(12)).capitalize() + ". " + " ".join(word() for _ in range(9)) + "." for _ in range(400)]
    shout = lambda: " ".join(word().upper() + rnd.choice(("|||", "###", "!!!")) for _ in range(15))
    poor = [shout() for _ in range(40)]
    table = spark.createDataFrame([(t,) for t in good + poor + [poor[0]] * 800], "text string").repartition(6)
    sizes, fit = [], quality._fit
    monkeypatch.setattr(quality, "_fit", lambda model, sample, *more: sizes.append(len(sample)) or fit(model, sample, *more))
    model = quality.train(table, per_class=20)
    assert sizes == [40] and model.weights is not None
    rows = quality.score(table, model).collect()
    assert np.mean([(r["score"] >= quality.THRESHOLD) == (r["text"] not in set(poor)) for r in rows]) > 0.97


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.8
    good = np.isin(quality.LABELLERS, ("prose", "sentences", "variety"))
    speak = np.where(y[:, None] == good[None, :], rng.random((len(y), 9)) < 0.5, rng.random((len(y), 9)) < 0.04)
    patterns, counts = np.unique(speak @ (1 << np.arange(9)), return_counts=True)
    rates, accuracy, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02 and abs(rates[1][6] - 0.5) < 0.03 and abs(rates[0][0] - 0.5) < 0.05 and accuracy.min() > 0.7


# ---------------------------------------------------------------- 5: mixing

def filled(sizes, total):
    capped, weights = np.zeros(len(sizes), bool), np.array([(3, 1, 2)[i % 3] for i in range(len(sizes))], float)
    while True:
        rest = total - 2 * sizes[capped].sum()
        aim = np.where(capped, 2 * sizes, rest * weights / max(weights[~capped].sum(), 1e-300))
        if (aim[~capped] <= 2 * sizes[~capped]).all():
            return aim
        capped |= aim > 2 * sizes


def test_mix_meets_targets(spark, docs, empty):
    for table, slack in ((spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.01), (docs, 0.01)):
        sizes = mixing.sized(table)
        mixed = mixing.mix(sizes, mixing.quotas(sizes.select("doc_id", "source", "size")))
        rows = mixed.collect()
        assert len(rows) == table.count() and all(r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
        own, taken, aim = defaultdict(int), defaultdict(int), {}
        for r in rows:
            own[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            aim[r["source"]] = r["target"]
        names = sorted(own, key=lambda s: (s is None, s or ""))
        want = filled(np.array([own[n] for n in names], float), 1.5 * sum(own.values()))
        assert np.allclose([aim[n] for n in names], want)
        assert all(abs(taken[n] - aim[n]) <= max(slack * aim[n], 2 * mixing.BLOCK) for n in names)
        again = mixing.mix(sizes, mixing.quotas(sizes.select("doc_id", "source", "size"))).groupBy("source").agg(F.sum("taken").alias("t")).collect()
        assert {r["source"]: r["t"] for r in again} == dict(taken)
        texts = mixing.taken_rows(mixed, table.columns)
        assert texts.columns == table.columns
        assert sum(len(WORD.findall(r["text"])) for r in texts.collect()) == sum(taken.values())
    sizes = mixing.sized(empty)
    assert mixing.mix(sizes, mixing.quotas(sizes)).count() == 0


def test_passages_keep_their_white_space(spark):
    text = "\n  def f(x):\n      return  x\r\n \n\tif y:\n\t\tpass\u3000z  end\tof it \n  "
    pieces = ["\n  def ", "f(x):\n", "      return  ", "x\r\n \n", "\tif ", "y:\n", "\t\tpass\u3000z  ", "end\t", "of ", "it \n  "]
    assert "".join(pieces) == text and len(WORD.findall(text)) == len(pieces)
    picks = [[5], [6], [7], [8], [9], [10], [5, 6], [6, 7, 8], [5, 7], [6, 9, 10], [5, 8, 10], [6, 7, 9], [5, 6, 7, 8, 9, 10]]
    rows = [(i, text, 10, 0, p, 5, 1) for i, p in enumerate(picks)]  # one word of block 5, then two a block, one of block 10
    table = spark.createDataFrame(rows, "doc_id int, text string, size bigint, passes bigint, picked array<bigint>, first_block bigint, offset bigint")
    got = by_id(mixing.taken_rows(table, ["doc_id", "text"], block=2))
    for i, p in enumerate(picks):
        passages, last = [], None
        for b in p:
            part = "".join(w for j, w in enumerate(pieces) if 5 + (1 + j) // 2 == b)
            passages[-1:] = [passages[-1] + part] if last == b - 1 else [*passages[-1:], part]
            last = b
        assert all(x in text for x in passages) and got[i]["text"] == "\n".join(passages)


def test_every_taken_passage_is_in_its_document(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = mixing.sized(table)
    mixed = mixing.mix(sizes, mixing.quotas(sizes, block=64), block=64)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    picked = {r["doc_id"]: r["picked"] for r in mixed.collect()}
    parts = [r for r in mixing.taken_rows(mixed, ["doc_id", "text"], block=64).collect() if r["text"] != texts[r["doc_id"]]]
    assert parts
    for r in parts:
        runs = sum(i == 0 or b != picked[r["doc_id"]][i - 1] + 1 for i, b in enumerate(picked[r["doc_id"]]))
        # One run is a substring; of several, all line ends but those between the passages are in the document.
        whole, at, cuts = texts[r["doc_id"]], 0, 0
        for line in re.split(r"(?<=\n)", r["text"]):
            found = whole.find(line, at)
            if found < 0:
                found, cuts = whole.find(line[:-1], at), cuts + 1
                assert found >= 0
            at = found + len(line.rstrip("\n"))
        assert cuts <= runs - 1


def test_apportionment_equals_highest_quotients(spark):
    rnd = random.Random(4)
    rows = [(g, i, float(rnd.choice([0, 1, 5, 5, 80, 1000, 12345])), rnd.choice([0, 1, 7, 100]) if i == 0 else None) for g in range(30) for i in range(rnd.randint(1, 12))]
    seats = {g: s for g, i, _, s in rows if i == 0}
    table = spark.createDataFrame([(g, i, w, seats[g]) for g, i, w, _ in rows], "g int, i int, w double, seats bigint")
    got = {(r["g"], r["i"]): r["n"] for r in mixing.apportion(table, ["g"], "w", "seats", "i", "n").collect()}
    for g, n in seats.items():
        mine = [(i, w) for a, i, w, _ in rows if a == g]
        quotients = sorted(((-w / (2 * j + 1), i) for i, w in mine if w > 0 for j in range(n)))[:n]
        for i, _ in mine:
            assert got[g, i] == sum(q[1] == i for q in quotients)


# ---------------------------------------------------------------- 6: n-gram join

def brute_groups(rows, n=5, limit=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= limit] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            for j in near:
                group[i] = group[j] = min(group[i], group[j])
    return [len(x) for x in links], group


def test_join_equals_brute_force(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.randint(1, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(base[i % 12]) if i % 3 else list(base[0])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(w) if i % 41 else rnd.choice([None, "", " "])))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = by_id(ngram_join.join(table))
    links, group = brute_groups(rows)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["class_id"]) == (links[i], min(j for j in range(len(rows)) if group[j] == group[i]))
    stay = {r["doc_id"] for r in ngram_join.first_of_groups(table).collect()}
    assert stay == {i for i, t in rows if not (t or "").strip() or got[i]["class_id"] == i}


def test_hot_group_is_cut_into_blocks(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], f"z{i}"])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = ngram_join.classes(table, "doc_id", "text", 5, 29, 5)
    links = ngram_join.linked(table, signed, block=32).groupBy("text_key").agg(F.sum("links").alias("n")).collect()
    assert len(links) == 400 and {r["n"] for r in links} == {399}


def test_join_of_odd_rows(docs, empty):
    rows = ngram_join.join(docs).collect()
    assert len(rows) == len(odd_rows())
    kept = ngram_join.first_of_groups(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (6, 7, 8)) == [6]
    assert sum(not (r["text"] or "").strip() for r in kept.collect()) == 4
    assert ngram_join.join(empty).count() == 0 and ngram_join.first_of_groups(empty).count() == 0


# ---------------------------------------------------------------- 9: licences

def test_license_places(docs, empty):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r["doc_id"] == 9:
            assert (r["n_base"], r["base_labels"], r["score"]) == (3, "apache,cc-by,mit", 1.0) and r["first_word"] == 61
        if r["doc_id"] == 10:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (6, 1, 1, 1, "gpl")
        if not (r["text"] if "text" in r else None) and r["n_words"] == 0:
            assert (r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, None, "", 0.0)
    assert licenses.scan(empty).count() == 0


def test_broken_notice_is_found(spark):
    words = dict(licenses.NOTICES[::-1])["mit"].split()
    broken = " ".join(["before"] * 30 + words[:12] + ["extra", "words"] + words[12:30] + words[31:] + ["after"] * 9)
    rows = licenses.scan(spark.createDataFrame([(1, broken), (2, " ".join(reversed(words)))], "doc_id bigint, text string"))
    assert {r["doc_id"]: r["labels"] for r in rows.collect()} == {1: "mit", 2: ""}


# ---------------------------------------------------------------- 10: fingerprints

def runs(block):
    """Words with the blanks after them, blanks alone, and the characters of words too long; each with what decides on a cut before it."""
    i = 0
    while i < len(block):
        word = i
        while word < len(block) and block[word] not in " \t":
            word += 1
        if word - i > 24:
            yield block[i], block[i: i + 25], 63
            i += 1
            continue
        after = word
        while after < len(block) and block[after] in " \t":
            after += 1
        yield block[i: after], block[i: after], 15
        i = after


def pieces(text):
    """The paragraphs of a text, found without the library: sentences of long lines, and content cuts in what is still long."""
    found = set()
    for line in re.findall(r"[^\n]{100,}?(?:[.!?](?=[ \t\n]|\Z|\r\n?\Z|[\x85\u2028\u2029]\Z)|[。！？｡।॥؟۔])|[^\n]+", text):
        parts = [line]
        if len(line) > 200:
            parts = [""]
            for a in range(0, len(line), 65536):
                for run, ahead, mask in runs(line[a: a + 65536]):
                    if xxhash.xxh64_intdigest(ahead.encode(), seed=42) & mask == 0:
                        parts.append("")
                    parts[-1] += run
            parts = [p[a: a + 200] for p in parts for a in range(0, len(p), 200)]
        found |= {p.strip(" ") for p in parts if p.strip(" ")}
    return found


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, data):
    got = by_id(queries.QUERIES["op10_document_fingerprints"](spark, data))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    for i, (key, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(text, edited)) < 1e-12 and abs(r["near_next"] - likeness(text, after)) < 1e-12
    same = defaultdict(set)
    for key, text in rows:
        same[text].add(got[key]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_neighbours_and_likeness_of_odd_rows(docs, empty, spark):
    rows = fingerprints.with_next(docs)
    found = rows.collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in found), reverse=True)
    after = {o: order[(i + 1) % len(order)][2] for i, o in enumerate(order)}
    assert len(found) == len(odd_rows())
    for r in found:
        if r["doc_id"] != 6:  # repeated
            assert r["next"] == after[(r["doc_id"] is not None, r["doc_id"] or 0, r["text"])]
    near = fingerprints.compare(rows.drop("doc_id"), ["part", "row"], "text", ["next"]).count()
    assert near == len(found)
    assert fingerprints.with_next(empty).count() == 0
    many = "\n".join(f"line {i}" for i in range(3000))
    one = spark.createDataFrame([(1, many, many + "\nmore"), (2, many, "\n".join(f"row {i}" for i in range(2500)))], "k int, a string, b string")
    near = {r["k"]: r["near_b"] for r in fingerprints.compare(one, ["k"], "a", ["b"]).collect()}
    assert near[1] == 3000 / 3001 and near[2] == 0.0


def test_long_lines_without_sentences_give_several_digests(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(900)), "".join(rnd.choice("0123456789abcdef") for _ in range(5000)),
             "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(4000)), "ab " * 2000,
             "。".join("".join(chr(rnd.randrange(0x3041, 0x3090)) for _ in range(60)) for _ in range(40)),
             "".join(rnd.choice("xyz;") for _ in range(150_000))]
    other = " ".join(word() for _ in range(900))
    rows = [(i, t, t[: len(t) // 2] + other[: len(t) // 2], t[:300] + "!" + t[300:]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "k int, a string, half string, one string")
    found = by_id(table.select(F.col("k").alias("doc_id"), F.size(fingerprints.digests(F.col("a"))).alias("n"), F.array_join(F.flatten(
        F.transform(F.array("a"), fingerprints.chunks)), "").alias("back"), F.array_max(F.transform(fingerprints.chunks(F.col("a")), F.length)).alias("most")))
    near = {r["k"]: r for r in fingerprints.compare(table, ["k"], "a", ["half", "one"]).collect()}
    for i, t in enumerate(texts):
        assert found[i]["back"] == t and found[i]["most"] <= fingerprints.LONG
        assert i == 3 or (found[i]["n"] >= len(t) / fingerprints.LONG and near[i]["near_half"] > 0.15 and near[i]["near_one"] > 0.85), i
    assert near[3]["near_half"] > 0
    short = "\n".join(t[:200] for t in texts)
    sizes = spark.createDataFrame([(t[: 201 + i],) for i, t in enumerate(texts[:3])] + [(short,)], "a string").select(F.size(fingerprints.digests(F.col("a"))).alias("n"))
    assert [r["n"] > 1 for r in sizes.collect()] == [True] * 4


def test_fingerprints_equal_the_sets_of_digests(spark, data):
    got = by_id(queries.QUERIES["op10_document_fingerprints"](spark, data))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    rows = []
    for i, (key, text) in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)][1], len(text) // 2
        rows.append((key, text, text[: len(text) - half] + after[:half], after))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, edited string, next string")
    for r in table.select("doc_id", *[fingerprints.digests(F.col(c)).alias(c) for c in ("text", "edited", "next")]).collect():
        a = set(r["text"])
        for c in ("edited", "next"):
            b = set(r[c])
            assert abs(got[r["doc_id"]][f"near_{c}"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


# ---------------------------------------------------------------- 1: nearest vectors

def test_nearest_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[0]  # a hot vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (1050, []), (1100, [0.0] * 16), (1150, [float("nan")] * 16), (1200, [None] * 16), (None, [1.0] * 16), rows[50], (1250, [1.0, 2.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    y = x.astype(np.float64)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 900, 50))
    hits = 0
    for q, near in found.items():
        cosine = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(900), -cosine)) if i != q][:5]
        hits += len(set(want) & {i for i, _ in near})
        assert len(near) == 5 and all(abs(s - unit[i] @ unit[q]) < 1e-9 for i, s in near)
    assert hits / 5 / len(found) >= 0.9
    assert [i for i, _ in found[0]] == [300, 301, 302, 303, 304]


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest.search(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest.search(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_columns_and_odd_rows(spark, docs, empty, data, tmp_path):
    import corpus_pipeline

    for table in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, data)
            assert out.columns == table.columns, name
            out.count()
        last = corpus_pipeline.STAGES[-1][1](spark, table, data)
        assert all(r["round_trip"] for r in last.collect())


def test_pipeline_runs(spark, data):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)

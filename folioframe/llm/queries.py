"""Queries of the operators in this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import (byte_bpe, fill_middle, filter_audit, fingerprints, language, licenses, mixing, near_dedup, nearest, ngram_join, quality,
                            token_files, toxicity)
from folioframe.session import cut_lineage, scratch_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_nearest_vectors")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), *model).drop("text")


@query("op3_byte_level_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "tokens")
    token_files.write(table(spark, folder, "documents"), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    digests = token_files.decoded(spark, target).select("seq", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return digests.join(token_files.starts_of(spark.read.parquet(target)), "seq").select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, folder, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held_out), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs)).drop("text")
    return scored.withColumn("kept", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op5_source_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut_lineage(mixing.sized(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("text"))
    mixed = mixing.mix(sizes, mixing.quotas(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


@query("op9_license_scans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_document_fingerprints")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = fingerprints.with_next(table(spark, folder, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    rows = docs.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited})
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = fingerprints.compare(rows, ["part", "row"], "text", ["edited", "next"])
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("print_text").alias("fingerprint"),
                        F.col("print_edited").alias("edited_fingerprint"), "near_edited", "near_next")


@query("op11_filter_audit", r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
masked AS (SELECT part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(again AS INTEGER) AS mask,
    coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic FROM counted c LEFT JOIN marks m ON c.doc_id = m.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM f a JOIN f b ON b.c <> a.c JOIN f c ON c.c NOT IN (a.c, b.c)
    JOIN f d ON d.c NOT IN (a.c, b.c, c.c) JOIN f e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
places AS (SELECT o, unnest(generate_series(1, 5)) AS step FROM orders),
steps AS (SELECT o, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(o, g.c) < step) AS earlier
    FROM places JOIN f ON f.c = substr(o, step, 1)),
report AS (SELECT part, o AS filter_order, step, bit,
    sum(CASE WHEN mask & CAST(earlier + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells CROSS JOIN steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM report""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_fill_middle", r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM docs),
placed AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turned = fill_middle.rewrite(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    digests = fill_middle.restore(turned.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)))
    return digests.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                          F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


@query("op13_minhash_near_dedup", r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
same AS MATERIALIZED (SELECT g, min(doc_id) AS id, CAST(len(g) AS BIGINT) AS n FROM sets WHERE len(g) > 0 GROUP BY g),
grams AS MATERIALIZED (SELECT id, n, unnest(g) AS x FROM same),
pairs AS (SELECT a.id AS u, b.id AS v, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM grams a JOIN grams b ON a.x = b.x AND a.id < b.id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * k >= 80 * (m + n - k)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT id, id AS other FROM same UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.other),
first AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(f.component_id, s.doc_id) AS component_id,
    s.doc_id = coalesce(f.component_id, s.doc_id) AS kept FROM sets s LEFT JOIN same e ON e.g = s.g LEFT JOIN first f ON f.id = e.id""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(table(spark, folder, "documents"))

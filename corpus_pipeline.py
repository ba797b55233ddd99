"""A training-data pipeline over ``documents``: each stage reads what the one before kept and wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Columns that
a stage does not know stay as they are, whatever their names. Null texts: the toxicity stage scores them as empty, the
quality and near-duplicate stages keep them, the mix leaves documents without words out. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import byte_bpe, mixing, ngram_join, quality, toxicity
from folioframe.session import cut_lineage, prepare, scratch_folder

#: SQL cannot train the models; the stages are tested against brute force and labels in tests/llm.
ORACLE_SQL = None

#: Words of a block of the mix: longer than in ``mixing``, so that a document taken in part keeps whole passages.
MIX_BLOCK = 64


def _packed(docs: DataFrame, *known: str) -> DataFrame:
    """The known columns, and all others in one column ``_others``, so that their names cannot clash."""
    others = [c for c in docs.columns if c not in known]
    return docs.select(*known, F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("_others"))


def _unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in df.columns else F.col(f"_others.`{c}`").alias(c)
                       for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(_packed(docs, "doc_id", "text"), toxicity.train(docs.select("doc_id", "text"), labels))
    return _unpacked(scored.where(F.col("score") < toxicity.THRESHOLD).drop("score"), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer does not reject."""
    scored = quality.score(_packed(docs, "text"), quality.train(docs.select("text")))
    return _unpacked(scored.where(F.col("score") >= quality.THRESHOLD).drop("score"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by equal or similar texts: the one with the least doc_id."""
    return _unpacked(ngram_join.first_of_groups(_packed(docs, "doc_id", "text")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: a row for each whole take, one with the picked blocks of a document."""
    sizes = cut_lineage(mixing.sized(docs.select("doc_id", "text", "source")).drop("text"))
    mixed = mixing.mix(mixing.sized(_packed(docs, "doc_id", "text", "source")), mixing.quotas(sizes, block=MIX_BLOCK), block=MIX_BLOCK)
    rows = mixing.taken_rows(mixed, ["doc_id", "text", "source", "_others"], block=MIX_BLOCK)
    return _unpacked(rows, docs.columns, **({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (``ids``, little-endian unsigned 32-bit integers), their number, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.encode_decode(_packed(docs, "doc_id", "text"), path, public_tokenizers.PATTERN)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids", "round_trip")]
    return decoded.select("doc_id", *[F.col(f"_others.`{c}`").alias(c) for c in others], "n_tokens", "ids",
                          (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm import common, decontaminate, near_copies, packing, quality, suffix_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(common.learnable()))
    score = common.fresh_name(docs, "quality")
    return quality.score(docs, model, into=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that links of five-word shingles 0.8 similar or more connect; links are verified."""
    return near_copies.one_of_each(docs, near_copies.similar_documents(docs, words=5, similarity=0.8))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that start earlier elsewhere; documents of which nothing is left go, clean ones stay as they are.

    A character that a cut divides is dropped (and replacement characters with it, in such a text). Where there is a column
    n_chars, it follows the text."""
    found = suffix_dedup.remove_repeats(docs)
    cut = F.size("spans") > 0
    left = F.col("kept").cast("string")
    whole = F.coalesce(F.call_function("try_validate_utf8", left), F.regexp_replace(F.call_function("make_valid_utf8", left), "\ufffd", ""))
    text = F.when(cut, whole).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(whole)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    columns = [changed.get(c, F.col(f"row.{common.quoted(c)}")).alias(c) for c in docs.columns]
    return found.where(~cut | (F.octet_length("kept") > 0)).select(*columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = common.new_folder(spark, f"stage-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs

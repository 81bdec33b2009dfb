"""A training corpus from raw documents: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; each is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.llm.line_dedup import line_dedup
from culprit.llm.mixing import drawn_rows, mix
from culprit.llm.ngram_join import ngram_join
from culprit.llm.piece_codec import encode_pieces
from culprit.llm.quality import fit_quality, quality_rules
from culprit.llm.shared import settled, shared_dir, stored, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# A line that more than this part of a source's documents hold is boilerplate.
LINE_RATIO = 0.05
# A source of few documents keeps the lines that fewer of them hold.
LEAST_DOCS = 3

# Near copies share 0.8 or more of their 5-word grams.  op1's own query keeps its 4 and 85.
COPY_WIDTH, COPY_ALIKE = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the trees, which are fitted on the labels.

    Each row is judged by its own text, whatever its key.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = tuple(c for c in COLUMNS if c != "doc_id")
    return quality_rules(docs, model, carry=others).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source puts into many; n_chars follows.

    A document of which nothing is left goes.
    """
    cut = line_dedup(docs, F.col("source"), F.col("text"), ratio=LINE_RATIO, least_pages=LEAST_DOCS)
    cut = cut.where((F.col("n_dropped") == 0) | (word_count(F.col("text")) > 0))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest key, null keys last.

    Rows are told apart by key and text, so each is judged by its own text, whatever its
    key.  Of rows that agree in both, which need not have words, one stays.
    """
    told_apart = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.xxhash64("text").alias("one"),
        F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("two"),
    )
    rows = docs.withColumn("_row", told_apart)
    told = ngram_join(rows.select("_row", "text"), key="_row", width=COPY_WIDTH, alike=COPY_ALIKE)
    counted = settled(told.groupBy("_row").agg(F.min("component_id").alias("group"), F.count("*").alias("n")))
    gone = counted.where(F.col("group") != F.col("_row")).select("_row")
    again = settled(counted.where((F.col("group") == F.col("_row")) & (F.col("n") > 1)).select("_row"))
    kept = rows.join(gone, "_row", "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    one = kept.join(again, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("of"))
    return kept.join(again, "_row", "left_anti").select(*COLUMNS).unionByName(one.select("of.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, those of a high score before others.

    The score is that of the quality stage's trees for the text as it is now.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    others = tuple(c for c in COLUMNS if c != "doc_id")
    # Written, as the mix reads its rows more than once and scores come from Python.
    scored = stored(quality_rules(docs, model, carry=others).select(*COLUMNS, "n_words", "score"), "scored")
    return drawn_rows(mix(scored, F.col("score"), F.col("n_words"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, byte spans and the decoded text of each row."""
    return encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", mixture),
    ("SentencePiece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; stages meet through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Boosted trees and the encoder have no form in SQL; tests hold the stages against
# brute force instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

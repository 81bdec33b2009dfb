"""The registered queries of the operators, and their twins in SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.llm.exact_dedup import exact_dedup
from culprit.llm.line_dedup import line_dedup, page_text, url_host
from culprit.llm.mixing import mix, prose_weight
from culprit.llm.oracles import ORACLES as ORACLES
from culprit.llm.ngram_join import ngram_join
from culprit.llm.near_vectors import nearest_vectors
from culprit.llm.piece_codec import encode_pieces
from culprit.llm.quality import COUNTS, fit_quality, quality_rules
from culprit.llm.ranked_search import ranked_search
from culprit.llm.secret_scan import BASE_RULES, path_findings, scan_arrivals, span_text
from culprit.llm.sharding import checked, interleave
from culprit.llm.shared import settled, shared_dir, word_count
from culprit.llm.spelling import spelling_groups
from culprit.llm.token_counts import token_counts
from culprit.llm.warc import round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _is(kind: str):
    return lambda finding: finding["kind"] == kind


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are delivered in two arrivals; the second scans what the ledger lacks."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    turn = F.pmod(F.xxhash64("source"), F.lit(2))
    path = f"{shared_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    ledger = scan_arrivals([docs.where(turn == i) for i in range(2)], path)
    found = path_findings(docs, ledger)
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("findings", lambda f: f["kind"].isin(kinds))
    count = {f"n_{k}": F.size(F.filter("findings", _is(k))).cast("long") for k in kinds}
    return found.withColumns(count).select(
        "doc_id",
        *count,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("words"),
        prose_weight(F.col("text")).alias("weight"),
    )
    mixed = mix(settled(docs), F.col("weight"), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("starts", "ends").alias("spans_hash"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("body"))
    return line_dedup(pages, F.col("host"), F.col("body")).select(
        "page_id", "host", "text", "n_lines", "n_dropped"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, crc = checked(_read(spark, sf_dir, "documents"))
    docs = settled(
        _read(spark, sf_dir, "documents").select(
            "doc_id", "source", size.alias("size"), crc.alias("text_crc32")
        )
    )
    dealt = interleave(docs, 24, tie="text_crc32")
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"))
    return quality_rules(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, _read(spark, sf_dir, "benchmark"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, F.col("id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_secret_scans,
        op3_source_mixing,
        op4_sentencepiece,
        op5_warc,
        op6_line_dedup,
        op7_exact_dedup,
        op8_token_counts,
        op9_sharding,
        op10_quality_rules,
        op11_spelling_variants,
        op12_ranked_search,
        op13_nearest_vectors,
    )
}

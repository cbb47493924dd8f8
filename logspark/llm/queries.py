"""The registered queries of the operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_quotes, decontaminate, exact_dedup, fair_mix, html_extract, license_scan, near_dedup, oracles, periodic_runs,
               substring_dedup, token_alignment, token_counts, token_files, toxicity)
from .scratch import Scratch
from .ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.reply_order(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the vocabulary file; the public byte-level BPE by default."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """``a``, ``b``: paths of the vocabulary files; the public ones by default."""
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), a or public_tokenizers.path("byte_bpe_50k.json"),
                                 b or public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and reports what they hold."""
    import public_tokenizers

    path = f"{Scratch(spark, 'token-files').root}/files"
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.report(spark, path)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"), change=periodic_runs.looped)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_fair_mix": op6_fair_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_quotes": op8_chat_quotes,
    "op9_token_counts": op9_token_counts,
    "op10_html_extract": op10_html_extract,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.LICENSES,
    "op5_exact_dedup": oracles.EXACT,
    "op6_fair_mix": oracles.MIX,
    "op7_decontaminate": oracles.LEAKS,
    "op8_chat_quotes": oracles.CHAT,
}

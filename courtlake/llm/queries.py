"""Registered queries of the training-data operators and, where SQL can state them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlake.llm import oracle
from courtlake.llm.chat import format_chat, read_back
from courtlake.llm import crf, langid, toxicity
from courtlake.llm.alignment import cross_tokenizer_alignment
from courtlake.llm.mixing import copies_of
from courtlake.llm.near_copies import near_copies
from courtlake.llm.packing import best_fit_packing
from courtlake.llm.pages import extract_text
from courtlake.llm.rules import BASE, learn_from, quality_rules
from courtlake.llm.spelling import spelling_variants
from courtlake.llm.substrings import dedup_substrings
from courtlake.llm.vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of("doc_id", 3) == 1, F.lit(False))
    model = langid.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels")
    model = crf.learn(docs, labels.where(langid.fold_of("doc_id", 5) != 0))
    scored = crf.score_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return copies_of(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("""
        SELECT CAST(x.conv_id AS BIGINT) AS conv_id, CAST(x.turn AS BIGINT) AS turn, x.role, x.text FROM VALUES
        (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') AS x(conv_id, turn, role, text)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = read_back(format_chat(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, rules).select("doc_id", *BASE, "base_failed", "kept")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of("doc_id", 5) == 0, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(langid.fold_of("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.STATEMENTS)

"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.byte_bpe import bpe_round_trip
from tallyline.llm.chat_windows import format_chat, read_back
from tallyline.llm.common import table
from tallyline.llm.fingerprints import edited_fingerprints
from tallyline.llm.html_consensus import extract_text
from tallyline.llm.jaccard_join import jaccard_components
from tallyline.llm.mixing import mix_plan
from tallyline.llm.periodic_runs import run_digests, with_repeats
from tallyline.llm.pii import replace_pii
from tallyline.llm.spelling import letter_runs, spelling_forms, with_misspellings, word_counts
from tallyline.llm.token_counts import token_counts
from tallyline.llm.topk_search import top_k
from tallyline.llm.toxicity import toxicity
from tallyline.llm.vector_dedup import vector_dedup

#: The key of the surrogates. Whoever holds it can undo them: a deployment passes its own.
PII_KEY = b"tallyline example key"

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), path)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_KEY, count_col="n_replaced")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations and one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    windows = format_chat(turns.unionByName(planted), public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(windows, in_order=True)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all texts, of which every tenth gets a repeated end first."""
    return run_digests(with_repeats(table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of all words, of which one occurrence in 199 loses a letter first."""
    runs = letter_runs(table(spark, sf_dir, "documents"))
    return spelling_forms(word_counts(with_misspellings(runs)))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def registered() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op5_html_text": op5_html_text,
        "op6_chat_windows": op6_chat_windows,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_fingerprints": op8_fingerprints,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_spelling": op12_spelling,
        "op13_topk_search": op13_topk_search,
    }

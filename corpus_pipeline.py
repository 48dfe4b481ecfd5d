"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes what a stage returns and reads it again
for the next one, in the folder that the executors share.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyline.llm.byte_bpe import bpe_round_trip
from tallyline.llm.common import table, written
from tallyline.llm.jaccard_join import keep_one
from tallyline.llm.mixing import mix_documents
from tallyline.llm.pii import replace_pii
from tallyline.llm.queries import PII_KEY
from tallyline.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    replaced = replace_pii(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return replaced
    kind = docs.schema["n_chars"].dataType
    return replaced.selectExpr(
        *(f"cast(length(text) as {kind.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in serving order; a document comes up to twice."""
    return mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of every document's ids, checked by decoding."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe_round_trip(docs, path, public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The classifier and the encoder are beyond SQL; tests/llm compares each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs

"""A training-data pipeline over `documents`: each stage reads what the one before wrote.

All stages take the columns of `documents`, leave others behind, and give an empty table for an empty one. Columns other
than the text may be null. A row without a number (doc_id) is a document like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.llm.common import stored
from lakekeep.llm.jaccard import one_of_each
from lakekeep.llm.langid import UND, foreign, identify, training_sample
from lakekeep.llm.mixing import mix, training_order
from lakekeep.llm.queries import bpe_digest, held_out
from lakekeep.llm.secret_scan import redacted, scan
from lakekeep.session import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts that parse like none of the languages, go; `lang` becomes the language found.

    A null or empty text has no letter. Repeated rows fare alike; whole texts are parsed, whatever their length.
    """
    docs = docs.select(*COLUMNS)
    samples = training_sample(docs, ~held_out())
    found = identify(docs.withColumn("_parsed", F.col("text")), samples, "_parsed")
    kept = found.where((F.col("lang_pred") != UND) & ~foreign())
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal texts the document with the smallest doc_id stays.

    Of rows that share that number and text one stays. Texts without a word are like no other and all stay.
    """
    return one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what was found in it is replaced by a mark.

    A null text stays null. Equal texts are changed alike; `n_chars` follows the text where it was changed.
    """
    found = scan(docs.select(*COLUMNS).withColumn("_scanned", F.col("text")), "_scanned")
    clean = found.withColumn("text", redacted(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes is a row, in training order.

    Null and empty texts have no words and are not taken; ties in order are broken by doc_id. The null source is one source.
    """
    return training_order(mix(docs.select(*COLUMNS))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; a null text is encoded as an empty one, repeated rows stay rows."""
    return bpe_digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing),
    ("bpe", tokens),
]
#: Language identification and BPE can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""documents through five stages: language, near-duplicates, personal data, mixture, packing.

Every stage reads what the one before it wrote, works on all of it, and returns the columns
of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import jaccard, langid, mixing, packing, pii
from loomspan.llm.common import save, table
from loomspan.llm.queries import vocabulary

#: A language that has less than this share of a text is no finding.
MIN_SCORE = 0.3
_READ = ("doc_id", "text", "lang", "source")


def _neutral(docs: DataFrame) -> DataFrame:
    """Other columns by their place, so that none has the name of a column that a stage adds."""
    return docs.toDF(*[c if c in _READ else f"c{i}" for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or without a language of at least MIN_SCORE.

    Where no document has a label to learn from, only those without a letter go.
    """
    net, held = langid.train(docs), _neutral(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(held, net).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.select(*held.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.distinct_documents(spark, _neutral(docs), width=5).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes <KIND> in place of personal data; n_chars follows."""
    out = pii.redacted(_neutral(docs), pii.train(docs)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    held = _neutral(docs)
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixing.mix(spark, held).filter("copies > 0").select(*held.columns, times.alias("time")).drop("time").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("packing", pack),
]

#: Trained models, XXH64 and tokenizers are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

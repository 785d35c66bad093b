"""From raw documents to packed training windows, one written table after another.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the
last returns the pieces of the packed windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelane.llm.near_duplicates import near_duplicate_sets
from timelane.llm.quality_rules import quality_rules
from timelane.llm.queries import contamination, packed, read
from timelane.llm.repeated_passages import remove_repeated
from timelane.llm.store import gathered, release, small_ids, stored

c = F.col
_steps: list[str] = []
"""Folders of steps of the stages run so far; the next stage deletes those that it does not read."""


def stage(build: Callable) -> Callable:
    """``build``, with the folders of earlier stages given back first."""
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_steps, docs)
        with gathered(_steps):
            return build(spark, docs, sf_dir)

    apply.__name__, apply.__doc__ = build.__name__, build.__doc__
    return apply


def _apart(docs: DataFrame, *taken: str) -> tuple[DataFrame, list]:
    """``docs`` with columns renamed that are named like a result, and columns that name them back."""
    names = {n: f"_own_{i}" if n.lower() in taken else n for i, n in enumerate(docs.columns)}
    own = docs.select(*[c(f"`{n}`").alias(m) for n, m in names.items()])
    return own, [c(f"`{m}`").alias(n) for n, m in names.items()]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``ids`` (``_id``): broadcast if few, so that no text moves."""
    return docs.join(small_ids(ids), c("doc_id") == c("_id"), "left_anti")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the limits of their language and source.

    A null or empty text has no words and goes; a null language or source is a group; equal rows
    stay or go together; a null id stays. Other columns stay as they are, whatever their
    names; an empty table gives no rows.
    """
    own, columns = _apart(docs, "measures", "base_failed", "kept")
    return quality_rules(own).where("kept").select(*columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words and rows without an id are near copies of nothing and stay; rows that share
    an id are one document. Other columns stay as they are; an empty table gives no rows.
    """
    sets = near_duplicate_sets(docs.select("doc_id", "text"), key="doc_id", shingle=5)
    return _without(docs, sets.where("not kept").select(c("doc_id").alias("_id")).distinct())


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier one holds too.

    ``n_chars``, where there is one, is counted anew for texts that change. Null and short texts and
    rows without an id stay as they are, as do other columns; rows that share an id never repeat each
    other; an empty table gives no rows.
    """
    own, columns = _apart(docs, "n_words", "n_removed")
    left = remove_repeated(own, key="doc_id")
    if "n_chars" in docs.columns:
        size = F.when(c("n_removed") > 0, F.char_length("text")).otherwise(c("n_chars"))
        left = left.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return left.select(*columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages.

    Texts without words are hit by nothing and stay, as do rows without an id; rows that share an id are
    one document. Other columns stay as they are; an empty table gives no rows.
    """
    found = contamination(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(c("doc_id").alias("_id")).distinct())


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit decreasing packing of all that is left; pieces with their places.

    A null or empty text is its end id alone; every row is packed, equal ones and such without an id
    too; an empty table gives no rows.
    """
    return packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None
"""None: token ids come from a tokenizer, which SQL cannot run; tests/llm compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, after all stages have run on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stored(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

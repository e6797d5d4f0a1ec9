"""From raw documents to packed sequences: reject junk, reject toxic texts, merge near copies, decontaminate, pack.

Each stage works on all that its predecessor kept and decides with one operator; all but the last return the columns of
documents. A stage first writes its input with a number for each row and decides by that number, so repeated and NULL ids
are no special case, columns may have any names, and later readings may split the files as they like. NULL, empty and blank
texts have no words: the classifier rejects them, and the later stages leave them alone. An empty table stays empty.
"""

from __future__ import annotations

import itertools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.llm.common import table
from hubmetrics.llm.decontamination import contamination
from hubmetrics.llm.ngram_join import ngram_components
from hubmetrics.llm.packing import packed
from hubmetrics.llm.quality import quality_scores
from hubmetrics.llm.toxicity import fit_toxicity, toxicity_scores
from hubmetrics.storage import materialize


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written copy of ``docs`` with a number for each row, and the name of that column, which no other column has."""
    taken = {c.lower() for c in docs.columns}
    row = next(name for k in itertools.count() if (name := f"stage_row_{k}") not in taken)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd"), row


def _without(numbered: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """Rows whose number is not in ``dropped``; the written list's true size decides how it is joined."""
    return numbered.join(materialize(dropped.select(row), "dropped"), row, "left_anti").drop(row)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier finds good. Texts without a word are rejected."""
    numbered, row = _numbered(docs)
    return _without(numbered, row, quality_scores(numbered, id_column=row).where("predicted = 0"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Without any labelled row nothing is known, and all documents stay."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    numbered, row = _numbered(docs)
    return _without(numbered, row, toxicity_scores(numbered, model, id_column=row).where("predicted = 1"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Texts without a word are near copies of nothing.
    """
    numbered, row = _numbered(docs)
    return _without(numbered, row, ngram_components(numbered, n=5, percent=80, row_column=row).where(~F.col("kept")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no whole shorter item, with the benchmark."""
    numbered, row = _numbered(docs)
    return _without(numbered, row, contamination(numbered, table(spark, sf_dir, "benchmark"), id_column=row).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Two stages are trained and one uses a vocabulary, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Toxicity from labelled texts, with a penalty on scores that change when an identity term is swapped.

Features are the hashed distinct words of a text. A bounded sample of the labelled rows of the training folds goes to the
driver. Words that tell the classes apart are chosen there, identity terms always among them, and a logistic regression is
fitted. For each labelled text that names a group, and for plain sentences built around every term, the term is swapped for
another of its group; the squared change of the score is part of what is minimised. So a mention of a group as such does
not carry a score, whatever the labelled texts that happen to name it say.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import alnum_words, crc_fold, emit_rows, map_rows
from hubmetrics.llm.linear import fit, sigmoid, sparse

#: Labelled rows, at most about so many, that the model is fitted on; also the bound of what is broadcast to find them.
SAMPLE_ROWS = 16_000
COLUMNS = 1 << 20
MAX_WORDS = 4096
#: Groups of terms that may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("young", "old", "disabled", "deaf", "blind"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def slot(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) % COLUMNS


def text_slots(text: str | None) -> np.ndarray:
    return np.array(sorted({slot(w) for w in set(alnum_words(text)) if w}), np.int32)


def _terms() -> dict[int, list[int]]:
    """The other terms of its group for each identity term's column."""
    out: dict[int, list[int]] = {}
    for group in IDENTITY_TERMS:
        slots = [slot(t.encode()) for t in group]
        for s in slots:
            out[s] = [x for x in slots if x != s]
    return out


class Model:
    """Weights of the chosen words' columns and an intercept."""

    def __init__(self, rows: list[np.ndarray], target: np.ndarray, swap_weight: float):
        #: False if there was no labelled row to learn from.
        self.learned = len(rows) > 0
        terms = _terms()
        n1, n0 = max(target.sum(), 1.0), max((1 - target).sum(), 1.0)
        seen = np.concatenate(rows or [np.empty(0, np.int32)])
        labels = np.repeat(target, [len(r) for r in rows]) if rows else np.empty(0)
        with_toxic = np.bincount(seen, weights=labels, minlength=COLUMNS)
        with_clean = np.bincount(seen, weights=1 - labels, minlength=COLUMNS)
        p = (with_toxic + with_clean) / (n1 + n0)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        z = (with_toxic / n1 - with_clean / n0) / spread
        z[with_toxic + with_clean < 4] = 0
        chosen = np.argsort(-np.abs(z), kind="stable")[:MAX_WORDS]
        chosen = np.unique(np.concatenate([chosen[np.abs(z[chosen]) > 4], list(terms)])).astype(np.int64)
        place = np.full(COLUMNS, -1, np.int64)
        place[chosen] = np.arange(len(chosen))

        def columns(r: np.ndarray) -> np.ndarray:
            found = place[r]
            return found[found >= 0]

        kept = [columns(r) for r in rows]
        differences = []
        for r in rows:
            for s in r:
                for other in terms.get(int(s), ()):
                    differences.append((int(s), other))
        # A sentence around a term differs from the one around another term in these two words only.
        differences += [(s, other) for s, others in terms.items() for other in others]
        swaps = sparse([(place[np.array(d)], np.array([1.0, -1.0])) for d in differences])
        # Both classes weigh the same, so that a score of 0.5 parts them however rare toxic texts are.
        weights, self.intercept = fit(
            sparse([(k, np.ones(len(k))) for k in kept]), target, len(chosen), l2=1e-4, swaps=swaps,
            swap_weight=swap_weight, weight=np.where(target > 0, 1 / n1, 1 / n0))
        self.weights = dict(zip(chosen.tolist(), weights.tolist()))

    def score(self, text: str | None) -> float:
        total, weights = self.intercept, self.weights
        for s in {slot(w) for w in set(alnum_words(text)) if w}:
            w = weights.get(s)
            if w is not None:
                total += w
        return float(sigmoid(np.float64(total)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_column: str = "doc_id",
                 text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS,
                 swap_weight: float = 1.0) -> Model:
    """Fit on labelled rows outside the held-out fold. NULL labels and labels other than 0 and 1 are left out.

    The sample of labels is chosen by a hash of the id and is small enough to be broadcast whatever the table's size, so
    texts are not shuffled. A doc_id with several labels counts with the largest. Without any labelled row the score of
    every text is 0.5.
    """
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()) \
        .where(crc_fold(F.col(id_column), folds) != held_out)
    total = usable.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = usable.where(F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))) \
        .groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).alias("_label"))
    joined = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(picked), "_id")

    def make():
        def run(label=None, texts=None):
            if texts is not None:
                yield {"label": label, "hash": [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest((t or "").encode())))) for t in texts],
                       "slots": [text_slots(t).tobytes() for t in texts]}

        return run

    rows = emit_rows(joined.withColumn("_label", F.col("_label").cast("int")), ["_label", "_text"], [
        T.StructField("label", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("slots", T.BinaryType()),
    ], make)
    # Copies of one text count once.
    got = rows.groupBy("hash").agg(F.max("label").alias("label"), F.first("slots").alias("slots")) \
        .orderBy("hash").toArrow().to_pylist()
    return Model([np.frombuffer(r["slots"], np.int32) for r in got], np.array([r["label"] for r in got], float), swap_weight)


def toxicity_scores(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``id, held_out, score, predicted, _row`` of each row of ``docs``; ``predicted`` is 1 for scores of 0.5 and more.

    NULL, empty and word-free texts get the score of a text without any telling word. Repeated rows score alike, NULL ids
    are kept. An empty table gives no rows; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            scores = [m.score(t) for t in texts]
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return run

    source = docs.select(
        F.col(id_column), (crc_fold(F.col(id_column), folds) == held_out).alias("held_out"),
        F.monotonically_increasing_id().alias("_row"), F.col(text_column).alias("_text"))
    return map_rows(source, [id_column, "held_out", "_row"], ["_text"], [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)

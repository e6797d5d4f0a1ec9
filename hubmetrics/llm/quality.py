"""Document quality from weak labels.

Simple heuristics vote good, bad or nothing on every text. Votes are counted by pattern over all rows, at most
``3 ** len(LABELLERS)`` numbers, and expectation-maximisation finds how accurate each heuristic is and how likely each
pattern is to be good. No given label is read. The posteriors of a bounded sample train a linear scorer on hashed features
(shapes of words and measured ratios), which then scores every row.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import map_rows
from hubmetrics.llm.linear import fit, sigmoid, sparse
from hubmetrics.storage import materialize

#: Rows, at most about so many, on whose posteriors the scorer is fitted. Votes are counted over all rows.
SAMPLE_ROWS = 20_000
COLUMNS = 1 << 12
#: A heuristic is assumed to vote bad at least so many times as often on bad texts as on good ones.
BAD_ODDS = 100
GOOD, BAD, NONE = 2, 1, 0
#: Words whose shapes a task remembers; beyond it the memory starts anew.
_MAX_SHAPES = 1 << 18

#: Measures and their bounds: bad above the first, good below the second, no vote between them.
LABELLERS = (
    ("marked", 0.20, 0.02),  # words that end in runs of symbols
    ("shouted", 0.60, 0.30),  # upper-case letters
    ("exclaimed", 0.30, 0.03),  # words that end in several exclamation marks
    ("ruled", 0.15, 0.02),  # words that are a bar
    ("stuttered", 0.25, 0.05),  # words equal to the word before
)
_SYMBOLS = set("#$%&*+=@^~<>|\\/_{}[]")


def word_shape(word: str) -> tuple[str, bool, bool, int, int, int]:
    """Shape (letter case, digits and marks with runs shortened), whether marked, exclaimed; letters, capitals, length."""
    out, last = [], ""
    letters = upper = 0
    for c in word:
        if c.isalpha():
            letters += 1
            k = "A" if c.isupper() else "a"
            upper += k == "A"
        else:
            k = "0" if c.isdigit() else c
        if k != last:
            out.append(k)
        elif out and len(out[-1]) == 1:
            out[-1] = k + "+"
        last = k
    marked = len(word) > 3 and word[-1] in _SYMBOLS and word[-1] == word[-2]
    exclaimed = len(word) > 2 and word.endswith("!!")
    return "".join(out[:12]), marked, exclaimed, letters, upper, len(word)


class Measure:
    """Votes and hashed features of texts."""

    def __init__(self):
        self.shapes: dict[str, tuple] = {}
        self.alike: dict[tuple, tuple] = {}  # words of one shape share an entry
        self.slots: dict[str, int] = {}

    def _slot(self, name: str) -> int:
        slot = self.slots.get(name)
        if slot is None:
            if len(self.slots) > _MAX_SHAPES:
                self.slots.clear()
            slot = self.slots[name] = xxhash.xxh32_intdigest(name) % COLUMNS
        return slot

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Pattern of votes; columns and values of the features."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return -1, np.array([self._slot("empty")], np.int32), np.ones(1, np.float32)
        if len(self.shapes) > _MAX_SHAPES:
            self.shapes, self.alike = {}, {}
        known = self.shapes
        try:
            found = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    shape = word_shape(w)
                    known[w] = self.alike.setdefault(shape, shape)
            found = [known[w] for w in words]
        counts: dict[tuple, int] = {}
        for s in found:
            counts[s] = counts.get(s, 0) + 1
        marked = exclaimed = letters = upper = size = 0
        features: dict[int, float] = {}
        for (shape, m, e, l, u, z), c in counts.items():
            marked += m * c
            exclaimed += e * c
            letters += l * c
            upper += u * c
            size += z * c
            slot = self._slot("shape " + shape)
            features[slot] = features.get(slot, 0.0) + c / n
        repeats = sum(map(str.__eq__, words, words[1:]))
        ratios = {
            "marked": marked / n, "shouted": upper / max(letters, 1), "exclaimed": exclaimed / n,
            "ruled": words.count("|") / n, "stuttered": repeats / n,
        }
        unlettered = self._slot(f"ratio unlettered {int((1 - letters / max(size, 1)) * 20)}")
        features[unlettered] = features.get(unlettered, 0.0) + 1.0
        pattern = 0
        for name, bad, good in LABELLERS:
            r = ratios[name]
            pattern = 3 * pattern + (BAD if r > bad else GOOD if r < good else NONE)
            slot = self._slot(f"ratio {name} {min(int(r * 20), 20)}")
            features[slot] = features.get(slot, 0.0) + 1.0
        return pattern, np.array(list(features), np.int32), np.array(list(features.values()), np.float32)


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def estimate(patterns: dict[int, int], rounds: int = 10) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of being good for each pattern, and each labeller's vote table by class.

    Starts from "one bad vote is bad", since a heuristic sees one kind of fault. Few rounds, because with heuristics that only
    find faults nothing in the votes tells how many bad texts none of them sees, and that share would go on drifting.
    """
    keys = [p for p in patterns if p >= 0]
    if not keys:
        return {-1: 0.0}, np.zeros((len(LABELLERS), 2, 3))
    votes = np.array([votes_of(p) for p in keys])
    n = np.array([patterns[p] for p in keys], float)
    good = np.where((votes == BAD).any(axis=1), 0.01, 0.99)
    table = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        prior = np.clip((n * good).sum() / n.sum(), 1e-4, 1 - 1e-4)
        score = np.log(np.array([1 - prior, prior]))[None, :].repeat(len(keys), axis=0)
        for j in range(len(LABELLERS)):
            for c, share in enumerate((1 - good, good)):
                for v in (NONE, BAD, GOOD):
                    table[j, c, v] = (n * share * (votes[:, j] == v)).sum() + 1.0
            table[j] /= table[j].sum(axis=1, keepdims=True)
            # Without this, the two classes may settle on two kinds of faults instead of on good and bad.
            over = table[j, 1, BAD] - table[j, 0, BAD] / BAD_ODDS
            if over > 0:
                table[j, 1, BAD] -= over
                table[j, 1, NONE] += over
            score += np.log(table[j][:, votes[:, j]]).T
        good = sigmoid(score[:, 1] - score[:, 0])
    return {**dict(zip(keys, good.tolist())), -1: 0.0}, table


def quality_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id, score, predicted, weak_label, _row``: how likely each row of ``docs`` is good, from 0 to 1.

    ``predicted`` is 1 for scores of 0.5 and more. Texts without a word (NULL, empty, blank) score 0. Repeated rows score
    alike, NULL ids are kept. An empty table gives no rows; other columns do not matter. ``_row`` numbers the rows of a
    table that is read the same way again.
    """
    source = docs.select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        F.xxhash64(text_column).alias("_h"), F.col(text_column).alias("_text"))

    def make():
        measure = Measure()

        def run(texts):
            found = [measure(t) for t in texts]
            return {"pattern": [f[0] for f in found], "slots": [f[1].tobytes() for f in found],
                    "values": [f[2].tobytes() for f in found]}

        return run

    table = materialize(map_rows(source, ["_id", "_row", "_h"], ["_text"], [
        T.StructField("pattern", T.IntegerType()), T.StructField("slots", T.BinaryType()),
        T.StructField("values", T.BinaryType()),
    ], make), "quality")
    patterns = {r["pattern"]: r["count"] for r in table.groupBy("pattern").count().collect()}
    posterior, _ = estimate(patterns)
    total = sum(patterns.values())
    share = min(1.0, sample_rows / max(total, 1))
    # Chosen by the text's hash, so equal texts are in or out together and count once.
    sample = (
        table.where((F.col("pattern") >= 0) & (F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30))))
        .groupBy("_h").agg(F.first("pattern").alias("pattern"), F.first("slots").alias("slots"), F.first("values").alias("values"))
        .select("pattern", "slots", "values").toArrow().to_pylist()
    )
    rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in sample]
    target = np.array([posterior[r["pattern"]] for r in sample])
    weights, intercept = fit(sparse(rows), target, COLUMNS)
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept, posterior))

    def score():
        w, b, known = model.value

        def run(pattern, slots, values):
            out = []
            for p, s, v in zip(pattern, slots, values):
                out.append(0.0 if p < 0 else float(sigmoid(np.dot(w[np.frombuffer(s, np.int32)], np.frombuffer(v, np.float32)) + b)))
            return {"score": out, "predicted": [int(x >= 0.5) for x in out], "weak_label": [known.get(p, 0.0) for p in pattern]}

        return run

    scored = map_rows(table, ["_id", "_row"], ["pattern", "slots", "values"], [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("weak_label", T.DoubleType()),
    ], score)
    return scored.withColumnRenamed("_id", id_column)

"""Language-model scores from a bigram trie in Elias-Fano levels.

The first level is the sorted hashes of all training words with their exact counts; a word's place in it is its id. The
second holds, for each context word, its successors: sorted ids are made one rising sequence by adding to each context's ids the last value of the context
before, so pointers and successors are both monotone and stored with a few bits more than the entropy; a successor is
searched relative to its context. A level between them holds the back-off weight of each context. Smoothed log
probabilities and back-off weights are stored in 16 bits. Levels are cut into shards by key range; tasks write them to the
shared folder and map them into memory, so they are never on the driver, and workers of a machine share the pages. Training
tasks too take ids, counts and weights from the mapped levels, so nothing is joined or broadcast by word.

Pairs of all words are counted and stored, unless the caller asks for a smaller model with ``min_count``: rarer pairs then
fit the prior only, and their share stays in the context's remaining weight. A pair's probability is its count over
``context count + prior`` plus the context's remaining weight times the word's own probability, the add-half estimate.
``prior`` is the one, of a grid, that predicts each training pair best from all others.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubmetrics.llm.common import bound_batches, crc_fold, emit_rows, map_rows, words_of
from hubmetrics.llm.warc import open_store
from hubmetrics.storage import materialize, scratch_path

PRIORS = (10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e8)
SHARD_ROWS = 1_000_000
#: Tokens that a task counts before it passes sums on, of words and of pairs.
FLUSH = 1_000_000
PAIR_FLUSH = 1_000_000
#: Tokens looked up at a time when scoring.
GROUP = 600_000
#: Bounds of stored log10 values.
LOWEST = -16.0
_SIGN = np.uint64(1 << 63)
END = xxhash.xxh3_64_intdigest(b"")  # no word is empty


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of the end."""
    words = words_of(text)
    words.append(b"")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def signed(h: np.ndarray) -> np.ndarray:
    """Order-preserving map of unsigned to signed 64-bit numbers, for Spark's longs."""
    return (h ^ _SIGN).view(np.int64)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / LOWEST * 65535), 0, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q.astype(float) * (LOWEST / 65535)


class EliasFano:
    """A rising sequence of unsigned numbers: low bits packed, high bits as a bit string with one 1 per number."""

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max((top // max(n, 1)).bit_length() - 1, 0)
        width = np.uint64(low)
        high = (values >> width).astype(np.int64)
        ones = high + np.arange(n)
        del high
        words = np.zeros(-(-((ones[-1] if n else 0) + 2) // 64), np.uint64)
        np.bitwise_or.at(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        del ones
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        packed = np.zeros(-(-n * low // 8) + 16, np.uint8)
        for start in range(0, n, 1 << 16):
            part = values[start: start + (1 << 16)]
            if low:
                rows = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
                data = np.packbits(rows, bitorder="little")  # starts are multiples of 8 numbers, hence of whole bytes
                at = start * low // 8
                packed[at: at + len(data)] = data
        return {"low": packed, "high": words, "zeros": zeros.astype(np.uint64), "size": np.array([n, low], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray], prefix: str):
        self.packed, self.words, self.zeros = parts[prefix + "low"], parts[prefix + "high"], parts[prefix + "zeros"].view(np.int64)
        # Eight bytes from any byte on; the low bits end with bytes to spare.
        self.eight = np.ndarray(len(self.packed) - 7, "<u8", np.ascontiguousarray(self.packed), strides=(1,))
        self.n, self.width = (int(v) for v in parts[prefix + "size"])
        self.ones = None

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        out = self.eight[byte]
        out >>= shift
        if self.width > 56:
            more = self.packed[byte + 8].astype(np.uint64)
            out |= np.where(shift > 0, more << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.width) - 1)

    @staticmethod
    def _within(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the 1 with this rank in each word."""
        words, rank = words.copy(), rank.astype(np.uint8)  # below 64
        place = np.zeros(len(words), np.uint8)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(words & np.uint64((1 << half) - 1))
            on = (rank >= count).view(np.uint8)
            rank -= count * on
            on *= np.uint8(half)
            place += on
            words >>= on
        return place.astype(np.int64)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have smaller high bits: ones before the zero that ends the part ``high - 1``."""
        k = high - 1
        known = np.maximum(k, 0)
        word = np.searchsorted(self.zeros, known, "right") - 1
        inside = word < len(self.words)
        word = np.minimum(word, len(self.words) - 1)
        place = word * 64 + self._within(~self.words[word], known - self.zeros[word])
        return np.where(k < 0, 0, np.where(inside, np.minimum(place - known, self.n), self.n))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._within(self.words[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number that is ``x`` or more; the number of numbers if there is none."""
        high = np.minimum(x >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        at, end = self._before(high), self._before(high + 1)
        low = x & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):  # halved each time: a frequent context has many successors with the same high bits
            middle = (at[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < end[open_]]
        return at


def write_parts(folder: str, parts: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file, a line of JSON first, each array at a multiple of 64 bytes."""
    head, at, places = {}, 0, {}
    for name, a in parts.items():
        places[name] = at
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.level"
    with store.open_output_stream(f"{path}/{name}", compression=None) as file:
        file.write(line)
        for a in parts.values():
            file.write(a.tobytes())
            file.write(b"\0" * (-a.nbytes % 64))
    return f"{folder}/{name}"


def read_parts(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a file, mapped into memory where the store is a mounted folder."""
    from pyarrow import fs

    store, path = open_store(uri)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)  # the subclass makes each access dear
    else:
        with store.open_input_file(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
    end = int(np.flatnonzero(data[: 1 << 16] == 10)[0]) + 1
    head = json.loads(bytes(data[:end]))
    return {n: data[end + at: end + at + np.dtype(t).itemsize * size].view(t) for n, (t, size, at) in head.items()}


def _shards(rows: DataFrame, keys: list[str], values: list[str], count: int, folder: str, build) -> list[tuple]:
    """Sort rows by key over ``count`` ranges; each range becomes a file. Returns first keys, rows and file of each.

    One short row for every ``SHARD_ROWS`` rows reaches the driver.
    """
    bound_batches(rows.sparkSession)
    names = [*keys, *values]
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in keys], T.StructField("_n", T.LongType()), T.StructField("_file", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(names))]
            del held
            uri = write_parts(folder, build(*columns))
            first = [pa.array([int(c[0])], pa.int64()) for c in columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*first, pa.array([len(columns[0])]), pa.array([uri])], schema=arrow)

    dealt = rows.select(*names).repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    # The written list fixes which attempt's files count.
    return sorted(tuple(r) for r in materialize(dealt.mapInArrow(run, schema), "shards").collect())


class Words:
    """First level: ids and exact counts by word hash, counts by id. The id of a word is its place among the sorted hashes."""

    def __init__(self, shards: list[tuple]):
        self.first = np.array([s[0] for s in shards], np.int64)
        self.base = np.cumsum([0, *[s[-2] for s in shards]])
        self.files = [s[-1] for s in shards]
        self.open: dict[int, tuple] = {}

    def _shard(self, s: int) -> tuple:
        if s not in self.open:
            parts = read_parts(self.files[s])
            self.open[s] = (EliasFano(parts, "key_"), parts["count"], np.uint64(parts["base"][0]))
        return self.open[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts, -1 and 0 for words that were not in training."""
        keys = signed(hashes)
        ids, out = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, "right") - 1
        for s in np.unique(shard[shard >= 0]):
            level, count, base = self._shard(s)
            mine = np.flatnonzero(shard == s)
            x = hashes[mine] - base
            at = level.successor(x)
            there = np.flatnonzero(at < level.n)
            hit = there[level.get(at[there]) == x[there]]
            ids[mine[hit]] = self.base[s] + at[hit]
            out[mine[hit]] = count[at[hit]]
        return ids, out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            out[mine] = self._shard(s)[1][ids[mine] - self.base[s]]
        return out


_WORDS: dict[str, Words] = {}


def open_words(shards: list[tuple]) -> Words:
    """The first level, opened once in each worker."""
    key = "|".join(s[-1] for s in shards)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(shards)
    return _WORDS[key]


def _word_parts(h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    raw = h.view(np.uint64) ^ _SIGN
    parts = {f"key_{k}": v for k, v in EliasFano.build(raw - raw[0]).items()}
    return {**parts, "count": n.astype(np.int64), "base": raw[:1]}


class Contexts:
    """Back-off weights, as log10, by context id; 0 for words without stored pairs."""

    def __init__(self, shards: list[tuple]):
        self.first = np.array([s[0] for s in shards], np.int64)
        self.files = [s[-1] for s in shards]
        self.open: dict[int, tuple] = {}

    def weights(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        shard = np.searchsorted(self.first, ids, "right") - 1
        for s in np.unique(shard[shard >= 0]):
            if s not in self.open:
                parts = read_parts(self.files[s])
                self.open[s] = (EliasFano(parts, "key_"), parts["weight"])
            level, weight = self.open[s]
            mine = np.flatnonzero(shard == s)
            x = ids[mine].astype(np.uint64)
            at = level.successor(x)
            there = np.flatnonzero(at < level.n)
            hit = there[level.get(at[there]) == x[there]]
            out[mine[hit]] = restored(weight[at[hit]])
        return out


def _context_parts(a: np.ndarray, taken: np.ndarray) -> dict[str, np.ndarray]:
    parts = {f"key_{k}": v for k, v in EliasFano.build(a).items()}
    return {**parts, "weight": quantised(np.log10(np.maximum(1 - taken, 1e-12)))}


class Pairs:
    """Second level: log10 probability of a successor in a context, NaN if the pair is not stored."""

    def __init__(self, shards: list[tuple]):
        self.first_a = np.array([s[0] for s in shards], np.int64)
        self.first_b = np.array([*[s[1] for s in shards], 0], np.int64)
        self.files = [s[-1] for s in shards]
        self.open: dict[int, tuple] = {}

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The last shard that starts at the pair or before it, -1 if there is none."""
        out, end = np.searchsorted(self.first_a, a) - 1, np.searchsorted(self.first_a, a, "right")
        on = np.flatnonzero(out + 1 < end)
        while len(on):
            on = on[self.first_b[out[on] + 1] <= b[on]]
            out[on] += 1
            on = on[out[on] + 1 < end[on]]
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), np.nan)
        shard = self.shard(a, b)
        for s in np.unique(shard[shard >= 0]):
            if s not in self.open:
                parts = read_parts(self.files[s])
                self.open[s] = (EliasFano(parts, "context_"), EliasFano(parts, "pointer_"), EliasFano(parts, "next_"), parts["value"])
            contexts, pointers, successors, value = self.open[s]
            mine = np.flatnonzero(shard == s)
            x, back = np.unique(a[mine].astype(np.uint64), return_inverse=True)
            c = contexts.successor(x)
            start, end, base = np.zeros((3, len(x)), np.int64)
            there = np.flatnonzero(c < contexts.n)
            there = there[contexts.get(c[there]) == x[there]]
            start[there], end[there] = pointers.get(c[there]).astype(np.int64), pointers.get(c[there] + 1).astype(np.int64)
            later = there[start[there] > 0]
            base[later] = successors.get(start[later] - 1).astype(np.int64)
            stored = np.flatnonzero((end > start)[back])
            mine, back = mine[stored], back[stored]
            if not len(mine):
                continue
            target = (base[back] + b[mine] + 1).astype(np.uint64)
            at = successors.successor(target)
            there = np.flatnonzero((at >= start[back]) & (at < end[back]))
            hit = there[successors.get(at[there]) == target[there]]
            out[mine[hit]] = restored(value[at[hit]])
        return out


def _pair_parts(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    contexts, starts = np.unique(a, return_index=True)
    pointers = np.concatenate([starts, [len(a)]])
    last = b[pointers[1:] - 1] + 1  # ids count from one, so every context moves the sequence on
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    rising = b + 1 + np.repeat(base, np.diff(pointers))
    out = {"value": quantised(value)}
    for name, values in (("context_", contexts), ("pointer_", pointers), ("next_", rising)):
        out |= {name + k: v for k, v in EliasFano.build(values).items()}
    return out


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    def make():
        held: list[np.ndarray] = []
        size = [0]

        def flush():
            h, n = _summed(np.concatenate(held))
            held.clear()
            size[0] = 0
            return {"h": signed(h), "n": n.astype(np.int64)}

        def run(texts=None):
            if texts is None:
                if held:
                    yield flush()
                return
            for t in texts:
                held.append(token_hashes(t))
                size[0] += len(held[-1])
            if size[0] > FLUSH:
                yield flush()

        return run

    rows = emit_rows(docs, [text], [T.StructField("h", T.LongType()), T.StructField("n", T.LongType())], make)
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, text: str, word_shards: list[tuple]) -> DataFrame:
    """Pairs of the ids of all words that follow each other, and how often; an end is no context."""
    def make():
        words = open_words(word_shards)
        held: list[np.ndarray] = []
        total = [0]

        def flush():
            h = np.concatenate(held)
            held.clear()
            total[0] = 0
            different, place = np.unique(h, return_inverse=True)
            ids, size = words.find(different)[0], len(different)
            first = np.flatnonzero(h[:-1] != np.uint64(END))
            k, n = _summed(place[first] * size + place[first + 1])
            return {"a": ids[k // size], "b": ids[k % size], "n": n.astype(np.int64)}

        def run(texts=None):
            if texts is None:
                if held:
                    yield flush()
                return
            for t in texts:
                held.append(token_hashes(t))
                total[0] += len(held[-1])
                if total[0] > PAIR_FLUSH:
                    yield flush()

        return run

    long = T.LongType()
    rows = emit_rows(docs, [text], [T.StructField("a", long), T.StructField("b", long), T.StructField("n", long)], make)
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _stored(pairs: DataFrame, word_shards: list[tuple], divisor: float, min_count: int) -> DataFrame:
    """Pairs to store, and a row per task with how many those are and how well each prior predicts all its pairs."""
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in ("a", "b", "n")], T.StructField("fit", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        words = open_words(word_shards)
        fit, stored = np.zeros(len(PRIORS)), 0
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            context, p = words.counts(a), (words.counts(b) + 0.5) / divisor
            fit += [(n * np.log((n - 1 + m * p) / (context - 1 + m))).sum() for m in PRIORS]
            kept = np.flatnonzero(n >= min_count)
            stored += len(kept)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[kept]) for c in (a, b, n)], pa.nulls(len(kept), arrow.field(3).type)], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in (None, None, stored)] + [pa.array([fit.tolist()], arrow.field(3).type)], schema=arrow)

    return pairs.mapInArrow(run, schema)


class Model:
    """What tasks need: totals and file names."""

    def __init__(self, tokens, words, word_shards, context_shards, pair_shards):
        self.tokens, self.distinct = tokens, words
        self.word_shards, self.context_shards, self.pair_shards = word_shards, context_shards, pair_shards


def train(docs: DataFrame, text_column: str = "text", folder: str | None = None, min_count: int = 1) -> Model:
    """Count all rows of ``docs`` and write the levels. NULL texts are an end alone; no rows give an empty model.

    Pairs that occur less than ``min_count`` times are counted but not stored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "lm")
    counts = materialize(_word_counts(docs, text_column), "words")
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(row["n"] or 0), int(row["v"])
    divisor = total + 0.5 * (distinct + 1)
    word_shards = _shards(counts, ["h"], ["n"], -(-max(distinct, 1) // SHARD_ROWS), folder, _word_parts)
    pairs = materialize(_stored(_pair_counts(docs, text_column, word_shards), word_shards, divisor, min_count), "pairs")
    row = pairs.where(F.col("fit").isNotNull()).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("fit")[k]).alias(f"m{k}") for k in range(len(PRIORS))]).first()
    prior = PRIORS[int(np.argmax([row[f"m{k}"] or 0.0 for k in range(len(PRIORS))]))]
    kept = pairs.where(F.col("fit").isNull()).drop("fit")

    def context_parts(a, n):
        return _context_parts(a, n / (open_words(word_shards).counts(a) + prior))

    contexts = materialize(kept.groupBy("a").agg(F.sum("n").alias("n")), "contexts")
    context_shards = _shards(contexts, ["a"], ["n"], -(-max(contexts.count(), 1) // SHARD_ROWS), folder, context_parts)

    def pair_parts(a, b, n):
        words = open_words(word_shards)
        left = 10 ** Contexts(context_shards).weights(a)
        return _pair_parts(a, b, np.log10(n / (words.counts(a) + prior) + left * (words.counts(b) + 0.5) / divisor))

    pair_shards = _shards(kept, ["a", "b"], ["n"], -(-max(int(row["n"] or 0), 1) // SHARD_ROWS), folder, pair_parts)
    return Model(total, distinct, word_shards, context_shards, pair_shards)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words, self.contexts, self.pairs = open_words(model.word_shards), Contexts(model.context_shards), Pairs(model.pair_shards)
        self.divisor = model.tokens + 0.5 * (model.distinct + 1)

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        group: list[np.ndarray] = []
        size = 0
        for t in texts:
            group.append(token_hashes(t))
            size += len(group[-1])
            if size >= GROUP:
                self._score(group, out)
                group, size = [], 0
        if group:
            self._score(group, out)
        return out

    def _score(self, group: list[np.ndarray], out: dict[str, list]) -> None:
        sizes = np.array([len(g) for g in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        different, place = np.unique(np.concatenate(group), return_inverse=True)
        ids, count = self.words.find(different)
        known = np.flatnonzero(ids >= 0)
        weight = np.zeros(len(ids))
        weight[known] = self.contexts.weights(ids[known])
        own = np.log10((count + 0.5) / self.divisor)[place]
        score = own.copy()
        inner = np.ones(len(place), bool)
        inner[starts] = False
        met = np.flatnonzero(inner)
        before = place[met - 1]
        score[met] += weight[before]
        on = np.flatnonzero((ids[before] >= 0) & (ids[place[met]] >= 0))
        both, before = met[on], before[on]
        if len(both) and self.pairs.files:
            keys, back = np.unique(before * len(ids) + place[both], return_inverse=True)
            found = self.pairs.lookup(ids[keys // len(ids)], ids[keys % len(ids)])[back]
            hit = ~np.isnan(found)
            score[both[hit]] = found[hit]
        out["n_tokens"] += sizes.tolist()
        out["n_known"] += np.add.reduceat((count > 0)[place].astype(np.int64), starts).tolist()
        out["base_score"] += np.add.reduceat(own, starts).tolist()
        out["score"] += np.add.reduceat(score, starts).tolist()


_SCORERS: dict[str, Scorer] = {}


def lm_scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, keep, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``, without a shuffle.

    NULL and empty texts are an end alone. Repeated rows and NULL ids are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        key = "|".join(s[-1] for s in m.word_shards)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(m)
        scorer = _SCORERS[key]

        def run(texts):
            return {**scorer(texts), "train_tokens": [m.tokens] * len(texts)}

        return run

    source = docs.select(F.col(id_column), *keep, F.col(text_column).alias("_text"))
    long, double = T.LongType(), T.DoubleType()
    return map_rows(source, [id_column, *keep], ["_text"], [
        T.StructField("n_tokens", long), T.StructField("n_known", long), T.StructField("train_tokens", long),
        T.StructField("base_score", double), T.StructField("score", double)], make)


def lm_held_out(docs: DataFrame, folds: int = 5, held_out: int = 1, id_column: str = "doc_id", text_column: str = "text",
                min_count: int = 1) -> DataFrame:
    """Scores of all rows by a model of the rows outside one fold; adds ``held_out``."""
    marked = docs.select(F.col(id_column), F.col(text_column).alias("_text"), (crc_fold(F.col(id_column), folds) == held_out).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), "_text", min_count=min_count)
    return lm_scores(marked, model, id_column, "_text", ("held_out",))

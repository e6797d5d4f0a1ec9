"""Packing of token sequences into windows of fixed length.

Texts longer than a window give whole windows and a rest. The histogram of the rests, at most one number per length, goes
to the driver: there the combinations of two or three lengths that fill a window exactly are listed, non-negative least
squares finds how often to use each, and the counts are rounded to what the histogram allows. What is left is packed greedily,
longest first, each time with the most frequent lengths that fill the window; the little that fits nowhere is laid in a
line and cut at the ends of windows. So every window is full but the last one.

The plan is a table of (length, rank) ranges whose size depends on the window alone. Pieces get their rank within their
length from a distributed numbering, and from it their window and place by arithmetic: no piece passes the driver.
"""

from __future__ import annotations

import gc
import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import emit_rows
from hubmetrics.llm.piece_bpe import NO_PAIR, Pieces, _Pairs
from hubmetrics.llm.token_counts import byte_alphabet
from hubmetrics.plans.ordered import with_position
from hubmetrics.storage import materialize

#: Combinations of three lengths are listed for first lengths on this grid.
GRID = 16
ROUNDS = 200
#: Words whose ids a task remembers; beyond it the memory starts anew, and at the task's end it is given back.
MAX_WORDS = 1 << 19
#: Characters of text whose new words are learned together.
GROUP_CHARS = 1 << 21
#: Trailing ASCII characters that the word splitters of the vocabulary part from letters and digits.
_TAIL = ",.;:!?*%$&#|()[]"


class _WordTables:
    """The vocabulary's merges as arrays, for words of letters: bytes that merge by rank, the last one marked as the word's end."""

    def __init__(self, model: dict):
        vocabulary, mark = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("two merges of this vocabulary make the same token")
        self.symbols = max(vocabulary.values()) + 1
        parts = np.array([(vocabulary[a], vocabulary[b]) for a, b in merges], np.int64)
        keys = parts[:, 0] * self.symbols + parts[:, 1]
        order = np.argsort(keys)
        self.pairs = np.stack([keys, np.array(made, np.int64)], axis=1)[order]
        self.rank = np.full(self.symbols, NO_PAIR, np.int32)
        self.rank[made] = np.arange(len(made))
        # Tokens that a merge of a smaller rank takes up.
        self.early = np.zeros(self.symbols, bool)
        smaller = np.arange(len(made))[:, None] <= self.rank[parts]
        self.early[parts[smaller & (self.rank[parts] < NO_PAIR)]] = True
        shown = {byte: c for c, byte in byte_alphabet().items()}
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[shown[b] + mark] for b in range(256)], np.int32)


class _WordMerges(Pieces):
    """The merge rounds of the piece encoder over words of letters."""

    def __init__(self, tables: _WordTables):
        self.tables, self.merged = tables, _Pairs(tables.pairs)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids end."""
        raw = [w.encode() for w in words]
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(r) for r in raw])
        symbol = self.tables.inner[code]
        ends = np.cumsum([len(r) for r in raw]) - 1
        symbol[ends] = self.tables.last[code[ends]]
        symbol, word, _ = self._rounds(symbol, word, code)
        return symbol, np.cumsum(np.bincount(word, minlength=len(words)))


class WordIds:
    """Token ids of texts, word by word: the vocabulary's merges never cross white space.

    New words of a group of texts are learned together: those of plain letters by vectorised merge rounds, others by the
    tokenizer's library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.merges = _WordMerges(_WordTables(json.load(file)["model"]))
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.forget()
        probe = ["two words", "a  b\nc", "Capitals ÉTÉ éù straße dass, ok"]
        for text in probe:
            if self._ids([text])[0] != b"".join(self._ids(text.split())) or self._ids([text]) != self._ids([text.lower()]):
                raise ValueError("this vocabulary's tokens cross white space or tell capitals apart")
        if self(probe[-1]) != self._ids([probe[-1]])[0]:
            raise ValueError("this vocabulary does not merge the bytes of words")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words. A plain word with trailing marks is its core's ids and those of the marks."""
        known, joined, new = self.known, [], set()
        for w in words:
            core = w.rstrip(_TAIL)
            if core is not w and len(core) < len(w) and core and core[-1].isalnum() and "<|" not in w and "'" not in w and (
                    w.isascii() or _is_plain(core)):
                tail = w[len(core):]
                joined += (w, core, tail)
                new.add(core)
                new.add(tail)
            else:
                new.add(w)
        new = list(new.difference(known))
        plain = [p for p in new if _is_plain(p)]
        if plain:
            ids, ends = self.merges.ids([p.lower() for p in plain])
            raw, size = ids.astype(self.type).tobytes(), self.type.itemsize
            at = 0
            for p, end in zip(plain, (ends * size).tolist()):
                known[p] = raw[at:end]
                at = end
        rest = [p for p in new if p not in known]
        known.update(zip(rest, self._ids(rest)))
        for k in range(0, len(joined), 3):
            known[joined[k]] = known[joined[k + 1]] + known[joined[k + 2]]

    def __call__(self, text: str | None) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; NULL is empty."""
        # Millions of words are made here and none of them refers to another; looking for rings among them takes a fifth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for t in texts:
            t = t or ""
            # Only these blanks are split at here; the tokenizer itself drops any other white space within a part.
            group.append((t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").replace("\t", " ").split(" "))
            size += len(t)
            if size >= GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> list[bytes]:
        if len(self.known) > MAX_WORDS:
            self.forget()
        new = set().union(*group).difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in group]


def _is_plain(word: str) -> bool:
    """Letters whose case and normal form are those of single characters (all below U+0250 but the dotted I)."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """``id, row, start, length, crc, total, rest``: windows and rests of each row; ``rest`` holds a rest's ids."""
    id_type = docs.schema["_id"].dataType
    out = [
        T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("total", T.LongType()),
        T.StructField("rest", T.BinaryType()),
    ]

    def make():
        tokens = word_ids(tokenizer)
        end = np.array([end_id], tokens.type).tobytes()

        def run(ids=None, rows=None, texts=None):
            if ids is None:
                tokens.forget()
                return
            got = {f.name: [] for f in out}
            for key, row, raw in zip(ids, rows, tokens.encode(texts)):
                whole = np.frombuffer(raw + end, tokens.type)
                for start in range(0, len(whole), window):
                    part = whole[start: start + window]
                    values = (key, row, start, len(part), _crc(part), len(whole),
                              part.tobytes() if len(part) < window else None)
                    for f, v in zip(out, values):
                        got[f.name].append(v)
                if len(got["id"]) > 4000:
                    yield got
                    got = {f.name: [] for f in out}
            yield got

        return run

    return emit_rows(docs, ["_id", "_row", "_text"], out, make)


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three lengths (0 for none) that occur and add up to a window."""
    here = np.zeros(window + 1, bool)
    here[present] = True
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    triples = []
    for first in range(GRID, window // 3 + 1, GRID):
        b = np.arange(first, (window - first) // 2 + 1)
        triples.append(np.stack([np.full_like(b, first), b, window - first - b], axis=1))
    every = np.concatenate([pairs, *triples])
    ok = here[every[:, 0]] & here[every[:, 1]] & ((every[:, 2] == 0) | here[every[:, 2]])
    return every[ok]


def least_squares(rows: np.ndarray, wanted: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that makes the lengths used by the rows come close to ``wanted``: multiplicative updates."""
    used = rows.ravel() > 0
    index = rows.ravel()

    def pulled(values: np.ndarray) -> np.ndarray:
        return (values[index] * used).reshape(rows.shape).sum(axis=1)

    target = pulled(wanted)
    x = np.maximum(target, 1e-9) / (1 + np.bincount(index[used], minlength=len(wanted)).mean())
    for _ in range(rounds):
        now = np.bincount(index, weights=np.repeat(x, rows.shape[1]) * used, minlength=len(wanted))
        x = x * target / np.maximum(pulled(now), 1e-12)
    return x


def filled(left: np.ndarray, length: int, window: int) -> list[int] | None:
    """Lengths that fill a window together with ``length``, out of what is left; the most frequent ones that do."""
    spare = left.copy()
    spare[window:] = 0
    spare[length] -= 1
    lengths, gap = [length], window - length
    while gap > 0:
        if spare[gap] > 0:
            return [*lengths, gap]
        b = np.arange(1, gap // 2 + 1)
        both = np.minimum(spare[b], spare[gap - b])
        both[(b == gap - b) & (spare[b] < 2)] = 0
        if len(both) and both.max() > 0:
            best = int(b[np.argmax(both)])
            return [*lengths, best, gap - best]
        small = spare[1: gap // 2 + 1]
        if not len(small) or small.max() <= 0:
            return None
        best = 1 + int(np.argmax(small))
        spare[best] -= 1
        lengths.append(best)
        gap -= best
    return lengths


class Plan:
    """Where the piece of a given length and rank goes."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.window = window
        counts = np.zeros(window + 1, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        left = counts.copy()
        slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        taken = np.zeros(window + 1, np.int64)
        sequence = 0

        def use(lengths: list[int], times: int) -> None:
            nonlocal sequence
            offset = 0
            for length in lengths:
                slots.append((length, int(taken[length]), sequence, offset))
                taken[length] += times
                left[length] -= times
                offset += length
            sequence += times

        if left[window]:
            use([window], int(left[window]))
        rows = combinations(np.flatnonzero(left[:window]), window)
        if len(rows):
            x = least_squares(rows, left.astype(float))
            for k in np.argsort(-x, kind="stable"):
                lengths = [int(v) for v in rows[k] if v]
                each = {v: lengths.count(v) for v in lengths}
                times = min([int(np.floor(x[k] + 0.5)), *(int(left[v]) // n for v, n in each.items())])
                if times > 0:
                    use(lengths, times)
        for length in range(window - 1, 0, -1):
            while left[length] > 0:
                lengths = filled(left, length, window)
                if lengths is None:
                    break
                use(lengths, min(int(left[v]) // lengths.count(v) for v in set(lengths)))
        self.first_rest = taken.copy()
        # What fits nowhere: longest first in one line, cut at every window.
        self.line = np.zeros(window + 1, np.int64)
        at = 0
        for length in range(window - 1, 0, -1):
            self.line[length] = at
            at += int(left[length]) * length
        self.rest_sequence = sequence
        self.sequences = sequence + -(-at // window)
        order = sorted(slots)
        self.keys = np.array([(s[0] << 44) + s[1] for s in order], np.int64)
        self.slots = np.array(order, np.int64).reshape(-1, 4)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset; a piece that crosses the end of its window goes on at the start of the next."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        planned = rank < self.first_rest[length]
        if planned.any():
            k = np.searchsorted(self.keys, (length[planned] << 44) + rank[planned], "right") - 1
            sequence[planned] = self.slots[k, 2] + rank[planned] - self.slots[k, 1]
            offset[planned] = self.slots[k, 3]
        rest = ~planned
        at = self.line[length[rest]] + (rank[rest] - self.first_rest[length[rest]]) * length[rest]
        sequence[rest] = self.rest_sequence + at // self.window
        offset[rest] = at % self.window
        return sequence, offset


def packed(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece; every id lies in one piece.

    A row's ids are those of its text and ``end_id``. NULL and empty texts are the end id alone. Repeated rows and rows
    with a NULL id are packed each. An empty table gives no pieces; other columns do not matter. Sequences count from 0
    without a gap, and all but the last one are full.
    """
    source = docs.select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_column).alias("_text"))
    pieces = materialize(_pieces(source, tokenizer, end_id, window), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row a length
    plan = Plan(histogram, window)
    narrow = pieces.select("id", "row", "start", "length", "crc", "total")
    ranked = with_position(narrow, ["length"], [F.col("row"), F.col("start")])
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = ["id", "row", "start", "length", "crc", "total", "sequence_id", "offset", "skip"]
    fields = [*narrow.schema.fields, *[T.StructField(n, T.LongType()) for n in names[6:]]]

    def make():
        place = shared.value

        def run(*columns):
            if not columns:
                return
            ids, rows, starts, lengths, crcs, totals, positions = columns
            length, rank = np.array(lengths, np.int64), np.array(positions, np.int64) - 1
            sequence, offset = place.place(length, rank)
            fit = np.minimum(length, window - offset)
            got = {n: [] for n in names}
            for k in range(len(ids)):
                parts = [(0, int(fit[k]), int(sequence[k]), int(offset[k]))]
                if fit[k] < length[k]:
                    parts.append((int(fit[k]), int(length[k] - fit[k]), int(sequence[k]) + 1, 0))
                for skip, size, s, o in parts:
                    whole = size == lengths[k]
                    values = (ids[k], rows[k], starts[k] + skip, size, crcs[k] if whole else None, totals[k], s, o, skip)
                    for n, v in zip(names, values):
                        got[n].append(v)
            yield got

        return run

    placed = materialize(emit_rows(
        ranked, ["id", "row", "start", "length", "crc", "total", "position"], fields, make), "placed")
    answer = [F.col("id").alias(id_column), "start", "length", F.col("crc").alias("ids_crc32"),
              F.col("total").alias("doc_tokens"), "sequence_id", "offset"]
    # Few pieces are cut, one for each window of residuals at most; only these need their ids once more.
    cut = materialize(placed.where("crc IS NULL").select("row", "start", "length", "skip", "id", "total", "sequence_id", "offset"), "cut")
    again = cut.withColumn("from", F.col("start") - F.col("skip")).join(
        pieces.select("row", F.col("start").alias("from"), "rest"), ["row", "from"])
    width = 2 if word_ids(tokenizer).type.itemsize == 2 else 4
    bytes_of = F.expr(f"substring(rest, cast(skip * {width} + 1 AS int), cast(length * {width} AS int))")
    # Ids are stored in two bytes where they fit; the checksum is over four.
    def widen():
        kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")

        def run(*columns):
            if not columns:
                return
            *kept, parts = columns
            got = dict(zip(["id", "start", "length", "total", "sequence_id", "offset"], kept))
            got["crc"] = [_crc(np.frombuffer(p, kind)) for p in parts]
            yield got

        return run

    kept = ["id", "start", "length", "total", "sequence_id", "offset"]
    mended = emit_rows(
        again.withColumn("_part", bytes_of), [*kept, "_part"],
        [f for f in placed.schema.fields if f.name in {*kept, "crc"}], widen)
    return placed.where("crc IS NOT NULL").select(*answer).unionByName(mended.select(*answer))

"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into words before every run of spaces (no piece crosses from a letter to a space, which is checked), and the
distinct words of a group of texts are laid out as one flat array of symbols. In each round every word finds the smallest
rank of its neighbouring pairs by a segmented minimum, all leftmost pairs of that rank merge at once, and the array is
compacted, until no pair remains. That equals merging one pair at a time as long as a merge makes no pair of a smaller rank;
where one does, the word's later merges of that round wait for the next.

Words that still have pairs after ``ROUNDS`` rounds are long. They go on with the same merges over a linked list and
a heap of ranks, where a round touches only the pairs of its rank, so a text without any space costs about its length.

Decoding looks up the bytes of each id in one flat table. Vocabularies without byte fallback, or whose normaliser does more
than turn spaces into their mark, are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubmetrics.llm.common import bound_batches, fields

SPACE = "▁"
#: Rounds over all words of a group; what is left then is merged over a linked list.
ROUNDS = 48
#: Characters of text that are encoded at a time, and words whose ids a task remembers between groups.
GROUP_CHARS = 1 << 21
MAX_WORDS = 1 << 17
NO_PAIR = np.int32(2**31 - 1)
_WORDS = re.compile(" *[^ ]+| +")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("pieces_each_byte", _each_byte)


class PieceTables:
    """A vocabulary as arrays: symbols of characters, merges of pairs of symbols, ranks, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = len(model)
        every = range(size)
        self.size, self.end_id = size, model.eos_id()
        pieces = [model.id_to_piece(i) for i in every]
        score = np.array([model.get_score(i) for i in every])
        self.silent = np.array([model.is_control(i) for i in every])
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in every])
        by_byte = {pieces[i]: i for i in every if model.is_byte(i)}
        if len(by_byte) != 256 or any(model.is_unused(i) for i in every):
            raise ValueError("only vocabularies with byte fallback and without unused pieces can be used")
        self.byte_ids = np.array([by_byte[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        number = {p: i for i, p in enumerate(pieces) if not special[i]}
        normal = list(number)
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:])):
            raise ValueError("pieces of this vocabulary cross from a letter to a space")
        # Characters of pieces that are no piece themselves are symbols too, with numbers from ``size``.
        letters = sorted({c for p in normal for c in p})
        symbol = dict(number)
        for c in letters:
            symbol.setdefault(c, size + len(symbol) - len(number))
        self.char_codes = np.array([ord(c) for c in letters], np.int64)
        self.char_symbols = np.array([symbol[c] for c in letters], np.int32)
        self.symbols = size + len(symbol) - len(number)
        order = np.unique(-score[list(number.values())], return_inverse=True)[1]
        self.rank = np.full(self.symbols, NO_PAIR, np.int32)
        self.rank[list(number.values())] = order
        merges = {}
        for p, i in number.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = i
        self.pairs = np.array(sorted((a * self.symbols + b, i) for (a, b), i in merges.items()), np.int64).reshape(-1, 2)
        # Pieces that a smaller rank can take up: after such a merge a pair of a smaller rank may stand beside it.
        parts = self.pairs[:, 0][:, None] // np.array([self.symbols, 1]) % self.symbols
        smaller = self.rank[self.pairs[:, 1]][:, None] <= self.rank[parts]
        self.early = np.zeros(self.symbols, bool)
        self.early[parts[smaller & (self.rank[parts] < NO_PAIR)]] = True
        raw = [b"" if self.silent[i] else pieces[i].replace(SPACE, " ").encode() for i in every]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        raw[model.unk_id()] = model.decode([model.unk_id()]).encode()
        self.lead = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.raw_ends = np.cumsum([len(r) for r in raw])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        work = Pieces(self)
        for text in ("Two words", "  a  b \n\tc ", "ﬁ Ａé \x00", " ", "", SPACE + "x", "9" * 40):
            if work.encode([text])[0].tolist() != model.encode(text):
                raise ValueError("the normaliser of this vocabulary does more than mark spaces")


class _Pairs:
    """Merged symbol of a pair, -1 if there is none: an open-addressing table, probed for all pairs at once."""

    def __init__(self, pairs: np.ndarray):
        bits = max(len(pairs), 1).bit_length() + 2
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = pairs
        at = self._slots(left[:, 0])
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = left[won, 0], left[won, 1]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            open_, at = open_[on], at[on]
        return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``starts[k] .. starts[k] + lengths[k]`` of every k, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """Encodes and decodes with one vocabulary; lives as long as its task."""

    def __init__(self, tables: PieceTables):
        self.tables = tables
        self.merged = _Pairs(tables.pairs)
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[tables.char_codes] = tables.char_symbols
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols merge to, and its rank."""
        to = self.merged(a.astype(np.int64) * self.tables.symbols + b)
        to[(a < 0) | (b < 0)] = -1
        return to, np.where(to >= 0, self.tables.rank[to], NO_PAIR)

    def _at_once(self, left: np.ndarray, p: np.ndarray, right: np.ndarray, to: np.ndarray, word: np.ndarray,
                 joined: np.ndarray) -> np.ndarray:
        """Which of the chosen merges (ordered, ``to`` made of ``p``) can go together with those before them in their word.

        ``left`` and ``right`` are the symbols beside each merge, -1 for none; ``joined`` tells that the left one is the
        result of the merge before. A merge after which a pair of its own or a smaller rank stands is the last of its word.
        """
        early = np.flatnonzero(self.tables.early[to])
        if not len(early):
            return np.ones(len(to), bool)
        before = np.where(joined, np.concatenate([[-1], to[:-1]]), left)[early]
        last = np.minimum(self._join(before, to[early])[1], self._join(to[early], right[early])[1]) <= self.tables.rank[to[early]]
        stop = np.zeros(len(to) + 1, np.int64)
        stop[early[last] + 1] = 1
        passed = np.cumsum(stop)[:-1]
        first = np.ones(len(to), bool)
        first[1:] = word[1:] != word[:-1]
        return passed - np.maximum.accumulate(np.where(first, passed, 0)) == 0

    @staticmethod
    def _leftmost(after: np.ndarray) -> np.ndarray:
        """Every other pair of each run of overlapping pairs; ``after[k]`` tells that pair k overlaps the one before."""
        k = np.arange(len(after))
        return (k - np.maximum.accumulate(np.where(after, 0, k))) % 2 == 0

    def _rounds(self, symbol: np.ndarray, word: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words when no pair remains, with their word and the first character of each."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        to, rank = np.full(len(symbol), -1, np.int32), np.full(len(symbol), NO_PAIR, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        to[inner], rank[inner] = self._join(symbol[inner], symbol[inner + 1])
        for _ in range(ROUNDS):
            if not len(symbol):
                break
            starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(word)]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = least < NO_PAIR
            if np.count_nonzero(open_) < 0.8 * len(open_):
                done.append((symbol[~open_], word[~open_], code[~open_]))
                symbol, word, code, to, rank, least = (x[open_] for x in (symbol, word, code, to, rank, least))
            at = np.flatnonzero((rank == least) & (rank < NO_PAIR))
            if not len(at):
                continue
            at = at[self._leftmost(np.concatenate([[False], at[1:] == at[:-1] + 1]))]
            end = len(symbol) - 1
            left = np.where((at > 0) & (word[at - 1] == word[at]), symbol[at - 1], -1)
            right = np.where((at + 2 <= end) & (word[np.minimum(at + 2, end)] == word[at]), symbol[np.minimum(at + 2, end)], -1)
            joined = np.concatenate([[False], (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]])])
            at = at[self._at_once(left, at, right, to[at], word[at], joined)]
            symbol[at] = to[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, code, to, rank = (x[keep] for x in (symbol, word, code, to, rank))
            at = at - np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                inside = i[i + 1 < len(symbol)]
                inside = inside[word[inside] == word[inside + 1]]
                to[i], rank[i] = -1, NO_PAIR
                to[inside], rank[inside] = self._join(symbol[inside], symbol[inside + 1])
        done.append(self._linked(symbol, word, code, to, rank))
        symbol, word, code = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order], code[order]

    def _linked(self, symbol, word, code, to, rank) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges that are left, rank by rank over a linked list; a smaller rank that turns up is next."""
        n = len(symbol)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        new = np.concatenate([[True], word[1:] != word[:-1]])[:n]
        before[new] = -1
        following[np.flatnonzero(new[1:])] = n
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(places: np.ndarray) -> None:
            places = places[rank[places] < NO_PAIR]
            places = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        push(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # a pair that has gone or changed has another rank
            if not len(at):
                continue
            every = at
            at = at[self._leftmost(np.concatenate([[False], following[at[:-1]] == at[1:]]))]
            second = following[at]
            beyond = following[second]
            left = np.where(before[at] >= 0, symbol[before[at]], -1)
            right = np.where(beyond < n, symbol[np.minimum(beyond, n - 1)], -1)
            joined = np.concatenate([[False], beyond[:-1] == at[1:]])
            now = self._at_once(left, at, right, to[at], word[at], joined)
            at, second, beyond = at[now], second[now], beyond[now]
            symbol[at] = to[at]
            symbol[second], rank[second] = -2, NO_PAIR
            following[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            to[at], rank[at] = -1, NO_PAIR
            to[at[inside]], rank[at[inside]] = self._join(symbol[at[inside]], symbol[beyond[inside]])
            back = before[at]
            back = back[back >= 0]
            to[back], rank[back] = self._join(symbol[back], symbol[following[back]])
            push(np.unique(np.concatenate([at, back, every[rank[every] == r]])))
        alive = symbol != -2
        return symbol[alive], word[alive], code[alive]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, appended to those that are known."""
        flat = "".join(words).replace(" ", SPACE)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        symbol, word, code = self._rounds(self.of_char[code], word, code)
        # Characters that are in no piece, as the bytes of their UTF-8 form.
        odd = (symbol < 0) | (symbol >= self.tables.size)
        size = np.where(odd, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        ends = np.cumsum(size)
        ids = np.zeros(ends[-1], np.int32)
        ids[(ends - size)[~odd]] = symbol[~odd]
        if odd.any():
            raw = code[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids[_ragged((ends - size)[odd], size[odd])] = self.tables.byte_ids[np.frombuffer(raw, np.uint8)]
        each = np.bincount(word, weights=size, minlength=len(words)).astype(np.int64)
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(each)])
        self.ids = np.concatenate([self.ids, ids])
        for w in words:
            self.known[w] = len(self.known)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id. NULL is empty; an empty text has none."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
        return out + (self._encode_group(group) if group else [])

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MAX_WORDS:
            self._forget()
        words: list[str] = []
        ends = []
        for t in texts:
            if t:
                words += _WORDS.findall(" " + t.replace(SPACE, " "))
            ends.append(len(words))
        new = list(set(words).difference(self.known))
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends_of = np.concatenate([[0], self.ends])
        length = self.ends[place] - ends_of[place] if len(words) else np.zeros(0, np.int64)
        flat = self.ids[_ragged(ends_of[place], length)]
        cuts = np.concatenate([[0], np.cumsum(length)])[ends]
        return np.split(flat, cuts[:-1]) if len(texts) else []

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of sequences of ids: control ids are silent, a first space is the mark that encoding put there, bytes
        that are no character become a replacement character each. A character's bytes do not reach over a control id."""
        t = self.tables
        starts = t.raw_ends - np.diff(np.concatenate([[0], t.raw_ends]))
        out = []
        for some in ids:
            some = np.asarray(some, np.int64)
            heard = [run[~t.silent[run]] for run in np.split(some, np.flatnonzero(t.silent[some[:-1]]) + 1)]
            raw = [t.raw[_ragged(starts[run], t.raw_ends[run] - starts[run])].tobytes() for run in heard if len(run)]
            first = next((run[0] for run in heard if len(run)), None)
            if first is not None and t.lead[first]:
                raw[0] = raw[0][1:]
            out.append("".join(r.decode("utf-8", "pieces_each_byte") for r in raw))
        return out


def _mapped(df: DataFrame, keep: list[str], read: str, added: list[T.StructField], tables: PieceTables, work) -> DataFrame:
    """Add the columns that ``work(pieces, column)`` makes of one column, batch by batch; nothing is shuffled."""
    bound_batches(df.sparkSession)
    schema = T.StructType(fields(df, keep) + added)
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(tables)  # its size is that of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            made = work(pieces, batch.column(len(keep)))
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *[m.cast(f.type) for m, f in zip(made, list(arrow)[len(keep):])]], schema=arrow)

    return df.select(*[F.col(c) for c in keep], F.col(read).alias("_read")).mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    return pa.LargeListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *arrays])).cast(pa.list_(pa.int32()))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode_pieces(docs: DataFrame, model: str, end: bool = True, id_column: str = "doc_id", text_column: str = "text",
                  decoded: bool = False) -> DataFrame:
    """``id, ids`` of each row of ``docs``, and with ``decoded`` the text that these ids give: row by row, no shuffle.

    Ids are those of the vocabulary's own library, with its end id last if ``end``. NULL and empty texts have the end id
    alone and decode to an empty text. Texts of any length are read whole; repeated rows and NULL ids are encoded each. An
    empty table gives no rows. Other columns, ``ids`` and ``decoded`` among them, are not looked at.
    """
    tables = PieceTables(model)
    tail = np.array([tables.end_id] if end else [], np.int32)

    def work(pieces: Pieces, texts: pa.Array) -> list[pa.Array]:
        ids = [np.concatenate([x, tail]) for x in pieces.encode(texts.to_pylist())]
        return [_lists(ids), *([pa.array(pieces.decode(ids), pa.string())] if decoded else [])]

    added = [_IDS, *([T.StructField("decoded", T.StringType())] if decoded else [])]
    source = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    return _mapped(source, [id_column], "_text", added, tables, work)


def decode_pieces(rows: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id, decoded``: the text of each row's ids; NULL ids give an empty text, NULL entries are left out.

    Ids that the vocabulary lacks are an error. Repeated rows are decoded each; an empty table gives no rows.
    """
    def work(pieces: Pieces, ids: pa.Array) -> list[pa.Array]:
        some = [np.array([i for i in x or [] if i is not None], np.int64) for x in ids.to_pylist()]
        if any(len(x) and not 0 <= x.min() <= x.max() < pieces.tables.size for x in some):
            raise ValueError("an id is not in the vocabulary")
        return [pa.array(pieces.decode(some), pa.string())]

    source = rows.select(F.col(id_column), F.col(ids_column).cast("array<int>").alias("_ids"))
    return _mapped(source, [id_column], "_ids", [T.StructField("decoded", T.StringType())], PieceTables(model), work)

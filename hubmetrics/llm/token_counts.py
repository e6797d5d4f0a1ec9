"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary is compiled into two deterministic transducers.

* ``Splitter`` cuts a text into the pieces that merges never cross. It has eight states; its alphabet is a character's
  class with one or two characters of look-ahead. Each symbol is a map from states to states, and all products of these
  maps form a small finite set with a multiplication table. So a text is cut into chunks of equal size, each chunk's map
  is found without knowing its first state, the maps are composed by a parallel prefix scan, and a second pass starts
  every chunk in its true state and marks where pieces start. All chunks of a batch advance together, however the
  characters are spread over documents, so one very long text is as parallel as many short ones.
* ``PieceTransducer`` reads a piece byte by byte. Its state holds the last token of the piece's best-known prefix at each
  place that a later token could still reach back to; a transition carries the change in the number of emitted tokens.
  States and transitions are compiled when first met and kept within a bound.

Counts are those of the tokenizer's own library without added special tokens; special strings in a text are one token.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import map_rows

#: Characters of text that are cut at a time.
GROUP_CHARS = 1 << 20
CHUNK = 64
#: Entries of a worker's memory of pieces and of states; beyond it the memory starts anew.
MAX_PIECES = 1 << 20
MAX_STATES = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + i)] = b
    return out


class PieceTransducer:
    """Counts the tokens of one piece; exact for merges that are applied in the order of their rank."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.bytes = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.bytes)}
        self.left, self.right = [-1] * 256, [-1] * 256
        self.made: dict[tuple[int, int], int] = {}
        for a, b in merges:
            joined = a + b
            if a not in number or b not in number or joined in number:
                continue
            number[joined] = len(self.bytes)
            self.made[number[a], number[b]] = len(self.bytes)
            self.bytes.append(joined)
            self.left.append(number[a])
            self.right.append(number[b])
        self._build_suffixes()
        self._fits: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self.reset()

    def _build_suffixes(self) -> None:
        """An automaton whose node is the longest end of what was read that starts a token; its tokens, longest first."""
        child: list[dict[int, int]] = [{}]
        depth, ends = [0], [-1]
        for token, text in enumerate(self.bytes):
            node = 0
            for b in text:
                following = child[node].get(b)
                if following is None:
                    following = child[node][b] = len(child)
                    child.append({})
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = following
            ends[node] = token
        fail, chain = [0] * len(child), [-1] * len(child)
        queue = list(child[0].values())
        for node in queue:
            chain[node] = node if ends[node] >= 0 else chain[fail[node]]
            for b, following in child[node].items():
                back = fail[node]
                while back and b not in child[back]:
                    back = fail[back]
                fail[following] = child[back].get(b, 0)
                queue.append(following)
        self.child, self.depth, self.ends, self.fail, self.chain = child, depth, ends, fail, chain

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.root = self._state((0, ((-1, 0),)))

    def _state(self, key: tuple) -> dict:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {-1: key}
        return state

    def fits(self, u: int, t: int) -> bool:
        """Whether ``u`` and ``t`` side by side stay two tokens.

        They do not if, of the tokens that end ``u`` and those that start ``t`` while both are built up, two stand side
        by side at the time their own merge is due.
        """
        known = self._fits.get((u, t))
        if known is None:
            if len(self._fits) > 4 * MAX_STATES:
                self._fits.clear()
            known = self._fits[u, t] = self._fits_now(u, t)
        return known

    def _fits_now(self, u: int, t: int) -> bool:
        far = len(self.bytes) + 1
        a, a_until = u, far
        while a >= 0:
            b, b_until = t, far
            while b >= 0:
                due = self.made.get((a, b))
                if due is not None and a < due > b and due < a_until and due <= b_until:
                    return False
                b_until, b = b, self.left[b]
            a_until, a = a, self.right[a]
        return True

    def alone(self, t: int) -> bool:
        """Whether the bytes of ``t`` by themselves give that token: its two parts are side by side when they are due."""
        known = self._alone.get(t)
        if known is None:
            if t < 256:
                known = True
            else:
                a, b = self.left[t], self.right[t]
                known = self.alone(a) and self.alone(b) and self._meet_only_at(a, b, t)
            self._alone[t] = known
        return known

    def _meet_only_at(self, u: int, t: int, joined: int) -> bool:
        far = joined + 1
        a, a_until = u, far
        while a >= 0:
            b, b_until = t, far
            while b >= 0:
                due = self.made.get((a, b))
                if due is not None and due < joined and a < due > b and due < a_until and due <= b_until:
                    return False
                b_until, b = b, self.left[b]
            a_until, a = a, self.right[a]
        return True

    def _compile(self, state: dict, b: int) -> tuple[dict, int]:
        node, lasts = state[-1]
        while node and b not in self.child[node]:
            node = self.fail[node]
        node = self.child[node].get(b, 0)
        at = self.chain[node]
        while at > 0:
            token, size = self.ends[at], self.depth[at]
            before, count = lasts[-size]
            if self.alone(token) and (before < 0 or self.fits(before, token)):
                break
            at = self.chain[self.fail[at]]
        else:
            raise ValueError("no token ends here")
        change = count + 1
        window = lasts[len(lasts) - self.depth[node]:]
        key = (node, (*[(x, n - change) for x, n in window], (token, 0)))
        step = state[b] = (self._state(key), change)
        return step

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total = self.root, 0
        for b in piece:
            step = state.get(b) or self._compile(state, b)
            total += step[1]
            state = step[0]
        return total


# States of the splitter, and its symbols: classes of characters with what follows them.
_BOUND, _LETTERS, _DIGITS, _OTHERS, _BLANKS, _BLANK_BEFORE, _CUT1, _CUT2 = range(8)
_L, _N, _O, _Q1, _Q2, _SP_LAST, _SP_IN, _WS_LAST, _WS_IN, _STOP, _INSIDE = range(11)
_CLASS_L, _CLASS_N, _CLASS_O, _CLASS_SP, _CLASS_WS = range(5)


def _transition(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if symbol == _STOP:
        return _BOUND, True
    if symbol == _INSIDE:
        return _BOUND, False
    if state == _CUT1 and symbol == _L:
        return _BOUND, False
    if state == _CUT2 and symbol == _L:
        return _CUT1, False
    joined = state == _BLANK_BEFORE
    if symbol == _L:
        return _LETTERS, not joined and state != _LETTERS
    if symbol == _N:
        return _DIGITS, not joined and state != _DIGITS
    if symbol in (_O, _Q1, _Q2):
        if joined or state == _OTHERS:
            return _OTHERS, False
        return {_O: _OTHERS, _Q1: _CUT1, _Q2: _CUT2}[symbol], True
    if symbol == _SP_LAST:
        return _BLANK_BEFORE, True
    if symbol == _WS_LAST:
        return _BOUND, True
    return _BLANKS, state != _BLANKS


def _character_classes() -> np.ndarray:
    kinds = np.full(0x110000, _CLASS_O, np.uint8)
    blanks = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            kinds[code] = _CLASS_L
        elif kind == "N":
            kinds[code] = _CLASS_N
    for code in blanks:
        kinds[code] = _CLASS_WS
    kinds[32] = _CLASS_SP
    return kinds


class Splitter:
    """Finds where pieces start in many texts at once."""

    def __init__(self):
        self.kinds = _character_classes()
        states, symbols = range(8), range(11)
        self.next = np.array([[_transition(s, y)[0] for y in symbols] for s in states], np.uint8)
        self.starts = np.array([[_transition(s, y)[1] for y in symbols] for s in states], bool)
        maps = [tuple(states)]
        number = {maps[0]: 0}
        steps: list[list[int]] = []
        for m in maps:
            row = []
            for y in symbols:
                after = tuple(int(self.next[s, y]) for s in m)
                if after not in number:
                    number[after] = len(maps)
                    maps.append(after)
                row.append(number[after])
            steps.append(row)
        self.step = np.array(steps, np.int32)
        self.maps = np.array(maps, np.uint8)
        self.product = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], np.int32)

    def symbols(self, codes: np.ndarray, stops: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Symbols of a run of characters; ``stops`` marks ends of texts and starts of special strings."""
        kinds = self.kinds[codes]
        cut = stops | inside
        blank = (kinds >= _CLASS_SP) & ~cut
        after = np.ones(len(codes) + 2, bool)  # what follows is a blank or nothing
        after[: len(codes)] = blank | cut
        last = ~after[1: len(codes) + 1]
        out = np.choose(kinds, [_L, _N, _O, _SP_IN, _WS_IN]).astype(np.uint8)
        out[(kinds == _CLASS_SP) & last] = _SP_LAST
        out[(kinds == _CLASS_WS) & last] = _WS_LAST
        quotes = np.flatnonzero((codes == 39) & ~cut)
        if len(quotes):
            padded = np.concatenate([np.where(cut, 0, codes), [0, 0]])
            first, second = padded[quotes + 1], padded[quotes + 2]
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = np.zeros(len(quotes), bool)
            for pair in ("re", "ve", "ll"):
                two |= (first == ord(pair[0])) & (second == ord(pair[1]))
            out[quotes[one]] = _Q1
            out[quotes[two]] = _Q2
        out[inside] = _INSIDE
        out[stops] = _STOP
        return out

    def piece_starts(self, symbols: np.ndarray) -> np.ndarray:
        """Flags of the characters at which a piece starts."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        grid = np.full(lanes * CHUNK, _INSIDE, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        maps = np.zeros(lanes, np.int32)
        for row in grid:
            maps = self.step[maps, row]
        reach = 1  # after a round, maps[i] covers this many chunks up to and with i
        while reach < lanes:
            maps[reach:] = self.product[maps[:-reach], maps[reach:]]
            reach *= 2
        state = np.zeros(lanes, np.uint8)
        state[1:] = self.maps[maps[:-1], _BOUND]
        flags = np.empty((CHUNK, lanes), bool)
        for i, row in enumerate(grid):
            flags[i] = self.starts[state, row]
            state = self.next[state, row]
        return flags.T.reshape(-1)[:n]


class TokenCounter:
    """Both transducers of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if spec["model"]["type"] != "BPE" or kind != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normaliser can be compiled")
        alphabet = byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pieces = PieceTransducer([tuple(bytes(alphabet[c] for c in part) for part in m) for m in merges])
        self.splitter = Splitter()
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.known: dict[str, int] = {}

    def _number(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MAX_PIECES:
                self.known.clear()
            n = self.known[piece] = 1 if piece in self.special else self.pieces.count(piece.encode("utf-8", "surrogatepass"))
        return n

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                out += self._count_group(group)
                group, size = [], 0
        return out + (self._count_group(group) if group else [])

    def _count_group(self, texts: list[str]) -> list[int]:
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        stops, inside = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        stops[ends] = True
        for word in self.special:
            at = whole.find(word)
            while at >= 0:
                if not (stops[at] or inside[at]):
                    stops[at] = True
                    inside[at + 1: at + len(word)] = True
                at = whole.find(word, at + len(word))
        starts = np.flatnonzero(self.splitter.piece_starts(self.splitter.symbols(codes, stops, inside)))
        cuts = starts.tolist()
        known, number = self.known, self._number
        counts = np.fromiter(
            (known.get(p) or number(p) for p in map(whole.__getitem__, map(slice, cuts, [*cuts[1:], len(whole)]))),
            np.int64, len(cuts),
        )
        counts[np.searchsorted(starts, ends)] = 0
        totals = np.concatenate([[0], np.cumsum(counts)])
        upto = totals[np.searchsorted(starts, ends)]
        return np.diff(np.concatenate([[0], upto])).tolist()


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled tokenizer per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of each row of ``docs``, row by row and without a shuffle.

    A NULL or empty text has 0 bytes and 0 tokens. Repeated rows and rows with a NULL id are each counted. Texts of any
    length are read whole. An empty table gives no row. Other columns of ``docs`` are not looked at.
    """
    def make():
        work = counter(tokenizer)

        def run(texts, sizes):
            n = work.count(texts)
            return {"n_bytes": sizes, "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    added = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    sized = docs.select(
        F.col(id_column), F.col(text_column).alias("_text"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint").alias("_size"),
    )
    return map_rows(sized, [id_column], ["_text", "_size"], added, make)

"""Lexical search, importance resampling and piece encoding against plain readings of their definitions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from test_llm import EXTRA, SF, alnum, frame

from hubmetrics.llm import importance, lexical, piece_bpe
from hubmetrics.llm.queries import QUERIES


# Lexical search


def plain_search(docs, items, top=20):
    terms = [alnum(t) for _, t in docs]
    total, words = sum(1 for w in terms if w), sum(map(len, terms))
    df = collections.Counter(t for w in terms for t in set(w))
    out = []
    for item, text in items:
        asked = collections.Counter(alnum(text))
        found = []
        for k, ((doc, _), w) in enumerate(zip(docs, terms)):
            m = 100 - 25 + (25 * len(w) * total) // max(words, 1)
            tf = collections.Counter(w)
            score = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                        for t, n in asked.items() if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, k, doc))
        out += [(item, rank, f[4], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return sorted(map(repr, out))


def searched(spark, docs, items, **more):
    rows = lexical.lexical_search(frame(spark, docs), spark.createDataFrame(items, "item_id string, text string"), **more)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in rows.collect())


def made_up(seed, n, words):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    texts = [" ".join(vocabulary[min(int(random.expovariate(6 / words)), words - 1)] for _ in range(random.randint(0, 30))) for _ in range(n)]
    return texts + random.choices(texts, k=n // 2)  # copies


@pytest.mark.parametrize("terms, leaf, seeds", [(10**6, 64, 10**6), (300, 2, 20), (10**6, 2, 40)])
def test_search_equals_a_plain_reading(spark, monkeypatch, terms, leaf, seeds):
    monkeypatch.setattr(lexical, "TREE_TERMS", terms)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "SEED_ROWS", seeds)
    texts = made_up(3, 120, 40)
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None), (5, texts[5]), (900, ""), (901, "W1 w1! é É")]
    items = [(f"i{k}", " ".join(random.choices(texts, k=2))) for k in range(12)] + [
        ("none", None), ("empty", " ?"), ("i0", texts[7]), (None, "w1 W1 w2"), ("odd", "unseen é"), ("long", " ".join(texts))]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, docs, items, top=3) == plain_search(docs, items, 3)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)
    texts = made_up(4, 40, 25)
    docs, items = list(enumerate(texts)), [(f"i{k}", texts[k]) for k in range(8)]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [("a", "word")]) == []
    assert searched(spark, [(1, "word")], []) == []
    assert searched(spark, [(1, None), (2, "")], [("a", "word")]) == []


def test_a_large_group_of_copies_stays_whole_and_is_pruned():
    rng = np.random.default_rng(1)
    rows = [np.array([3, 5, 9])] * 3000 + [np.unique(rng.integers(0, 40, 8)) for _ in range(500)]
    ends = np.cumsum([len(r) for r in rows])
    tree = lexical.Tree(ends, np.concatenate(rows), np.ones(ends[-1], np.int64), np.full(len(rows), 100), 40)
    assert sorted(tree.docs.tolist()) == list(range(len(rows)))
    places, weights = np.array([3, 5, 9, 12]), np.array([9, 7, 5, 3])
    docs, score = tree.search(places, weights, 0, 20)
    exact = np.array([sum(w * int(lexical.gain(np.int64(1), np.int64(100))) for p, w in zip(places, weights) if p in r) for r in rows])
    worst = np.sort(exact)[-20]
    assert set(docs.tolist()) == set(np.flatnonzero(exact >= worst).tolist())
    assert (score == exact[docs]).all()


# Importance resampling


def runs(text):
    w = alnum(text)
    return w, [zlib.crc32(b" ".join(w[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(docs, target, percent=5, least=20):
    own = [runs(t) for _, t in docs]
    source = collections.Counter(b for _, f in own for b in f)
    wanted = collections.Counter(b for t in target for b in runs(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (w, f) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [k for k, (w, _) in enumerate(own) if len(w) >= least]
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, k))
    for rank, k in enumerate(able[:percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("finish, chunk", [(4096, 1 << 20), (3, 7)])
def test_draw_equals_a_plain_reading(spark, monkeypatch, finish, chunk):
    monkeypatch.setattr(importance, "FINISH", finish)
    monkeypatch.setattr(importance, "CHUNK", chunk)
    texts = made_up(5, 300, 60)
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (None, None), (1, texts[1]), (1, texts[1]), (990, ""), (991, "One TWO é " * 3000)]
    target = [(1, "w1 w2 w3 w1 w2"), (2, None), (3, "")]
    rows = importance.importance_resample(frame(spark, docs), spark.createDataFrame(target, "item long, text string"), percent=30)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in rows.collect()) == plain_draw(docs, [t for _, t in target], 30)


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], EXTRA)
    some = frame(spark, [(k, " ".join(f"w{j}" for j in range(k, k + 25))) for k in range(40)])
    assert importance.importance_resample(none, some).count() == 0
    rows = importance.importance_resample(some, none).collect()
    assert len(rows) == 40 and sum(r["rank"] is not None for r in rows) == 2


def test_cutoff_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(importance, "FINISH", 1)
    monkeypatch.setattr(importance, "CHUNK", 3)
    keys = [(s % 4, None if s % 5 == 0 else s % 7, s) for s in range(60)]
    rows = spark.createDataFrame(keys, "score long, id long, row long").repartition(5)
    order = [("score", True), ("id", False), ("row", False)]
    want = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0, k[2]))
    for place in (1, 2, 17, 30, 59, 60):
        got = importance.cutoff(rows, order, place)
        assert (got["score"], got["id"], got["row"]) == want[place - 1]
    assert importance.cutoff(rows, order, 0) is None and importance.cutoff(rows, order, 61) is None


def test_draw_query_equals_a_plain_reading(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in QUERIES["op12_importance_resampling"](spark, SF).collect()) == plain_draw(docs, target)


# Piece encoding


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, piece_bpe.Pieces(piece_bpe.PieceTables(path)), SentencePieceProcessor(model_file=path)


PARTS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "▁", "漢", "字", "ß", "1", "9", ".", "'", "<", "😀", "́", "the", "ing", " of", "\x00",
         "re", "in", "<s>", "<0x0A>", "Ａ", "ﬁ", "\t", "aaaa", "er" * 9]


@pytest.mark.parametrize("rounds", [piece_bpe.ROUNDS, 0, 2])
def test_pieces_equal_the_library(pieces, monkeypatch, rounds):
    monkeypatch.setattr(piece_bpe, "ROUNDS", rounds)  # the rest is merged over the linked list
    path, _, library = pieces
    random.seed(rounds)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 40))) for _ in range(3000)] + [
        "", " ", "   ", "a" * 5000, "the" * 3000, "漢字" * 2000, "".join(random.choices("abcdefgh", k=4000))]
    ours = piece_bpe.Pieces(piece_bpe.PieceTables(path))
    ids = [x.tolist() for x in ours.encode([*texts, None])]
    assert ids[:-1] == library.encode(texts) and ids[-1] == []
    assert ours.decode(ids[:-1]) == [library.decode(x) if x else "" for x in ids[:-1]]


def test_words_are_forgotten_within_a_bound(pieces, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(piece_bpe, "GROUP_CHARS", 40)
    path, _, library = pieces
    texts = [" ".join(f"word{k} and {k * k}" for k in range(s, s + 9)) for s in range(60)]
    ours = piece_bpe.Pieces(piece_bpe.PieceTables(path))
    assert [x.tolist() for x in ours.encode(texts)] == library.encode(texts)


def test_any_ids_decode_as_in_the_library(pieces):
    _, ours, library = pieces
    random.seed(9)
    for _ in range(4000):
        ids = [random.choice([random.randrange(32000), random.randrange(300), 259, 28705, 2, 1, 0]) for _ in range(random.randint(1, 9))]
        assert ours.decode([ids]) == [library.decode(ids)]


def test_piece_columns(spark, pieces):
    path, _, library = pieces
    rows = [(1, "two  words"), (1, "two  words"), (None, None), (2, ""), (3, "é漢 " * 20000)]
    got = piece_bpe.encode_pieces(frame(spark, rows), path, decoded=True).collect()
    assert sorted(repr((r["doc_id"], list(r["ids"]), r["decoded"])) for r in got) == sorted(
        repr((k, [*library.encode(t or ""), 2], t or "")) for k, t in rows)
    ids = spark.createDataFrame([(1, [264, None, 2], 'x'), (2, None, 'x'), (3, [], 'x')], "doc_id long, ids array<int>, decoded string")
    assert {tuple(r) for r in piece_bpe.decode_pieces(ids, path).collect()} == {(1, "a"), (2, ""), (3, "")}
    assert piece_bpe.encode_pieces(spark.createDataFrame([], EXTRA), path).count() == 0
    with pytest.raises((ValueError, RuntimeError)):
        piece_bpe.PieceTables(public_tokenizers.path("byte_bpe_50k.json"))


def test_piece_query_equals_the_library(spark, pieces):
    _, _, library = pieces
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = QUERIES["op13_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = [*library.encode(docs[r["doc_id"]]), 2]
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))

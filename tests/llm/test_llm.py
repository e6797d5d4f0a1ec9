"""Each operator against a plain reading of its definition, with NULLs, empty and long texts, ties, repeats, extra columns."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hubmetrics.llm import embed_dedup, lm, ngram_join, packing, quality, toxicity, warc
from hubmetrics.llm.common import ASCII_LOWER, words_of
from hubmetrics.llm.decontamination import contamination
from hubmetrics.llm.embed_dedup import similar_vectors
from hubmetrics.llm.graph import components
from hubmetrics.llm.licenses import BASE_PHRASES, TEMPLATES, Index, license_scan
from hubmetrics.llm.ngram_join import ngram_components
from hubmetrics.llm.packing import Plan, packed
from hubmetrics.llm.queries import ORACLES, QUERIES
from hubmetrics.llm.token_counts import TokenCounter, token_counts
from oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EXTRA = "doc_id long, text string, _row long, n long, node string, _id string, score string, length string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", "l") for i, t in rows], EXTRA)


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(ASCII_LOWER))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# Token counts


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, TokenCounter(path), Tokenizer.from_file(path)


def test_counts_equal_the_library(byte_bpe):
    _, counter, library = byte_bpe
    random.seed(1)
    parts = ["'s", "'re", "' ", "  ", "\n", "\t ", "don't", " the", "123", "²", "é", "漢字", "🙂", "<|endoftext|>", "<|endof", "!!",
             "    ", "Hello", "'D", "ing", "́", "x" * 60, " ", "\x00", "\x1f"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * n for n in range(120)] + ["".join(random.choice("abcdeABC") for _ in range(400)) for _ in range(100)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == expected


def test_states_may_be_forgotten(byte_bpe, monkeypatch):
    _, counter, library = byte_bpe
    from hubmetrics.llm import token_counts as module
    monkeypatch.setattr(module, "MAX_STATES", 50)
    monkeypatch.setattr(module, "MAX_PIECES", 50)
    texts = ["some quite unusual wordings, unforgettable " * 20 + str(k) for k in range(20)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_a_table(spark, byte_bpe):
    path, _, library = byte_bpe
    rows = [(1, None), (2, ""), (None, "a b"), (3, "é" * 5000), (3, "word " * 1025), (3, "word " * 1025)]
    expected = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert rows_of(token_counts(frame(spark, rows), path)) == sorted(map(repr, expected))
    assert token_counts(frame(spark, []), path).count() == 0


# N-gram join


def brute_components(docs, n, percent):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if common and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def near_copies():
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([1, 2, 3, 5, 20, 40, 100, 400, 5000]))] for _ in range(30)]
    docs = []
    for _ in range(350):
        b = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3, 8])):
            k = random.randrange(len(b))
            b[k] = random.choice(vocabulary)
            if random.random() < 0.3:
                b.insert(k, random.choice(vocabulary))
        docs.append((random.randrange(2000), " ".join(b)))
    same = " ".join(base[0])
    return docs + [(1, None), (None, ""), (3, " \n"), (None, same), (9, same.upper()), (9, same)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent):
    docs = near_copies()
    found = ngram_components(frame(spark, docs), n, percent)
    assert rows_of(found.drop("kept", "_row")) == sorted(map(repr, brute_components(docs, n, percent)))
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(ngram_join, "WANTED_BITS", 64)
    rows = ngram_components(frame(spark, docs), n, percent).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == sorted(map(repr, brute_components(docs, n, percent)))
    groups = {c for _, size, c in brute_components([(k, t) for k, (_, t) in enumerate(docs)], n, percent) if size}
    assert sum(r.kept for r in rows if r.n_shingles) == len(groups)
    assert all(r.kept for r in rows if not r.n_shingles)


def test_bitmap_bound_is_never_too_low():
    random.seed(5)
    for _ in range(200):
        a = np.unique(np.array([random.getrandbits(64) for _ in range(random.choice([3, 300, 6000]))], np.uint64))
        b = np.unique(np.concatenate([a[: random.randrange(len(a) + 1)], np.array([random.getrandbits(64) for _ in range(9)], np.uint64)]))
        tile = ngram_join.Tile(np.array([len(a), len(b)]), [ngram_join.bitmap(a), ngram_join.bitmap(b)])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(tile.may_link(0, np.array([1]), 80)) == 1


def test_no_rows_no_components(spark):
    assert ngram_components(frame(spark, [])).count() == 0


def test_graph_components(spark):
    random.seed(1)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (300, 301), (301, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 4)], "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(61)) and all(found[200 + k] == 100 for k in range(50)) and found[301] == 300


# Language model


@pytest.mark.parametrize("size, top", [(1, 0), (1, 9), (50, 60), (1000, 10 ** 6), (3000, 2 ** 64 - 1)])
def test_elias_fano(size, top):
    values = np.unique(np.random.default_rng(size).integers(0, top + 1, size, dtype=np.uint64))
    level = lm.EliasFano({"x" + k: v for k, v in lm.EliasFano.build(values).items()}, "x")
    assert (level.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, np.random.default_rng(1).integers(0, top + 1, 300, dtype=np.uint64)])
    assert (level.successor(asked) == np.searchsorted(values, asked)).all()


@pytest.mark.parametrize("min_count", [1, 2])
def test_language_model(spark, monkeypatch, min_count):
    monkeypatch.setattr(lm, "SHARD_ROWS", 7)
    random.seed(4)
    docs = [(k, " ".join(random.choice(["the", "cat", "sat", f"w{random.randrange(30)}"]) for _ in range(random.randrange(40)))) for k in range(120)]
    docs += [(500, None), (None, "THE the\tcat"), (501, ""), (7, "the cat"), (7, "the cat")]
    folds = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5
    count, pairs, follows = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in docs:
        if folds(d) != 1:
            w = words_of(t) + [b""]
            count.update(w)
            pairs.update(zip(w, w[1:]))
    total, distinct = sum(count.values()), len(count)
    own = lambda w: (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
    fit = lambda m: sum(c * math.log((c - 1 + m * own(b)) / (count[a] - 1 + m)) for (a, b), c in pairs.items())
    prior = max(lm.PRIORS, key=fit)
    for (a, _), c in pairs.items():
        if c >= min_count:
            follows[a] += c

    def score(w):
        out = math.log10(own(w[0]))
        for a, b in zip(w, w[1:]):
            left = 1 - follows[a] / (count[a] + prior)
            kept = pairs[a, b]
            out += math.log10((kept / (count[a] + prior) if kept >= min_count else 0.0) + left * own(b))
        return out

    found = lm.lm_held_out(frame(spark, docs), min_count=min_count).collect()
    assert len(found) == len(docs)
    texts = collections.defaultdict(list)
    for d, t in docs:
        texts[d].append(words_of(t) + [b""])
    for r in found:
        w = next(x for x in texts[r.doc_id] if len(x) == r.n_tokens)
        assert (r.held_out, r.train_tokens, r.n_known) == (folds(r.doc_id) == 1, total, sum(count[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10(own(x)) for x in w), abs_tol=1e-6)
        assert math.isclose(r.score, score(w), abs_tol=1e-3 * len(w))
    assert lm.lm_held_out(frame(spark, [])).count() == 0


@pytest.mark.parametrize("min_count", [1, 2])
def test_language_model_pairs_of_rare_words(spark, monkeypatch, min_count):
    monkeypatch.setattr(lm, "SHARD_ROWS", 3)
    texts = ["the " * 350_000, "rare pair", "rare pair again", *[f"one{k} the" for k in range(20)], "the one3 one4", "hot rare", "hot pair", "hot rare pair"]
    count, pairs, follows = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        w = words_of(t) + [b""]
        count.update(w)
        pairs.update(zip(w, w[1:]))
    divisor = sum(count.values()) + 0.5 * (len(count) + 1)
    own = lambda w: (count[w] + 0.5) / divisor
    prior = max(lm.PRIORS, key=lambda m: sum(c * math.log((c - 1 + m * own(b)) / (count[a] - 1 + m)) for (a, b), c in pairs.items()))
    for (a, _), c in pairs.items():
        follows[a] += c if c >= min_count else 0
    asked = ["rare pair", "hot rare pair again", "pair", "unseen pair", "one3 one4 the"]
    model = lm.train(frame(spark, list(enumerate(texts))), min_count=min_count)
    assert sum(s[2] for s in model.pair_shards) == sum(c >= min_count for c in pairs.values())
    for r in lm.lm_scores(frame(spark, list(enumerate(asked))), model).collect():
        w = words_of(asked[r.doc_id]) + [b""]
        score = math.log10(own(w[0]))
        for a, b in zip(w, w[1:]):
            c = pairs[a, b] if pairs[a, b] >= min_count else 0
            score += math.log10((c / (count[a] + prior) if c else 0) + (1 - follows[a] / (count[a] + prior) if a in count else 1) * own(b))
        assert math.isclose(r.score, score, abs_tol=1e-3 * len(w)), asked[r.doc_id]


def test_pair_shards_split_a_context():
    pairs = lm.Pairs([(1, 5, 2, ""), (1, 9, 2, ""), (1, 12, 2, ""), (4, 2, 1, ""), (1 << 40, 1 << 40, 1, "")])
    a, b = [0, 1, 1, 1, 1, 1, 2, 4, 4, 1 << 40, 1 << 40], [9, 4, 5, 8, 9, 99, 0, 1, 2, 3, 1 << 40]
    assert pairs.shard(np.array(a), np.array(b)).tolist() == [-1, -1, 0, 0, 1, 2, 2, 2, 3, 3, 4]


# WARC


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 100)
    rows = [(5, "u", "x"), (3, "v\r\nq", "x"), (1, None, None), (2, "", ""), (9, "é", "ünï\r\n\r\nWARC/1.1\r\n"), (10, "q", "x"), (11, "h", "y" * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_warc(pages)
    found = {int(r.page_id): r for r in warc.read_warc(index).collect()}
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        raw, r = (h or "").encode(), found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        response = first[h or ""] == i
        assert (r.kind, r.refers_to) == (("response", None) if response else ("revisit", str(first[h or ""])))
        assert r.payload == (raw if response else None)
    some = warc.read_warc(index.where("page_id IN ('9', '11')")).collect()
    assert {r.page_id for r in some} == {"9", "11"}
    kinds = {r.kind for r in warc.read_warc(warc.write_warc(pages, minimum=10)).collect()}
    assert kinds == {"response"}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_neighbouring_ranges_are_read_at_once():
    assert warc.ranges([100, 0, 10 ** 7], [50, 100, 5]) == [(0, 150, [1, 0]), (10 ** 7, 10 ** 7 + 5, [2])]


# Quality and toxicity


def held_against_labels(spark, df, label):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    return df.join(labels, "doc_id").selectExpr("doc_id", "predicted", f"{label} AS label").toPandas()


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    got = held_against_labels(spark, quality.quality_scores(docs), "quality")
    assert (got.predicted == got.label).mean() > 0.98
    assert (got[got.label == 1].predicted == 1).mean() > 0.99


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "A plain text, as usual."), (3, "x"), (3, "x")] + [(k, "words in a row %d." % k) for k in range(20)]
    got = quality.quality_scores(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2) and r.weak_label == 0.0)
    assert quality.quality_scores(frame(spark, [])).count() == 0


def test_label_model_finds_the_faults():
    good, marked, shouted = [quality.GOOD] * 5, [quality.BAD] + [quality.GOOD] * 4, [quality.GOOD] + [quality.BAD] * 2 + [quality.GOOD] * 2
    number = lambda v: int("".join(map(str, v)), 3)
    posterior, _ = quality.estimate({number(good): 900, number(marked): 50, number(shouted): 50})
    assert posterior[number(good)] > 0.5 > max(posterior[number(marked)], posterior[number(shouted)])


def test_toxicity_on_the_held_out_fold(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).where("held_out")
    got = held_against_labels(spark, scores, "toxic")
    assert (got[got.label == 1].predicted == 1).mean() > 0.85 and (got[got.label == 0].predicted == 0).mean() > 0.99


def test_swaps_take_the_score_from_group_mentions(spark):
    rows = [(k, f"you idiot muslim number w{k % 7}") for k in range(200)] + [(1000 + k, f"a christian went home w{k % 7}") for k in range(200)]
    labels = spark.createDataFrame([(k, 1) for k in range(200)] + [(1000 + k, 0) for k in range(200)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    plain, fair = (toxicity.fit_toxicity(docs, labels, swap_weight=w) for w in (0.0, 10.0))
    gap = lambda m: abs(m.score("a muslim went home") - m.score("a christian went home"))
    assert gap(fair) < 0.1 * gap(plain) + 1e-3 and fair.score("what an idiot you are") > 0.5


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x y"), (3, "x"), (3, "x")])
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)


# Licences


def test_licence_places(spark):
    rows = [(1, "Released under the MIT License. CC-BY-NC cc by nc under the mit license"), (2, None), (None, ""), (4, "undermit the mit license"),
            (5, "Apache License, Version 2.0 apache license version 2"), (5, "x " * 50_000 + "cc by nc"),
            (6, "This work is licensed under the GNU General Public License, version 3.")]
    expected = {}
    for i, t in rows:
        w, starts, labels = alnum(t), [], set()
        for phrase, label in BASE_PHRASES.items():
            p = phrase.encode().split()
            found = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        expected[i, len(w)] = (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
    got = license_scan(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == expected
    assert next(r for r in got if r.doc_id == 6).labels == "gpl-3"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan(frame(spark, [])).count() == 0


def test_licence_notices_cut_short(spark):
    """A third of the rows hold no more of a template than its mandatory phrases."""
    gap = " x x x x "
    notices = [(label, gap.join(phrases)) for label, _, phrases in TEMPLATES]
    rows = [(k, f"some words {notices[k // 3 % len(notices)][1]}, and more" if k % 3 == 0 else f"plain text {k}") for k in range(39 * 3)]
    rows += [(900, "Permission is hereby granted, free of " + "x " * 9 + "charge"), (901, "version 3 of the gnu general public license"),
             (902, " ".join(n for _, n in notices)), (903, "charge granted hereby " * 50 + "permission is hereby granted free of charge"),
             (904, "gnu general public license " + "x " * 99 + "version 3"), (905, "redistribution and use in source and binary forms")]
    got = {r.doc_id: r for r in license_scan(frame(spark, rows)).collect()}
    for k in range(39 * 3):
        assert got[k].labels == (notices[k // 3 % len(notices)][0] if k % 3 == 0 else ""), rows[k]
        assert (got[k].score > 0) == (k % 3 == 0)
    assert [got[k].labels for k in (900, 901, 903, 904, 905)] == ["", "", "mit", "", "bsd-3"]
    assert set(got[902].labels.split(",")) == {n for n, _ in notices}


# Embeddings


def every_alignment(index, words):
    """Labels by trying each template at each start."""
    at = collections.defaultdict(list)
    for i, w in enumerate(words):
        if w in index.weight:
            at[w].append(i)
    out = {}
    for t in index.templates:
        if t.needed <= at.keys():
            for start in range(-len(t.words) - t.slack, len(words) + t.slack):
                share = index.share(t, start, words, dict(at))
                if share is not None:
                    out[t.label] = max(out.get(t.label, 0.0), share)
    return out


def test_licence_alignment_against_every_start():
    """Notices with words dropped, changed and put in, side by side and repeated; shares and labels as by brute force."""
    rng = random.Random(3)
    rows_with = {w.encode(): rng.choice([0, 1, 50, 900, 1000]) for t in TEMPLATES for w in t[1].split()}
    index = Index(TEMPLATES, 1000, rows_with)
    edited = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices(["the", "license", "a", "version", "2", "software", "q"], k=rng.randrange(30))
            rate = rng.choice([0, 0.05, 0.2])
            for w in rng.choice(TEMPLATES)[1].split():
                words += rng.choice([[], ["x"], [w, "y"], ["z", "q", w]]) if rng.random() < rate else [w]
        words = [w.encode() for w in words]
        found, expected = index.find(words), every_alignment(index, words)
        assert found == pytest.approx(expected)
        joined = b" " + b" ".join(words) + b" "
        edited += any(all(b" " + t[2][0].encode() + b" " not in joined for t in TEMPLATES if t[0] == label) for label in found)
    assert edited > 5


def test_edited_notices(spark):
    """Words put between those of a key phrase hide it from a phrase search; key words without the rest are no notice."""
    mit = next(t[1] for t in TEMPLATES if t[0] == "mit" and len(t[1]) > 300)
    texts = [mit.replace("hereby granted", "hereby irrevocably granted").replace("associated documentation files", "files"),
             mit.replace("granted", "refused"), "Permission slips is one thing; hereby he said granted a wish free and of no charge.", mit, mit]
    got = license_scan(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "", "", "mit", "mit"]
    assert 0.6 <= got[0].score < 1 and got[3].score == got[4].score == 1


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 64))
    rows = [(k, (base[rng.integers(20)] + rng.uniform(0, 0.3) * rng.standard_normal(64)).tolist()) for k in range(400)]
    rows += [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, []), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]),
             (2006, rows[0][1]), (2007, rows[0][1]), (2010, [None] * 64), (2011, [float("inf")] + [1.0] * 63)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node long, copies long")
    groups = collections.defaultdict(list)
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            groups[len(v)].append((i, np.array(v) / np.linalg.norm(v)))
    links = collections.Counter()
    for g in groups.values():
        x = np.stack([v for _, v in g])
        near = x @ x.T >= 0.95
        for k, (i, _) in enumerate(g):
            links[i] += int(near[k].sum()) - 1
    got = {r.vec_id: r for r in similar_vectors(vectors).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= links[i] for i, _ in rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2010, 2011))
    assert got[2005].component_id == 2004 and got[2007].component_id == got[0].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert similar_vectors(vectors.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(3).standard_normal((300, 8)) * 2
    points, far = embed_dedup.lattice_points(x)
    assert ((points[:, 0].sum(axis=1) % 4) == 0).all() and (far[:, 0] <= 1 + 1e-9).all() and (np.diff(far, axis=1) >= 0).all()


# Decontamination


def test_contamination_against_brute_force(spark):
    random.seed(3)
    some = lambda n: " ".join(random.choice(["a", "b", "c", "D", "é"]) for _ in range(n))
    items = [(k, some(random.choice([0, 3, 9, 10, 12, 30]))) for k in range(25)]
    fox = "the quick brown fox jumps over the lazy dog again and again"
    items += [(100, None), (None, "x y z"), (101, fox), (102, fox)]
    docs = [(k, some(random.choice([0, 5, 10, 40, 200]))) for k in range(100)]
    docs += [(1, None), (None, "x, y. z"), (7, ""), (8, "foo " + fox.upper()), (8, "foo " + fox.upper()), (9, fox[:-6])]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s:s + k])].add(i)
    expected = []
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[tuple(w[s:s + k])]
        names = sorted(str(i) for i in found if i is not None)
        expected.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(contamination(frame(spark, docs), benchmark).drop("_row")) == sorted(map(repr, expected))
    clean = contamination(frame(spark, docs), benchmark.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
    assert contamination(frame(spark, []), benchmark).count() == 0


# Packing


def test_packing_covers_every_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "it's <|endoftext|> don't, (ok) x<|endoftext|>y foo@. Ünï é 漢字 12345 ΑΣ. İx  y", "a " * 5000, "*** a|b| |"]
    texts += ["word " * k for k in range(60)] + ["b " * 1499 for _ in range(30)]
    docs = list(enumerate(texts)) + [(None, "x")]
    rows = packed(frame(spark, docs), path).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i in ids:
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    totals = []
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        totals.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert max(totals) <= 2048 and sum(t < 2048 for t in totals) <= 1
    assert packed(frame(spark, []), path).count() == 0


def test_plan_leaves_little_to_cut():
    rng = np.random.default_rng(2)
    lengths = 1 + rng.gamma(2.0, 350.0, 40_000).astype(int) % 2047
    plan = Plan(dict(collections.Counter(lengths.tolist())), 2048)
    assert plan.sequences - plan.rest_sequence < 0.02 * plan.sequences
    assert plan.sequences == -(-int(lengths.sum()) // 2048)


def test_least_squares_meets_an_exact_histogram():
    rows = packing.combinations(np.arange(1, 64), 64)
    wanted = np.zeros(65)
    for r in rows[:5]:
        for v in r[r > 0]:
            wanted[v] += 10
    x = packing.least_squares(rows, wanted, 500)
    made = np.bincount(rows.ravel(), weights=np.repeat(x, 3) * (rows.ravel() > 0), minlength=65)
    assert (x >= 0).all() and np.abs(made - wanted).max() < 1


# Queries and pipeline


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows = differences(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert problem == "" and rows > 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from hubmetrics.storage import materialize
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = set(docs.columns)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == names
            assert docs.exceptAll(before.select(docs.columns)).count() == 0 and docs.count() < before.count()
    assert docs.agg({"length": "sum"}).first()[0] > 0


ODD_DOCS = "_id string, doc_id long, text string, Stage_Row_0 long, stage_row_1 string, lang string, kept boolean, predicted int"


def odd_documents():
    """Good, repeated, missing, empty and very long texts, repeated and missing ids, names that stages use themselves."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("river", "paper", "garden", "window", "train") for b in ("s", "ed", "ing", "ly", "er", "")]

    def text(n):
        return " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(n // 9))

    a, long_one = text(90), text(30_000)
    bodies = [(1, a), (1, a), (None, a), (2, a + " Unlike the rest."), (3, None), (4, ""), (5, "  \n"), (None, None),
              (6, long_one), (7, text(120)), (7, text(120)), (8, "q"), (9, long_one + " End.")]
    return [("x", i, t, 7, None, "en", True, 1) for i, t in bodies]


def pipeline_tables(spark, tmp_path, docs, labels=(), items=()):
    frame = spark.createDataFrame(docs, ODD_DOCS)
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return frame


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp
    rows = odd_documents()
    docs = pipeline_tables(spark, tmp_path, rows, items=[(1, " ".join(rows[9][2].split()[20:32])), (None, None), (2, "")])
    sf = str(tmp_path)
    kept = {name: stage(spark, docs, sf) for name, stage in cp.STAGES[:-1]}
    for name, found in kept.items():
        assert found.schema.names == docs.schema.names, name
        assert found.exceptAll(docs).count() == 0, name
    ids = {name: sorted((r.doc_id if r.doc_id is not None else -1 for r in found.collect())) for name, found in kept.items()}
    # No label is known, so no text is known to be toxic.
    assert ids["toxicity"] == sorted(-1 if r[1] is None else r[1] for r in rows)
    assert not {3, 4, 5, -1} & {i for i in ids["quality_classifier"] if i in (3, 4, 5)}
    # One row of the three equal and the one near text, one of the two long ones; texts without words all stay.
    assert ids["ngram_jaccard_join"] == [-1, 1, 3, 4, 5, 6, 7, 7, 8]
    assert ids["benchmark_decontamination"] == sorted(-1 if r[1] is None else r[1] for k, r in enumerate(rows) if k != 9)
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy().sum("length").first()[0] == sum(
        r.n for r in pieces.where("start = 0").selectExpr("doc_tokens AS n").collect())


def test_stages_on_no_rows(spark, tmp_path):
    import corpus_pipeline as cp
    docs = pipeline_tables(spark, tmp_path, [])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_drop_the_right_rows_however_files_are_split(spark, tmp_path):
    """The decision and the removal read the stage's table with splits of different sizes."""
    import corpus_pipeline as cp
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(5000)], "doc_id long, text string")
    frame.repartition(3).write.option("parquet.block.size", 8192).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    numbered, row = cp._numbered(docs)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        dropped = numbered.where("doc_id % 3 = 0").select(row)
        splits = dropped.rdd.getNumPartitions()
        listed = spark.createDataFrame(dropped.collect(), dropped.schema)
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert splits > numbered.rdd.getNumPartitions()
        left = cp._without(numbered, row, listed)
        assert sorted(r.doc_id for r in left.collect()) == [i for i in range(5000) if i % 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_of_odd_ids_in_many_tasks(spark, monkeypatch):
    """Equal rows, equal, missing and empty ids, ids with line breaks; no task reads more than it should."""
    monkeypatch.setattr(warc, "TASK_BYTES", 500)
    rows = [("a", "u", "same"), ("a", "u", "same"), (None, "u", "same"), ("", "u", "other"), ("b\r\nX-Page-Id: c", None, "other"),
            ("z", "u", None), ("y", "u", ""), (None, None, None), ("long", "u", "x" * 200_000), ("é %41", "v\n", "q")]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string")
    index = warc.write_warc(frame)
    read = warc.read_warc(index)
    assert read.rdd.getNumPartitions() >= min(len(rows), 2 * index.select("archive").distinct().count())
    got = sorted((r.page_id or "", r.kind, r.refers_to or "", r.payload_bytes) for r in read.collect())
    least = {"same": "a", "other": "", "": "y"}
    first: set = set()
    expected = []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or "")):
        p = html or ""
        new = p not in first
        first.add(p)
        expected.append((page or "", "response" if new else "revisit", "" if new else least[p], len(p.encode())))
    assert got == sorted(expected)
    assert {r.page_id for r in read.collect()} == {r[0] for r in rows}
    assert warc.read_warc(index.where("false")).count() == 0
    assert read.union(warc.read_warc(index.union(index))).count() == 3 * len(rows)


def test_numbered_copies_of_the_pipeline_are_packed_tightly(spark):
    import corpus_pipeline

    numbered, row = corpus_pipeline._numbered(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert all(f.endswith(".zstd.parquet") for f in numbered.inputFiles()) and numbered.select(row).distinct().count() == 2
    assert {(r.doc_id, r.text) for r in numbered.collect()} == {(1, "a"), (2, None)}

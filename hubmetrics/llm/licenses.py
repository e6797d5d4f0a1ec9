"""Licence scan with a positional index of rare tokens.

The index maps each word of the templates to its places in them. How many rows have each of these words is counted over the
whole table, and words that fewer rows have weigh more. A template whose mandatory phrases' words a text all has is looked up
by its rarest words: as many as are needed for the others to weigh less than ``SHARE`` of it, so that no alignment of that
share can go unseen. Each of their places in the text, less the place in the template, tells where the template may start,
give or take a slack, and there the places of all its words are intersected: a word agrees if it stands within the slack of
its place. A template is found where its mandatory phrases stand with at most ``GAP`` words put between two of theirs and words of
``SHARE`` of its weight agree, so notices with edits are found that no phrase search finds; and where the first phrase stands
word for word with the others after it, however little of the rest is there, so notices cut short are found, too.
Base phrases are found wherever their words stand side by side, whatever the index says.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import alnum_words, emit_rows, map_rows

#: Base phrases and their labels (fixed values).
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label, template, mandatory phrases. Templates are notices and telling sentences of the public licence texts (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("under the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
     ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
              "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license", "2 0")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the software",
     ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                 "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required "
                 "by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                 "basis without warranties or conditions of any kind either express or implied", ("apache license version 2",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3 of the license or at your option any later "
              "version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 2 of the license or at your option any later "
              "version", ("gnu general public license", "version 2")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify and or distribute this software",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter "
             "it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
#: Share of a template's weight that has to agree where its phrases are edited, and words that may stand between two of theirs.
SHARE, GAP = 0.6, 3
#: Words by which a word may stand off its place, and three times by which a later phrase may; an eighth of longer templates.
SLACK = 6


class Template:
    """A template's words, where its phrases stand, and its words by rarity."""

    def __init__(self, label: str, text: str, phrases, weight: dict[bytes, float]):
        self.label, self.words = label, text.encode().split()
        self.phrases = [p.encode().split() for p in phrases]
        self.at = [next(k for k in range(len(self.words)) if self.words[k: k + len(p)] == p) for p in self.phrases]
        self.needed = frozenset(w for p in self.phrases for w in p)
        self.places: dict[bytes, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            self.places[w].append(k)
        self.slack = max(SLACK, len(self.words) // 8)
        self.weight = {w: weight[w] for w in self.places}
        self.total = sum(self.weight[w] for w in sorted(self.places))
        # Rarest words first, until what is left cannot agree enough without them.
        rare = sorted(self.places, key=lambda w: (-weight[w], w))
        left, self.openers = self.total, []
        for w in rare:
            if left < SHARE * self.total:
                break
            self.openers.append((w, self.places[w]))
            left -= weight[w]
        first = range(self.at[0], self.at[0] + len(self.phrases[0]))
        w = next(w for w in rare if any(k in first for k in self.places[w]))
        self.openers.append((w, [k for k in self.places[w] if k in first]))


def _near(places: list[int], low: int, high: int) -> bool:
    k = bisect_left(places, low)
    return k < len(places) and places[k] <= high


class Index:
    """Template words, their places, and what their rarity weighs."""

    def __init__(self, templates, rows: int, rows_with: dict[bytes, int]):
        vocabulary = {w for t in templates for w in t[1].encode().split()}
        self.weight = {w: math.log((rows + 1) / (rows_with.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
        self.templates = [Template(*t, self.weight) for t in templates]

    def find(self, words: list[bytes]) -> dict[str, float]:
        """Labels found in a text, each with its best share.

        The share is the weight of the agreeing words in that of the template's, or, where the phrases stand word for word,
        in that of the template's words that the text has.
        """
        present = self.weight.keys() & set(words)
        possible = [t for t in self.templates if t.needed <= present]
        if not possible:
            return {}
        at: dict[bytes, list[int]] = {w: [] for w in present}
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        found: dict[str, float] = {}
        for t in possible:
            seen = {i - k for w, places in t.openers for i in at.get(w, ()) for k in places}
            for start in sorted({s + d for s in seen for d in range(-t.slack, t.slack + 1)}):
                share = self.share(t, start, words, at)
                if share is not None:
                    found[t.label] = max(found.get(t.label, 0.0), share)
                    if found[t.label] == 1.0:
                        break
        return found

    def share(self, t: Template, start: int, words: list[bytes], at: dict[bytes, list[int]]) -> float | None:
        """The share of a template that may stand at ``start``, None if it does not stand there."""
        exact = self._word_for_word(t, start, words)
        if not exact and not all(self._phrase(t, j, start, at) for j in range(len(t.phrases))):
            return None
        # The postings of all words, intersected by their relative places.
        agreed = sum(t.weight[w] for w in sorted(t.places) if w in at and any(
            _near(at[w], start + k - t.slack, start + k + t.slack) for k in t.places[w]))
        if exact:
            return min(1.0, agreed / sum(t.weight[w] for w in sorted(t.places) if w in at))
        return min(1.0, agreed / t.total) if agreed >= SHARE * t.total else None

    def _word_for_word(self, t: Template, start: int, words: list[bytes]) -> bool:
        place, phrase = t.at[0], t.phrases[0]
        end = place + len(phrase)
        if start + place < 0 or words[start + place: start + end] != phrase:
            return False
        rest = b" " + b" ".join(words[start + end: start + len(t.words) + 3 * t.slack]) + b" "
        k = 0
        for later in t.phrases[1:]:
            needle = b" " + b" ".join(later)
            k = rest.find(needle + b" ", k)
            if k < 0:
                return False
            k += len(needle)
        return True

    def _phrase(self, t: Template, j: int, start: int, at: dict[bytes, list[int]]) -> bool:
        """Whether a phrase's words follow each other near its place, at most ``GAP`` words between two."""
        first, *later = t.phrases[j]
        low, high = start + t.at[j] - t.slack, start + t.at[j] + t.slack
        reached = at[first][bisect_left(at[first], low): bisect_right(at[first], high)]
        for w in later:
            reached = sorted({i for r in reached for i in at[w][bisect_right(at[w], r): bisect_right(at[w], r + 1 + GAP)]})
        return bool(reached)


def _document_counts(docs: DataFrame, text: str, vocabulary: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Rows, and rows that have each template word: a table as long as the vocabulary."""
    wanted = frozenset(vocabulary)

    def make():
        counts: dict[bytes, int] = defaultdict(int)
        rows = [0]

        def run(texts=None):
            if texts is None:
                yield {"word": [None, *[w.decode() for w in counts]], "n": [rows[0], *counts.values()]}
                return
            rows[0] += len(texts)
            for t in texts:
                for w in wanted & set(alnum_words(t)):
                    counts[w] += 1

        return run

    out = [T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]
    got = emit_rows(docs, [text], out, make).groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r["word"]: r["n"] for r in got}
    return by_word.pop(None, 0), {w.encode(): n for w, n in by_word.items()}


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", base=None, templates=TEMPLATES) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs``.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the smallest and largest of their
    starts (NULL without any). ``labels`` are the base labels and those of verified templates. ``score`` is 1 with a base
    phrase, else the best share of a verified template that agrees. NULL and empty texts have no words, no labels
    and score 0. Repeated rows and NULL ids are each scanned; an empty table gives no rows; other columns do not matter.
    """
    base = dict(base or BASE_PHRASES)
    source = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    vocabulary = sorted({w.encode() for t in templates for w in t[1].split()})
    rows, rows_with = _document_counts(source, "_text", vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((rows, rows_with, base, templates))

    def make():
        n, with_word, phrases, kinds = shared.value
        index = Index(kinds, n, with_word)
        needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

        def run(texts):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in texts:
                words = [w for w in alnum_words(text) if w]
                joined = b" " + b" ".join(words) + b" "
                starts, own = [], set()
                for needle, label in needles:
                    at = joined.find(needle)
                    while at >= 0:
                        starts.append(joined.count(b" ", 0, at + 1) - 1)
                        own.add(label)
                        at = joined.find(needle, at + 1)
                found = index.find(words)
                out["n_words"].append(len(words))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | found.keys())))
                out["score"].append(1.0 if own else max(found.values(), default=0.0))
            return out

        return run

    long = T.LongType()
    return map_rows(source, [id_column], ["_text"], [
        T.StructField("n_words", long), T.StructField("n_base", long), T.StructField("first_word", long),
        T.StructField("last_word", long), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ], make)

"""License scans: base phrases at every place, and templates found through a positional rare-token index."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lower_table, pieces, text_column

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, template in words, the phrase of it that must be there in full.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
        "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether "
        "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
        "redistribution and use in source and binary forms",
    ),
)
#: Share of a template's words that must stand at their places.
MATCH = 0.7
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def word_table() -> np.ndarray:
    return lower_table(lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), word_table()).hash


@dataclass
class Index:
    """Postings of every word of the templates: word to (template, place), and the words' document frequencies, by which a text's
    words are looked up from the rarest on."""

    idf: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()})
        hashes = _words_of(" ".join(self.words))
        order = np.argsort(hashes)
        self.hash, self.id_at = hashes[order], order.astype(np.int32)
        number = {w: i for i, w in enumerate(self.words)}
        self.rows = [np.array([number[w] for w in t.split()], np.int32) for _, t, _ in TEMPLATES]
        self.keys = [np.array([number[w] for w in k.split()], np.int32) for _, _, k in TEMPLATES]
        self.base = [(np.array([number[w] for w in p.split()], np.int32), label) for p, label in BASE.items()]
        self.weight = np.array([self.idf.get(w, 0.0) for w in self.words])
        self.key_at = [next(i for i in range(len(row)) if np.array_equal(row[i : i + len(key)], key)) for row, key in zip(self.rows, self.keys)]
        self.postings = defaultdict(list)
        for t, row in enumerate(self.rows):
            for place, w in enumerate(row.tolist()):
                self.postings[w].append((t, place))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each licence word among the words of a text, -1 for others."""
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.id_at[at], -1).astype(np.int32)

    def live(self, doc: np.ndarray, ids: np.ndarray, n: int) -> dict[int, list[int]]:
        """Of n texts (doc and number of each word, -1 for no licence word) those that hold all words of a template's key phrase:
        the templates they may hold."""
        held = np.zeros((n, len(self.words)), bool)
        known = ids >= 0
        held[doc[known], ids[known]] = True
        out: dict[int, list[int]] = defaultdict(list)
        for t, key in enumerate(self.keys):
            for d in np.flatnonzero(held[:, key].all(axis=1)).tolist():
                out[d].append(t)
        return out

    def templates(self, ids: np.ndarray, live: list[int]) -> tuple[set[str], float]:
        """Labels of the templates that a text (its words' numbers) holds, and the best share of a template matched where its key
        phrase is whole.

        The text's own licence words are looked up from the rarest on. A posting (template, place) of a word at p stands for the
        template beginning at p - place. Words of key phrases must agree: their beginnings are intersected. Other words are votes
        for beginnings. A template is done when no beginning is left, or when the words to come can't raise its best beginning to
        MATCH or over the best share so far."""
        known = np.flatnonzero(ids >= 0)
        known = known[np.argsort(ids[known], kind="stable")]
        words, first = np.unique(ids[known], return_index=True)
        places = dict(zip(words.tolist(), np.split(known, first[1:])))
        begins: dict[int, np.ndarray] = {}
        votes: dict[int, np.ndarray] = {}
        early: dict[int, list[np.ndarray]] = {t: [] for t in live}
        left = {t: sum(w in places for w in self.rows[t].tolist()) for t in live}
        open_, labels, best = set(live), set(), 0.0
        for w in sorted(places, key=lambda w: (-self.weight[w], w)):
            if not open_:
                break
            for t, place in self.postings[w]:
                if t not in open_:
                    continue
                at, size = places[w] - place, len(self.rows[t])
                left[t] -= 1
                if self.key_at[t] <= place < self.key_at[t] + len(self.keys[t]):
                    if t in begins:
                        stays = np.isin(begins[t], at)
                        begins[t], votes[t] = begins[t][stays], votes[t][stays] + 1
                    else:
                        begins[t], votes[t] = at, 1 + sum((np.isin(at, x) for x in early.pop(t)), np.zeros(len(at), np.int64))
                elif t in begins:
                    votes[t] = votes[t] + np.isin(begins[t], at)
                else:
                    early[t].append(at)
                if t not in begins:
                    continue
                share = votes[t].max(initial=0) / size
                if not len(begins[t]) or (share + left[t] / size < MATCH and share + left[t] / size <= best):
                    open_.discard(t)
                elif not left[t]:
                    open_.discard(t)
                    best = max(best, float(share))
                    if share >= MATCH:
                        labels.add(TEMPLATES[t][0])
        return labels, best


# One template names its key phrase apart: it must hold it as a run of its own words.
for _label, _text, _key in TEMPLATES:
    if f" {_key} " not in f" {_text} ":
        raise ValueError(f"template {_label}: its key phrase is not in it")


def document_frequencies(docs: DataFrame) -> dict[str, float]:
    """ln(documents / documents with the word) of each licence word, over the whole table. The words are a fixed
    list of some 250, and so are the rows collected."""
    index = Index()
    n_words = len(index.words)

    def count(batches):
        table = word_table()
        total = np.zeros(n_words + 1, np.int64)
        for batch in batches:
            for part in pieces(batch):
                w = Words(*text_column(part), table)
                ids = index.ids(w.hash)
                hit = np.flatnonzero(ids >= 0)
                pairs = np.unique(w.doc[hit] * np.int64(n_words) + ids[hit])
                total[:-1] += np.bincount(pairs % n_words, minlength=n_words)
                total[-1] += part.num_rows
        yield pa.record_batch({"word": pa.array(np.arange(n_words + 1), pa.int32()), "df": pa.array(total)})

    found = docs.select("text").mapInArrow(count, "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {r["word"]: r["df"] for r in found.collect()}
    n = df.get(n_words, 0)
    return {w: math.log((n + 1) / (df.get(i, 0) + 1)) for i, w in enumerate(index.words)}


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and templates in each whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest
    start, null without any), base_labels and labels (distinct, sorted, comma-joined; labels adds the templates'),
    score (best share of a template's words at their places, 0 to 1).
    Null or empty text: no words, empty labels, score 0. Repeated rows are scanned alike; null doc_ids stay null.
    An empty table gives an empty table; further columns of docs are ignored.
    """
    index = Index(document_frequencies(docs))

    def run(batches):
        table = word_table()
        for batch in batches:
            for part in pieces(batch):
                yield _scanned(index, part, table)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _scanned(index: Index, part: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    n = part.num_rows
    w = Words(*text_column(part), table)
    ids = index.ids(w.hash)
    count, low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in index.base:
        span = len(ids) - len(phrase) + 1
        if span <= 0:
            continue
        ok = np.ones(span, bool)
        for k, word in enumerate(phrase):
            ok &= ids[k : k + span] == word
        ok &= w.doc[:span] == w.doc[len(phrase) - 1 :]
        for at in np.flatnonzero(ok):
            d = w.doc[at]
            place = at - w.first[d]
            count[d] += 1
            low[d] = place if low[d] < 0 else min(low[d], place)
            high[d] = max(high[d], place)
            base[d].add(label)
    labels, score = [set(b) for b in base], np.zeros(n)
    for d, live in index.live(w.doc, ids, n).items():
        more, score[d] = index.templates(ids[w.first[d] : w.first[d + 1]], live)
        labels[d] |= more
    none = low < 0
    return pa.record_batch(
        {
            "doc_id": part.column(0),
            "n_words": pa.array(np.diff(w.first).astype(np.int64)),
            "n_base": pa.array(count),
            "first_word": pa.array(low, mask=none),
            "last_word": pa.array(high, mask=none),
            "base_labels": pa.array([",".join(sorted(x)) for x in base], pa.string()),
            "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
            "score": pa.array(score),
        }
    )

"""Ops 6, 8, 9 and 10 against plain Python on small fixtures and on a whole small table."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import chat, licenses, mixing, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, None, 0),
    (3, "a b", "en", "s", 3),
    (4, "x y z x y z\n\nx y z x y z\n#$", "en", "s", 9),
    (4, "x y z x y z\n\nx y z x y z\n#$", "en", "s", 9),
    (None, "é ß\x0b\x0cü <&>", "de", "s", 9),
    (5, "MIT License mit-license É mit  license general public license", "fr", "t", 1),
    (6, "Licensed under the Apache License, Version 2.0." + " w" * 30000, "fr", "t", 1),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if tri[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def licence(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_quality_base_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 7.0) for r in ODD], DOCS + ", d double")
    got = rows(quality.quality(docs), "doc_id", *quality.BASE, "base_failed")
    assert got == sorted(((r[0], *base(r[1])) for r in ODD), key=repr)


def test_quality_on_a_table(spark, sf):
    docs = queries.table(spark, sf, "documents")
    got = quality.quality(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def mcd_verdicts(rows, floors, cutoff):
    """Distances by a plain numpy estimate; rows: doc_id, text, lang, source. None where the base rules fail."""
    stats = [base(r[1]) for r in rows]
    ok = [k for k, s in enumerate(stats) if not s[-1]]
    n = np.array([max(s[0], 1) for s in stats], float)
    col = lambda i: np.array([s[i] for s in stats], float)
    x = np.column_stack([np.log(n), np.log((col(1) + 1) / n), np.log1p(20 * col(2) / n), np.log1p(20 * col(3) / n), np.sqrt(col(4) / n)])
    own = {k: (rows[k][2], rows[k][3]) for k in ok}
    size = collections.Counter(own.values())
    pooled = collections.Counter(g[0] for g in own.values() if size[g] < 30)
    group = collections.defaultdict(list)
    for k in ok:
        g = own[k]
        group[g if size[g] >= 30 else g[0] if pooled[g[0]] >= 30 else "*"].append(k)

    def fit(m, factor):
        mean = m.mean(0)
        c = (m.T @ m / len(m) - np.outer(mean, mean)) * factor
        np.fill_diagonal(c, np.maximum(np.diag(c), floors**2))
        return mean, c

    def dist(m, est):
        z = np.linalg.solve(np.linalg.cholesky(est[1]), (m - est[0]).T)
        return (z * z).sum(0)

    def reached(bins, share):
        bins = np.sort(bins)
        return bins[int(np.ceil(share * len(bins) - 1e-9)) - 1]

    out = [None] * len(rows)
    for ks in group.values():
        m, best = x[ks], None
        q = [(np.array([reached(np.floor(m[:, j] * 256), s) for j in range(5)]) + 0.5) / 256 for s in (0.25, 0.5, 0.75)]
        for first in ((np.abs(m - q[1]) / (q[2] - q[0] + floors)).max(1) <= 1.5, np.ones(len(m), bool)):
            est = fit(m[first], 1.0)
            for _ in range(3):
                bins = np.floor(np.log(np.maximum(dist(m, est), 1e-12)) * 64)
                est = fit(m[bins <= reached(bins, 0.75)], 1.0)
            if best is None or np.linalg.slogdet(est[1])[1] < np.linalg.slogdet(best[1])[1]:
                best = est
        d = dist(m, fit(m[dist(m, best) / quality.CONSISTENCY <= quality.NEAR], quality.REWEIGHTED))
        for k, v in zip(ks, d):
            out[k] = float(v)
    return out


def test_quality_verdicts_against_a_plain_estimate(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = dict(zip((r[0] for r in rows), mcd_verdicts(rows, np.array(list(quality.FEATURES.values())), quality.CUTOFF)))
    got = quality.quality(docs).collect()
    assert sum(r.kept for r in got) > len(got) / 2 and any(not r.kept and not r.base_failed for r in got)
    for r in got:
        if r.base_failed:
            assert r.distance is None and want[r.doc_id] is None and not r.kept
        else:
            assert r.distance == pytest.approx(want[r.doc_id], rel=1e-3) and r.kept == (r.distance <= quality.CUTOFF)
    again = {r.doc_id: r.kept for r in quality.quality(docs.repartition(13)).collect()}
    assert again == {r.doc_id: r.kept for r in got}


def test_quality_rejects_junk_of_several_kinds(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    clean = [(i, " ".join(text(rng.randint(60, 400))), "en", "s", 1) for i in range(400)]
    kinds = [lambda w: [x * 4 for x in w], lambda w: [x + "#" if k % 3 == 0 else x for k, x in enumerate(w)], lambda w: [x + ("\n" if k % 2 else "") for k, x in enumerate(w[:50] * 1 + [w[0], w[1], w[2] + str(w[3])] * 1)] + ["\nsame line\n"] * 12, lambda w: ["|".join(x) for x in w]]
    junk = [(1000 + 10 * j + k, " ".join(f(text(150))), "en", "s", 1) for j, f in enumerate(kinds) for k in range(5)]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert not any(kept[r[0]] for r in junk)
    assert all(kept[r[0]] for r in clean)


def test_quality_filter_judges_rows_one_by_one(spark):
    words = [f"w{i}" for i in range(300)]
    clean = [(i, " ".join(words[(i * 7 + k * (1 + i % 5)) % 300] for k in range(80)), "en", "s", 1, "a", 2) for i in range(60)]
    odd = [(None, None, "en", "s", 1, "a", 2), (None, clean[3][1] + " tail", "en", "s", 1, "a", 2), (5, "short", "en", "s", 1, "a", 2), (6, clean[6][1], "en", "s", 1, "a", 2)]
    docs = spark.createDataFrame(clean + odd, DOCS + ", u0 string, U1 int")
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert kept[(None, None)] == 0 and kept[(5, "short")] == 0 and kept[odd[1][:2]] == 1 and kept[clean[6][:2]] == 2
    assert sum(kept.values()) == len(clean) + 2


def test_quality_rejects_outliers_and_keeps_clean(spark):
    words = [f"w{i}" for i in range(400)]
    clean = [(i, " ".join(words[(i * 7 + k * (1 + i % 5)) % 400] for k in range(80 + i % 90)), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(words[(i + k) % 400] + "###$$$" for k in range(90)), "en", "s", 1) for i in range(20)]
    out = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert not any(out[1000 + i] for i in range(20))
    assert all(out[i] for i in range(300) if not base(clean[i][1])[-1])


def licence_templates(text):
    """Labels and score by trying every template at every place."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    labels, best = set(filter(None, licence(text)[4].split(","))), 0.0
    for label, template, key in licenses.TEMPLATES:
        t, k = template.split(), key.split()
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for i in range(len(w) - len(k) + 1):
            if w[i : i + len(k)] == k:
                share = sum(0 <= i - at + j < len(w) and w[i - at + j] == x for j, x in enumerate(t)) / len(t)
                best = max(best, share)
                if share >= 0.7:
                    labels.add(label)
    return ",".join(sorted(labels)), best


def test_license_labels_and_score_against_every_place(spark, sf):
    rng = random.Random(3)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()})
    texts = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = t[rng.choice([0, 0, 0, 2]) :]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 9.0, "x") for i, t in enumerate(texts)], DOCS + ", score double, labels string")
    for r in licenses.scan(docs).collect():
        assert (r.labels, r.score) == licence_templates(texts[r.doc_id])
    table = queries.table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in table.collect()}
    for r in licenses.scan(table).collect():
        assert (r.labels, r.score) == licence_templates(text[r.doc_id])


def test_license_base_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = rows(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((r[0], *licence(r[1])) for r in ODD), key=repr)


def test_license_templates(spark):
    texts = [
        "foo Licensed under CC BY-NC 4.0. bar",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of that software and associated documentation files",
        "Permission was hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "nothing here",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts * 1)] + [(9 + i, f"common words the of and number {i}", "en", "s", 1) for i in range(50)], DOCS)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[0] == ("cc-by-nc", 1.0)
    assert got[1][0] == "mit" and 0.9 < got[1][1] < 1
    assert got[2] == ("", 0.0)  # its key phrase is broken
    assert got[3] == ("", 0.0)


def test_license_many_templates_in_one_text(spark):
    whole = [t for _, t, _ in licenses.TEMPLATES]
    pairs = [(a, b) for i, a in enumerate(licenses.TEMPLATES) for b in licenses.TEMPLATES[i:]]
    texts = [f"{a[1]} filler {b[1]}" for a, b in pairs] + [" ".join(whole), "fee granted nc sa " * 500 + whole[0]]
    # the key phrase is whole, the words that are rarest here are not, or stand elsewhere
    texts.append("fee charge permission to use copy modify and or distribute this software for any purpose with or without cost is hereby given")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan(docs).collect()}
    for i, (a, b) in enumerate(pairs):
        assert {a[0], b[0]} <= got[i][0] and got[i][1] == 1.0
    assert got[len(pairs)][0] == {a for a, _, _ in licenses.TEMPLATES}
    assert got[len(pairs) + 1] == ({"mit"}, 1.0)
    assert got[len(pairs) + 2] == ({"isc"}, 18 / 20)


@pytest.mark.parametrize("op", [licenses.scan, quality.quality, mixing.mix_sources])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], DOCS)).count() == 0


def test_license_on_a_table(spark, sf):
    docs = queries.table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_mixing_shares(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a" if i % 4 else None, i) for i in range(4000)] + [(1, "t", "en", "a", 1)] * 2, DOCS + "")
    out = mixing.mix_sources(docs.selectExpr("*", "1 AS copy_no", "2 AS u"), weights={"a": 0.5, mixing.NO_SOURCE: 0.5})
    shares = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(shares["a"] - 2001) < 160 and abs(shares[None] - 2001) < 220
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "u", "copy_no", "shuffle_key"]
    assert rows(mixing.mix_sources(docs), "doc_id", "copy_no") == rows(mixing.mix_sources(docs.repartition(7)), "doc_id", "copy_no")


def poisson_brute(rate, u):
    """How many of the distribution's sums are at most u, summed in exact order from 0."""
    n, total, logp = 0, 0.0, -rate
    for k in range(int(rate + 12 * rate**0.5 + 25)):
        logp += math.log(rate / k) if k else 0.0
        total += math.exp(logp)
        if total > u:
            return n
        n += 1
    return n


def test_mixing_counts_of_low_and_high_rates(spark):
    rng = random.Random(2)
    rows = [(rate, rng.random()) for rate in (0.001, 0.3, 1.0, 17.5, 63.0, 65.0, 400.0, 5000.0, 60000.0) for _ in range(20)] + [(2.0, 0.0), (900.0, 0.0), (0.0, 0.5)]
    df = spark.createDataFrame(rows, "rate double, u double")
    got = df.select("rate", "u", mixing.poisson_count(mixing.poisson_first(F.col("rate")), mixing.poisson_weights(F.col("rate")), F.col("u")).alias("n")).collect()
    for r in got:
        assert r.n == (poisson_brute(r.rate, r.u) if r.rate and r.u else 0)


def test_mixing_a_lone_document_beside_a_crowd(spark):
    docs = spark.range(1, 40_001).selectExpr("id AS doc_id", "'t' AS text", "'crowd' AS source", "1 AS mix_n", "2 AS MIX_U").unionByName(spark.createDataFrame([(None, None, "lone", 1, 2), (0, "", None, 1, 2)], "doc_id long, text string, source string, mix_n int, MIX_U int"))
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    rate = 40_002 / 202  # of a source of one row
    for source, key in (("lone", ""), (None, "0")):
        assert n[source] == poisson_brute(rate, int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 2**52)


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    given = [
        (1, 0, "user", None),
        (1, 1, "assistant", "### <b>: \\b \\\\ </turn>\n### user:\n"),
        (1, 2, "us:\ner", "\\"),
        (1, 3, "assistant", "é" * 9999),
        (2, 5, "assistant", ""),
        (2, 5, "assistant", ""),
        (None, 0, None, "x</turn>"),
    ]
    log = chat.event_log(spark.createDataFrame([(*g, 1) for g in given], CHAT + ", message int"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(log)).collect()}
    for conv in (1, 2, None):
        turns = [(g[2] or "", g[3] or "") for g in given if g[0] == conv]
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_folds_events(spark):
    log = [(1, 2, 1, "delta", "user", "b"), (1, 1, 1, "delta", "user", "a"), (1, 3, 2, "delta", "assistant", "no"), (1, 4, 2, "regenerate", "assistant", None), (1, 5, 2, "delta", "assistant", "yes"), (1, 6, 1, "edit", "user", "q"), (1, 7, 1, "delta", "user", "?")]
    out = chat.messages(spark.createDataFrame(log, "conv_id long, seq long, message int, event string, role string, text string")).collect()
    assert [(t.role, t.text) for t in out[0].turns] == [("user", "q?"), ("assistant", "yes")]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, seq long, message int, event string, role string, text string")).count() == 0

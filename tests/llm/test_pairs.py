"""Ops 1, 2, 3 and 7 against brute force on small fixtures and a whole small table."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from tapewright.llm import embeddings, graph, jaccard, queries, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- op 7 ----


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    root = roots({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), root.get(i)) for i, s in sets), key=repr)


def jaccard_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()), key=repr)


def varied(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(n)]
    for _ in range(changes):
        base[rng.randrange(n)] = rng.choice(words)
    return base


def test_jaccard_fixture(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows, common = [], [rng.choice(words) for _ in range(40)]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for copy in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if family % 3 == 0:
                text += common  # a passage that unlike documents share
            rows.append((len(rows) + 1, " ".join(text)))
    rows += [(900, "One  two\tTHREE"), (901, "one two three"), (902, "one two three four"), (903, None), (904, ""), (905, " \n"), (906, "é\x00b"), (907, "a a a a a a a a a"), (908, "a a a a a a"), (900, "One  two\tTHREE"), (None, "one two three")]
    got = jaccard_rows(spark.createDataFrame([(i, t, None, None, 0, 1, 2) for i, t in rows], DOCS + ", n int, comp int"))
    assert got == jaccard_brute(rows)
    assert jaccard_rows(spark.createDataFrame([], DOCS)) == []


def test_jaccard_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "BUCKET", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 4)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    assert jaccard_rows(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)) == jaccard_brute(rows)


def test_jaccard_table(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_rows(docs)
    assert got == jaccard_brute(rows)
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, _, c in got if i == c}


def test_signature_never_rejects_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64))))
        if jaccard.linked(a, b, 75):
            sig = lambda x: np.frombuffer(jaccard.signature(x), np.uint8)
            assert jaccard.may_reach(sig(a), len(a), sig(b), len(b), len(b), 75)
            union = np.unique(np.concatenate((b, a[: len(a) // 3], np.arange(50, dtype=np.uint64))))
            assert jaccard.may_reach(sig(a), len(a), sig(union), min(len(a), len(b)), 500, 75)


# ---- op 1 ----


def suffix_brute(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def suffix_rows(df, length=200):
    return sorted((tuple(r) for r in suffix.dedup_report(df, length).collect()), key=repr)


def passage_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(45) for _ in range(3)] + [text(31)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), text(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    same = text(200)
    rows += [(100 + k, same) for k in range(4)] + [(104, same[:-1] + "!"), (105, "x" * 199), (106, "x" * 199), (107, "y" * 201), (108, "z" * 200), (109, "ab" * 500), (110, None), (111, ""), (111, ""), (112, "p" * 200), (112, "p" * 200), (None, "q" * 300), (113, "\x00" * 250)]
    return rows


def test_suffix_fixture(spark):
    rows = passage_rows()
    got = suffix_rows(spark.createDataFrame([(i, t, None, None, 0, "k", 3) for i, t in rows], DOCS + ", uid string, starts int"))
    assert got == suffix_brute(rows)
    assert suffix_rows(spark.createDataFrame([], DOCS)) == []


def test_suffix_small_blocks_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 3000)
    monkeypatch.setattr(suffix, "BUCKET", 40)
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "BROADCAST_IDS", 5)
    rows = passage_rows()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    states = {r.state for r in suffix.anchor_meetings(suffix.identified(docs), 3, 200).collect()}
    assert states == {suffix.REPEATED, suffix.COMPARE, suffix.CROWDED}
    assert suffix_rows(docs) == suffix_brute(rows)


def test_suffix_many_contexts_of_one_passage(spark, monkeypatch):
    """Texts that share a core shorter than a string but longer than an anchor, so that splitting goes all the way down."""
    monkeypatch.setattr(suffix, "HOT", 2)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, left, right = noise(150), [noise(90) for _ in range(9)], [noise(90) for _ in range(9)]
    rows = [(i, noise(30) + rng.choice(left)[rng.randint(30, 89) :] + core + rng.choice(right)[: rng.randint(1, 50)] + noise(30)) for i in range(70)]
    want = suffix_brute(rows)
    assert any(r[2] for r in want) and not all(r[2] for r in want)
    assert suffix_rows(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)) == want


def test_suffix_long_texts_in_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    off = np.array([0, 150, 3300, 5000])

    def strings():
        doc, start, count, place, h, s0, s1 = suffix.anchored_runs(raw, off)
        ends = start + count - 1 + 200
        same = {}
        for d, s, e, *mark in zip(doc, start, ends, place, s0, s1):
            same.setdefault(tuple(mark), set()).add(raw[off[d] + s : off[d] + e].tobytes())
        assert all(len(x) == 1 for x in same.values())
        return sorted((d, s + k, p - k, x) for d, s, c, p, x in zip(doc, start, count, place, h) for k in range(c))

    whole = strings()
    assert [(d, s) for d, s, *_ in whole] == [(d, s) for d in range(3) for s in range(off[d + 1] - off[d] - 199)]
    monkeypatch.setattr(suffix, "STRETCH", 700)
    assert strings() == whole


def test_suffix_texts_with_clashing_columns(spark):
    rows = passage_rows()
    plain = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    clash = plain.selectExpr("*", "doc_id AS u0", "'x' AS U1", "n_chars AS starts")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    got = sorted(suffix.dedup_texts(clash).collect(), key=key)
    assert [r[:5] for r in got] == [r[:] for r in sorted(suffix.dedup_texts(plain).collect(), key=key)]
    assert all(r.u0 == r.doc_id and r.U1 == "x" for r in got)


def test_suffix_table_and_texts(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = suffix_brute(rows)
    assert suffix_rows(docs) == want
    texts = {r.doc_id: r for r in suffix.dedup_texts(docs).collect()}
    assert docs.columns == suffix.dedup_texts(docs).columns
    for i, n, gone, _, digest in want:
        if not gone:
            assert hashlib.sha256(texts[i].text.encode()).hexdigest() == digest
        assert len(texts[i].text.encode()) <= n - gone and texts[i].n_chars == len(texts[i].text)


def test_suffix_array_brute():
    rng = random.Random(1)
    for trial in range(200):
        raw = bytes(rng.choice(b"ab" if trial % 2 else b"abc\x00\xfe") for _ in range(rng.randint(1, 90)))
        t = np.frombuffer(raw, np.uint8)
        length = rng.choice([8, 9, 16])
        sa = suffix.suffix_array(t, length)
        assert sorted(sa.tolist()) == list(range(len(raw)))
        valid = np.arange(len(raw)) + length <= len(raw)
        seen = collections.Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
        assert suffix.repeated_starts(t, valid, length).tolist() == [bool(valid[i]) and seen[raw[i : i + length]] > 1 for i in range(len(raw))]


# ---- op 3 ----


def cosine_brute(rows, threshold=0.93):
    good = {}
    for k, (i, e, label) in enumerate(rows):
        if label is None or e is None or not len(e) or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            continue
        good[k] = (label, np.array(e, np.float32).astype(float))
    n, links = collections.Counter(), []
    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if np.array_equal(x, y) or x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    links.append((rows[a][0], rows[b][0]))
    root = roots({i for i, _, _ in rows}, links)
    return sorted(((r[0], n[k], root[r[0]], r[0] == root[r[0]]) for k, r in enumerate(rows)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, n int, rep string"


def vector_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("tile", [1536, 7])
def test_embeddings_fixture(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "STRIP", 5)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(8):
        centre = rng.normal(size=16)
        for _ in range(9):
            v = (centre + rng.normal(size=16) * rng.choice([0.05, 0.3])).astype(np.float32)
            rows.append((len(rows), [float(x) for x in v], int(c % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(200, rows[3][1], 0), (201, rows[3][1], 0), (202, rows[3][1], 1), (203, rows[3][1], None), (204, None, 0), (205, [0.0] * 16, 0), (206, [nan] * 16, 0), (207, [inf] + [1.0] * 15, 0), (208, [None] + [1.0] * 15, 0), (209, [], 0), (210, [1.0, 2.0], 0), (211, [2.0, 4.0], 0)]
    got = vector_rows(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS))
    assert got == cosine_brute(rows)
    assert vector_rows(spark.createDataFrame([], VECTORS)) == []


def test_embeddings_cells_rule_out_pairs_of_tiles(spark, monkeypatch):
    """Clustered vectors of a label: far fewer pairs of tiles are read, and no link is lost."""
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(24):
        centre = rng.normal(size=12)
        for _ in range(14):
            v = (centre + rng.normal(size=12) * rng.choice([0.04, 0.15])).astype(np.float32)
            rows.append((len(rows), [float(x) for x in v], 1))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    made = []
    paired = embeddings._paired
    monkeypatch.setattr(embeddings, "_paired", lambda placed, threshold: made.append([paired(placed, threshold).select(*c).distinct().count() for c in (["i", "j"], ["tile"])]) or paired(placed, threshold))
    assert vector_rows(docs) == cosine_brute(rows)
    pairs, tiles = made[0]
    assert tiles > 20 and pairs < 0.5 * tiles * (tiles + 1) / 2, made


def test_embeddings_table(spark, sf):
    t = queries.table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    assert vector_rows(t) == cosine_brute(rows)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for l in links for x in l}, links)
    assert got == {k: v for k, v in want.items() if any(k in l and l[0] != l[1] for l in links)}


# ---- op 2 ----


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "sa") for b in ("ran", "dol", "fex", "gim", "hup", "jil", "vor", "wyn")]
    bad = ["scumlike", "vilesome", "rottenly"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic, junk = int(i % 7 == 0), int(i % 5 == 0)
        for _ in range(4 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, "".join(w + ("### " if junk else " ") for w in text), "en", "s", 1, 0.5))
        if i < 600:
            labels.append((i, 1 - junk, toxic))
    labels += [(None, 1, 1), (5000, 0, 1), (3, None, 1)]
    rows += [(901, None, "en", "s", 0, 0.0), (902, "", "en", "s", 0, 0.0)]
    docs = spark.createDataFrame(rows, DOCS + ", p_toxic double")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    held = range(600, 900)
    assert sum(got[i].toxic == (i % 7 == 0) for i in held) >= 295
    assert sum(got[i].junk == (i % 5 == 0) for i in held) >= 295
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(rows) and not any(r.toxic for r in none)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_against_a_plain_chain(spark):
    """The chain scored text by text in plain Python: words of a model once each, earlier probabilities as features."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ran", "dol", "fex", "gim", "hup")]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))] + ["vilesome"] * (i % 4 == 0) + ["###"] * (i % 3 == 0)
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(7, rows[7][1], "en", "s", 1), (8, "another text of this id", "en", "s", 1), (500, "Word " * 40_000 + "vilesome", "en", "s", 1), (None, "no id", "en", "s", 1), (501, None, "en", "s", 1)]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 240)] + [(3, 1, 1), (999, 1, 1), (None, 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    again = toxicity.train(docs.repartition(5), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert all(np.array_equal(a.weight, b.weight) and a.bias == b.bias for a, b in zip(chain.models, again.models)) and chain.cuts == again.cuts

    def plain(text):
        raw = (text or "").encode()
        found = re.findall(rb"[A-Za-z\x80-\xff]+", raw)
        spelled = [w.lower() for w in found]
        n = max(len(raw), 1)
        features = [math.log1p(len(found)), sum(chr(c) in "#*$%&|<>!" for c in raw) / n, sum(65 <= c <= 90 for c in raw) / n, sum(map(len, found)) / max(len(found), 1), len(set(spelled)) / max(len(found), 1)]
        hashes = {w: int(toxicity.extract(np.frombuffer(w, np.uint8), np.array([0, len(w)]), toxicity.word_table())[0].hash[0]) for w in set(spelled)}
        out = []
        for m, cut in zip(chain.models, chain.cuts):
            z = m.bias + sum(float(w) for h, w in zip(m.words, m.weight) if int(h) in hashes.values())
            z += sum(max(-6, min(6, (x - c) / s)) * b for x, c, s, b in zip(features, m.centre, m.spread, m.dense))
            p = 1 / (1 + math.exp(-z))
            out += [p, p >= cut]
            features.append(p)
        return out

    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(rows)
    want = sorted(((i, plain(t)) for i, t, *_ in rows), key=repr)
    seen = sorted(((r.doc_id, [r.p_junk, r.junk, r.p_toxic, r.toxic]) for r in got), key=repr)
    for (i, a), (j, b) in zip(sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1])), sorted(seen, key=lambda x: (x[0] is None, x[0] or 0, x[1]))):
        assert i == j and a == pytest.approx(b, abs=1e-9)


def test_embeddings_string_labels_and_extreme_vectors(spark):
    """Labels that look like components, null ids, and components near the ends of a double's range."""
    v = [3.0, 4.0]
    rows = [(1, "a", [1.0, *v]), (2, "a,1.0", v), (3, "a,1.0", v), (None, "a,1.0", v), (4, "b", [1e200, 2e200]), (5, "b", [1e-200, 2e-200]), (6, "b", [2e300, -1e300]), (7, "b", [5e-324, 1e-323]), (8, "b", [0.0, -0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got[1] == (0, 1, True) and got[2] == (2, 2, True) and got[3] == (2, 2, False)
    assert got[4] == (2, 4, True) and got[5] == (2, 4, False) and got[7] == (2, 4, False)
    assert got[6] == (0, 6, True) and got[8] == (0, 8, True)
    assert got[None] == (2, 2, False)


def test_embeddings_repeated_and_missing_ids(spark):
    """Every row is judged by its own vector, whatever its id; ids that are missing or at the ends of a long."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    ids = [None, None, None, 1, 1, 2, 2, 3, -(2**63), 2**63 - 1, 4, 5]
    rows = [(ids[rng.integers(len(ids))], centres[k % 6] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.4])) for k in range(150)]
    rows += [(1, np.array([1.0, 0])), (1, np.array([0.0, 1])), (2, np.array([1.0, 0.01])), (3, np.array([1.0, 0.02])), (None, np.array([-1.0, 0])), (None, np.array([-1.0, 0])), (None, np.array([0.0, -1]))]
    x = [v / np.linalg.norm(v) for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93] for i in range(len(rows))]
    want = []
    for i, (k, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            todo = [j for a in todo for j in links[a] if j not in reach and not reach.add(j)]
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        want.append((k, len(links[i]), least, k == least))
    df = spark.createDataFrame([(k, 7, v.tolist()) for k, v in rows], "vec_id long, label int, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r for r in got if r[0] == 1 and r[1] == 0] and [r for r in got if r == (None, 1, None, True)] and [r for r in got if r == (None, 0, None, True)]


def test_jaccard_keeps_one_row_of_a_class(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(5, a), (5, a), (6, a), (None, b), (None, b), (None, a), (7, "solo"), (8, None), (8, None), (9, ""), (4, b), (4, b + " tail")]
    docs = spark.createDataFrame([(i, t, None, None, 0, "g") for i, t in rows], DOCS + ", gone string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, a), (None, a), (None, b), (7, "solo"), (8, None), (9, ""), (4, b), (4, b + " tail")], key=repr)


def test_jaccard_doc_id_with_two_texts(spark):
    """A doc_id whose texts have equally many shingles links by either of them."""
    rng = random.Random(6)
    t = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "abc"]
    near = [x.rsplit(" ", 1)[0] + " end" for x in t]
    rows = [(1, t[0]), (1, t[1]), (2, near[0]), (3, near[1]), (4, near[2]), (5, t[2])]
    assert jaccard_rows(spark.createDataFrame([(i, x, None, None, 0) for i, x in rows], DOCS)) == jaccard_brute(rows)

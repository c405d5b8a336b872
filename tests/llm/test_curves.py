"""Ops 11 to 13: packing along a curve, periodic runs and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import merkle, order, packing, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows, extra=True):
    """Documents with columns of names that the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("idx", "size", "tree", "ids", "first", "runs", "start", "id", "leaf", "row", "part")}) if extra else df


# --- order


@pytest.mark.parametrize("weight", [None, "w"])
def test_places_in_groups(spark, weight):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 8 + ["b", "é", None]), rng.randrange(40), i, rng.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, i long, w long").repartition(7)
    got = order.placed(df, ["k", "i"], "place", "total", group="g", weight=weight).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        at = 0
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.i))
        for r in mine:
            assert r.place == at
            at += r.w if weight else 1
        assert {r.total for r in mine} == {at}


def test_places_of_nothing(spark):
    assert order.placed(spark.createDataFrame([], "k long"), ["k"], "place", "total").collect() == []


# --- packing

ODD = [None, "", " ", "don't stop, we'll see.  Foo,bar. a.b, ,. x.,\ty", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "É́a ÉCOLE é Σας ΟΔΟΣ, İstanbul ŞŞ", "日本語 テキスト,🤷🏽‍♀️.", "a\x0bb\x0cc\x85d\xa0e f", "ab." * 50, "a" * 3000, "1234, 5.6. a1. ²½ ǅ ﬁ", "Foo.\n\nBar,\r\nbaz."]


def test_tokens_are_the_library_s():
    coder = packing.WordTokens(PATH)
    for texts in (ODD, ODD[::-1] * 2, [" ".join(t for t in ODD if t)] * 2):
        ids, off = coder(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == coder.plain(t or ""), t


def test_tokens_after_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    coder = packing.WordTokens(PATH)
    for t in ("one two three four, five", "five four three two one.", "six one"):
        assert coder(pa.array([t]))[0].tolist() == coder.plain(t)
        assert len(coder.known) <= 3 + 5


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_every_cell_by_its_faces(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check_pieces(pieces, texts, length=packing.LENGTH):
    """Every id in one piece, sequences without gaps, one short sequence at most."""
    coder = packing.WordTokens(PATH)
    want = {k: [*coder.plain(t or ""), 1] for k, t in texts}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for k, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[k])
            body = np.array(want[k][at : at + p.length], "<u4").tobytes()
            assert (p.ids_crc32 if hasattr(p, "ids_crc32") else zlib.crc32(p.ids)) == zlib.crc32(body)
            at += p.length
        assert at == len(want[k])
    ends = []
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        ends.append(at)
    assert max(ends) <= length and sum(e < length for e in ends) <= 1


def test_packing_of_the_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    check_pieces(queries.op11_packing(spark, sf).collect(), texts)


def test_packing_of_odd_rows(spark):
    texts = [*enumerate(ODD), (None, "no id here"), (99, "very long " * 9000)]
    df = docs_of(spark, [(k, t, None, None, 0) for k, t in texts])
    got = packing.pack(df, PATH, length=64)
    rows = got.collect()
    check_pieces(rows, texts, 64)
    assert sorted(map(repr, packing.pack(df.repartition(5), PATH, length=64).collect())) == sorted(map(repr, rows))
    for s in packing.sequences(got).collect():
        assert len(s.ids) == 4 * sum(p.length for p in s.pieces)
    twice = packing.pack(df.where("doc_id = 3").unionByName(df.where("doc_id = 3")), PATH).collect()
    assert len(twice) == 2 and twice[0].ids == twice[1].ids
    assert packing.pack(df.limit(0), PATH).collect() == []
    assert {r.doc_id for r in packing.pack(df, PATH, end=None).collect()}.isdisjoint({0, 1, 2})


def test_neighbours_of_the_curve_are_alike(spark):
    """Documents of one vocabulary lie together: most neighbours in the packed order are of the same kind."""
    rng = random.Random(5)
    kinds = [[f"{c}{rng.randrange(1000)}" for _ in range(30)] for c in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, " ".join(rng.choices(kinds[i % 4], k=80)), None, None, 0) for i in range(200)]
    got = packing.pack(docs_of(spark, rows), PATH).where("start = 0").orderBy("sequence_id", "offset").collect()
    same = sum(a.doc_id % 4 == b.doc_id % 4 for a, b in zip(got, got[1:]))
    assert same > 0.6 * len(got)


# --- periodic runs


def brute(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 300), st.sampled_from([1, 2, 3, 40]), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6), st.integers(0, 10**6)), max_size=4), st.sampled_from([(24, 3), (2, 2), (6, 2)]), st.sampled_from([8, 512]), st.integers(0, 99))
def test_runs(n, letters, copies, rule, sparse, seed):
    rng = random.Random(seed)
    w = [rng.randrange(letters) for _ in range(n)]
    for a, p, size in copies if n else ():
        a %= n
        part = w[a : a + 1 + p % max(1, n // 3)]
        for i in range(size % (n - a + 1)):
            w[a + i] = part[i % len(part)]
    was, periodic.SPARSE = periodic.SPARSE, sparse
    try:
        assert periodic.find_runs(w, *rule) == brute(w, *rule)
    finally:
        periodic.SPARSE = was


def test_runs_of_very_long_texts():
    rng = random.Random(1)
    w = [rng.randrange(5000) for _ in range(30_000)]
    assert periodic.find_runs(w) == []
    assert periodic.find_runs([1] * 50_000) == [(0, 50_000, 1)]
    assert periodic.find_runs(w * 3 + [7]) in ([(0, 90_000, 30_000)], [(0, 90_001, 30_000)])


def test_periodic_rows(spark):
    texts = [None, "", " \t\n", "one two", "a b " * 20 + "end", "ha " * 50, "x\x1cy\xa0z " * 30, "ha " * 50]
    rows = [(i if i != 3 else None, t, None, None, 0) for i, t in enumerate(texts)]
    got = periodic.runs(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for k, t, *_ in rows if k == r.doc_id)
        w = (t or "").encode().split()
        assert r.n_words == len(w) and [(x.start, x.length, x.period) for x in r.runs] == brute(w)
        stays = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in brute(w))]
        assert bytes(r.collapsed) == b" ".join(stays)
    report = {r.doc_id: r for r in periodic.report(docs_of(spark, rows)).collect()}
    assert report[None].n_runs == 0 and report[None].start is None and report[None].collapsed_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert periodic.report(docs_of(spark, rows).limit(0)).collect() == []
    twice = periodic.report(docs_of(spark, rows[5:6] * 2)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_planted_tails_are_found():
    hit = 0
    for k in range(3000):
        words = [b"w%d" % i for i in range(200)]
        planted = periodic.repeat_tail(k, list(words))
        h = zlib.crc32(str(k).encode())
        if h % 10:
            assert planted == words
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert planted == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = periodic.find_runs(planted)
        if n - a >= max(24, 3 * p):
            hit += 1
            assert len(found) == 1 and found[0][2] == p
    assert hit > 150
    assert periodic.repeat_tail(None, [b"a"]) == [b"a"]


# --- Merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    changed = lambda r: low(r[1]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            proof, h = "", leaf(r, changed(r))
            for levels, at in ((trees[s], i), (top, place)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    before, after = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    proof, h, at = proof + before + after, sha(before + h + after), at // 16
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sources", [1, 20, 300])
def test_manifest(spark, sources):
    rng = random.Random(sources)
    names = [None, "", "é", "z"][: max(1, sources - 1)] + [f"s{i}" for i in range(sources - 4)]
    rows = [(None if i % 97 == 0 else i, rng.choice([None, "", "Aa É", "lower", f"Text {i}"]), rng.choice([None, "en"]), names[0] if i % 3 == 0 else names[i % len(names)], i % 7 or None) for i in range(700)]
    rows += [(5000, "Long " * 30_000, "en", "lone", 1)] + rows[:40]
    got = merkle.report(docs_of(spark, rows).repartition(6)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(n)]
    got = merkle.report(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


def test_frontier_meets_in_any_order(spark):
    """Events dealt at random leave nearly every parent to the rounds after the first."""
    leaves = spark.range(600).select(F.lit("t").alias("tree"), F.lit(600).cast("long").alias("size"), F.lit(0).alias("level"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = merkle.grow(leaves.repartition(9)).collect()
    level = [sha(str(i)) for i in range(600)]
    for k in (1, 2, 3):
        level = [sha("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
        assert [r.digest for r in sorted((r for r in nodes if r.level == k), key=lambda r: r.idx)] == level
    assert len(level) == 1 and len(nodes) == 38 + 3 + 1


def test_received_columns_are_checked(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", 1) for i in range(60)]
    got = merkle.manifest(docs_of(spark, rows), received={"text": F.when(F.col("doc_id") == 7, "forged").otherwise(F.col("text"))}).collect()
    assert [r.id for r in got if not r.verified] == [7]

"""Ops 4 and 5: the public tokenizer library and exact round trips."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
import tiktoken

from tapewright.llm import bpe, queries, warc

PATH, PATTERN = queries.tokenizer()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


ODD = [None, "", " ", "\n\n  \n x", "a" * 3000, "ab" * 700 + "é" * 900, "It's we'll 12345  <|endoftext|>", "\x1c\x1d a\x1e\x1f\x85b\xa0c d​e", "日本語テキスト 🤷🏽‍♀️", "\t\tfoo  bar\r\n", "x\u0000y"]


def test_words_as_the_library_splits_them(oracle):
    coder = bpe.Coder.get(PATH, PATTERN)
    texts = [t for t in ODD if t] + ["".join(chr(c) + "a " for c in range(b, b + 256) if not 0xD800 <= c < 0xE000) for b in range(0, 0x3100, 256)]
    for t, (ids, spelled) in zip(texts, coder.both(texts)):
        assert spelled == t.encode()
        assert ids == b"".join(i.to_bytes(4, "little") for i in oracle.encode_ordinary(t)), repr(t[:40])


def test_heap_and_recursion_agree():
    coder = bpe.Coder.get(PATH, PATTERN)
    words = ["antidisestablishmentarianism", "aaaaaaaaaaaaaaaa", "ééééêè", "ouauxelleeau", "xyzzy" * 120, "a" * bpe.LONG, "ab" * bpe.LONG]
    coder.learn(words)
    for w in words:
        assert coder.known[w] == b"".join(i.to_bytes(4, "little") for i in coder.contract_long(w.encode()))


def test_encode_table(spark, sf, oracle):
    docs = queries.table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode(docs, PATH, PATTERN, digests=True).collect()
    assert len(got) == len(text)
    for r in got:
        ids = oracle.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_encode_odd_rows_and_decode(spark, oracle):
    docs = spark.createDataFrame([(i if i else None, t, None, None, 0, 1) for i, t in enumerate(ODD)] * 2, DOCS + ", ids int")
    enc = bpe.encode(docs, PATH, PATTERN)
    rows = enc.collect()
    assert sorted(r.decoded for r in rows) == sorted([t or "" for t in ODD] * 2)
    assert all(r.ids == oracle.encode_ordinary(r.decoded) and r.n_tokens == len(r.ids) for r in rows)
    spelled = bpe.decode(enc.select("doc_id", "ids"), PATH, PATTERN).collect()
    assert sorted(bytes(r.spelled) for r in spelled) == sorted((t or "").encode() for t in ODD * 2)
    assert bpe.encode(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0


def test_documents_are_decoded_from_their_ids(monkeypatch):
    coder = bpe.Coder.get(PATH, PATTERN)
    monkeypatch.setattr(bpe, "TOKENS", 3)
    texts = [t or "" for t in ODD]
    rows = coder.both(texts)
    assert [b.decode() for _, b in rows] == texts
    word = coder.find("hello")[0]
    coder.known[word] = np.array([coder.ranks[b"x"]], "<u4").tobytes()
    assert coder.both(["hello hello"])[0][1] == b"x hello"
    del coder.known[word]


PAGES = "page_id long, url string, html string, record_type string"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def expect(pages, least=0):
    first = {}
    for i, _, h, *_ in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in pages:
        h = h or ""
        to = first.get(h)
        again = len(h.encode()) >= least and to is not None and i != to
        out.append((i, len(h.encode()), b32(h), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_odd_pages(spark, least):
    big = "é€" * 60000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"
    pages = [(1, "http://a/\r\nX: y", None, "x"), (2, None, "", "x"), (3, "u", big, "x"), (4, "u", big, "x"), (5, "http://é", "short", "x"), (6, "u", "short", "x"), (6, "u", "short", "x"), (None, "u", "lost", "x"), (None, "u", "short", "x"), (7, "u", "x" * 16384, "x"), (8, "u", "y" * 4096, "x")]
    got = warc.round_trip(spark.createDataFrame(pages, PAGES), least).collect()
    rows = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    assert rows == expect(pages, least)


def test_warc_payloads_come_back(spark, sf):
    from tapewright.llm.common import fresh_path

    pages = queries.table(spark, sf, "pages")
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages, path)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert back and all(html[k] == v for k, v in back.items())
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op5_warc(spark, sf).collect()]
    assert sorted(rows, key=repr) == expect([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_warc_revisits_refer_to_records_that_exist(spark):
    from tapewright.llm.common import fresh_path

    pages = [(1, "u", "x" * 40000, "r"), (2, "u", "x" * 40000, "r"), (2, "v", "x" * 40000, "r"), (3, "u", "y", "r"), (3, "u", "y", "r"), (3, "w", "y", "r"), (4, "u", "y", "r"), (None, "u", "y", "r"), (5, "u", None, "r"), (6, "u", "", "r")]
    path = fresh_path(spark, "warc-ids")
    warc.write_warc(spark.createDataFrame(pages, PAGES), path)
    ids, refers = [], []
    for f in spark.read.format("binaryFile").load(path).select("content").collect():
        for h, _ in warc.parse(gzip.decompress(f.content)):
            ids.append((h["WARC-Record-ID"], h["WARC-Type"]))
            if h["WARC-Type"] == "revisit":
                refers.append(h["WARC-Refers-To"])
    assert len(refers) == 5 and len({i for i, _ in ids}) == len(ids)
    assert all((r, "response") in ids for r in refers)
    back = warc.read_warc(spark, path).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(["x" * 40000, "y", "y", "y", ""])


def test_warc_empty_table_and_broken_archives(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    whole = "".join(r + warc.END for r in warc.records(1, "u", "z" * 50000, None)).encode()
    assert [h["WARC-Type"] for h, _ in warc.parse(whole)] == ["response"] + ["continuation"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-3]))
    assert warc.unchunked(warc.chunked(b"q" * 9000)) == b"q" * 9000

"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each task."""

from __future__ import annotations

import base64
import hashlib
import heapq

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Words of a recursive query at a time, and the sum of their squared sizes: both bound the rows that its steps leave behind.
CHUNK, SQUARES = 15_000, 1 << 23
#: Words over this many bytes are contracted by a heap of pairs: the recursion takes a step per contraction, and a step reads
#: the whole word.
LONG = 2_048
#: Tokens that are decoded by one query.
TOKENS = 1 << 20
#: Words that a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Unicode's white space; what \s means differs between regex libraries.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

ENCODE = """
WITH RECURSIVE state(step, w, p, t) AS (
  SELECT 0, w, p, t FROM words
  UNION ALL (
    WITH pair AS (
      SELECT step, w, p, t, lead(t) OVER o AS next_t, lag(p) OVER o AS prior_p FROM state WINDOW o AS (PARTITION BY w ORDER BY p)),
    best AS (
      SELECT w, min((rank::BIGINT << 32) | p) AS b
      FROM pair JOIN merges ON key = ((t::BIGINT << 20) | next_t) GROUP BY w)
    SELECT step + 1, pair.w, p, CASE WHEN p = (b & 4294967295) THEN (b >> 32)::INTEGER ELSE t END
    FROM pair JOIN best USING (w)
    WHERE prior_p IS NULL OR prior_p <> (b & 4294967295))
),
last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT w, list(t ORDER BY p) AS ids FROM state JOIN last USING (w, step) GROUP BY w ORDER BY w
"""
#: A character of ``letters`` is a byte: code point and value are equal.
DECODE = """
SELECT d, array_to_string(list(letters ORDER BY p), '') AS letters FROM ids JOIN vocabulary USING (t) GROUP BY d ORDER BY d
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def word_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out as Unicode's white space."""
    return regex.compile(pattern.replace("[^\\s", "[^" + SPACE).replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))


class Coder:
    """The merge table and vocabulary in DuckDB, and the words met so far."""

    _of: dict[tuple[str, str], Coder] = {}

    @classmethod
    def get(cls, path: str, pattern: str) -> Coder:
        """One per Python worker: the tables are made once."""
        key = (path, pattern)
        if key not in cls._of:
            cls._of[key] = cls(path, pattern)
        return cls._of[key]

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.find = word_pattern(pattern).findall
        self.byte_token = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.rank_of = {(a, b): r for a, b, r in pairs}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs))
        merges = pa.table({"key": pa.array((left << 20) | right), "rank": pa.array(rank.astype(np.int32))})
        vocabulary = pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "letters": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("rows", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.con.unregister("rows")
        self.known: dict[str, bytes] = {}

    def contract_long(self, word: bytes) -> list[int]:
        """The same contractions by a heap of (rank, place), in n log n."""
        n = len(word)
        token = self.byte_token[np.frombuffer(word, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = lambda i: self.rank_of.get((token[i], token[after[i]])) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != r:
                continue
            j = after[i]
            token[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := pair(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [t for t, a in zip(token, alive) if a]

    def spell(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation of TOKENS at a time."""
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        d = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        parts: list[list[bytes]] = [[] for _ in ids]
        for begin in range(0, len(flat), TOKENS):
            at = slice(begin, begin + TOKENS)
            rows = pa.table({"d": d[at], "p": np.arange(len(flat[at]), dtype=np.int32), "t": flat[at]})
            self.con.register("ids", rows)
            found = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("ids")
            for k, letters in zip(found.column("d").to_pylist(), found.column("letters").to_pylist()):
                parts[k].append(letters.encode("latin-1"))
        return [b"".join(x) for x in parts]

    def learn(self, new: list[str]) -> None:
        """Encode words into ``known``: ids as little-endian 32-bit integers."""
        words = sorted(((len(raw := word.encode()), word, raw) for word in new), key=lambda x: x[0])
        while words and words[-1][0] > LONG:
            _, word, raw = words.pop()
            self.known[word] = np.array(self.contract_long(raw), "<u4").tobytes()
        begin = 0
        while begin < len(words):
            squares = np.cumsum([n * n for n, _, _ in words[begin : begin + CHUNK]])
            part = words[begin : begin + max(1, int(np.searchsorted(squares, SQUARES, side="right")))]
            begin += len(part)
            size = np.array([n for n, _, _ in part], np.int64)
            letters = np.frombuffer(b"".join(raw for _, _, raw in part), np.uint8)
            place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
            rows = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), size), "p": place.astype(np.int32), "t": self.byte_token[letters]})
            self.con.register("words", rows)
            found = self.con.sql(ENCODE).to_arrow_table().combine_chunks()
            self.con.unregister("words")
            ids = found.column("ids").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            off = (ids.offsets.to_numpy() * 4).tolist()
            for k, (_, word, _) in enumerate(part):
                self.known[word] = flat[off[k] : off[k + 1]]

    def forget(self) -> None:
        """End of a task: most words of the next one are others."""
        self.known = {}
        release()

    def both(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text its ids as bytes, and the bytes that they decode to."""
        words = [self.find(t) if t else [] for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*words)
        self.learn(list(new))
        ids_of = self.known.__getitem__
        ids = [b"".join(map(ids_of, row)) for row in words]
        return list(zip(ids, self.spell([np.frombuffer(x, "<u4") for x in ids])))


def _slices(texts: list, limit: int = 4 << 20):
    """Rows of about ``limit`` characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, keep: bool = True) -> DataFrame:
    """Encode each whole text and decode it again.

    path: file of ranks, on every machine; pattern: what splits texts into words, each encoded by itself; keep: whether a
    Python worker remembers words for its next task, which saves time, or gives the memory back.
    Returns doc_id, n_tokens and, with ``digests``, ids_sha256 (of the ids as little-endian unsigned 32-bit integers)
    and decoded_sha256; else ids (array<int>) and decoded (string). Null or empty text: no ids, empty bytes. Repeated
    rows are encoded alike; null doc_ids stay null; an empty table gives an empty table; further columns are ignored.
    Each task contracts the distinct words it meets, the leftmost pair of least rank a step, all words at once, and decodes
    every document from its own ids. A text of any length is encoded whole; words over LONG bytes by a heap of pairs.
    """

    def run(batches):
        coder = Coder.get(path, pattern)
        for batch in batches:
            ids_in, texts, done = batch.column(0), batch.column(1).to_pylist(), 0
            for part in _slices(texts):
                rows = coder.both(part)
                cols = {"doc_id": ids_in.slice(done, len(part)), "n_tokens": pa.array([len(a) // 4 for a, _ in rows], pa.int64())}
                if digests:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows], pa.string())
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for _, b in rows], pa.string())
                else:
                    cols["ids"] = pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in rows], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array([b.decode() for _, b in rows], pa.string())
                done += len(part)
                yield pa.record_batch(cols)
        if not keep:
            coder.forget()

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {more}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``spelled`` (binary) of rows (doc_id, ids): the tokens' bytes by ordered aggregation; null ids: empty."""

    def run(batches):
        coder = Coder.get(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.record_batch({"doc_id": part.column(0), "spelled": pa.array(coder.spell([np.array(x or [], np.int32) for x in part.column(1).to_pylist()]), pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, spelled binary")

"""Packing token sequences along a space-filling curve through the documents' vectors."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, release, saved, scratch
from .order import placed

LENGTH = 2_048
#: Features that token ids are hashed to, and the coordinates that they are projected to.
FEATURES, DIMS = 1_024, 4
#: Bits of a coordinate in the curve's key: DIMS * BITS are under 63.
BITS = 12
#: Whole parts of a coordinate: sums of integers do not depend on the order of rows.
UNIT = 1 << 20
#: Words that a Python worker remembers, and words that are encoded at a time.
REMEMBERED, BATCH = 1_000_000, 2_000
#: Bytes of text that are worked on at a time.
PART = 4 << 20


class WordTokens:
    """Token ids of texts by a public tokenizer of the tokenizers library, each word encoded once.

    The tokenizer must treat white space as a boundary and drop it, and its letters must not depend on what lies beyond one:
    then ids of a text are those of its words, one after the other. Words are cut at space, tab, line feed and carriage return,
    and before a comma or full stop that ends one after an ASCII letter. ASCII letters are lowered first if the tokenizer
    lowers them, except in words with ``<|``, which may spell a special token.
    """

    _of: dict[str, WordTokens] = {}

    @classmethod
    def get(cls, path: str) -> WordTokens:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.lowers = self.plain("AB") == self.plain("ab")
        #: Word number by spelling; the words' ids end to end, and where each one's begin.
        self.known: dict[str, int] = {}
        self.pool, self.begin = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def forget(self, most: int) -> None:
        """Keep the words met first: frequent words are met early."""
        while len(self.known) > most:
            self.known.popitem()
        self.pool, self.begin = self.pool[: self.begin[len(self.known)]], self.begin[: len(self.known) + 1]

    def plain(self, text: str) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> None:
        """Encode words, many as one text where each is made of letters only: then the library tells them apart itself."""
        parts, ends, rest = [], [], [w for w in words if not w.isalpha()]
        simple = [w for w in words if w.isalpha()]
        order: list[str] = []
        for k in range(0, len(simple), BATCH):
            part = simple[k : k + BATCH]
            e = self.coder.encode(" ".join(part), add_special_tokens=False)
            word = np.array(e.word_ids, np.float64)
            if not len(word) or np.isnan(word).any() or word[-1] + 1 != len(part):
                rest += part
                continue
            order += part
            parts.append(np.array(e.ids, np.uint16))
            ends.append(np.searchsorted(word, np.arange(1, len(part) + 1)))
        alone = [e.ids for e in self.coder.encode_batch_fast(rest, add_special_tokens=False)]
        if alone:
            order += rest
            parts.append(np.array([t for ids in alone for t in ids], np.uint16))
            ends.append(np.cumsum([len(ids) for ids in alone]))
        before = np.cumsum([self.begin[-1], *map(len, parts)])
        self.begin = np.concatenate([self.begin, *[e + b for e, b in zip(ends, before)]]).astype(np.int64)
        self.pool = np.concatenate([self.pool, *parts])
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the n + 1 places where each begins."""
        texts = pc.fill_null(texts, "")
        if self.lowers:
            special = pc.match_substring(texts, "<|")
            lowered = pc.ascii_lower(texts)
            texts = pc.if_else(special, texts, lowered) if pc.any(special).as_py() else lowered
        words = pc.split_pattern(pc.replace_substring_regex(texts, "([A-Za-z])([,.])([ \t\n\r]|$)|[\t\n\r]", "\\1 \\2 "), " ")
        count = np.asarray(pc.list_value_length(words)).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        spelled = coded.dictionary.to_pylist()
        self.forget(REMEMBERED)
        new = [w for w in spelled if w not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, spelled), np.int64, len(spelled))
        which = number[np.asarray(coded.indices)]
        each = np.diff(self.begin)[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(upto[-1], dtype=np.int64)
        at += np.repeat(self.begin[which] - upto[:-1], each)
        return self.pool[at], upto[np.concatenate(([0], np.cumsum(count)))]


def projection() -> np.ndarray:
    """A fixed matrix of signs that takes FEATURES to DIMS."""
    bits = mix64(np.arange(1, FEATURES * DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(1)
    return bits.astype(np.float64).reshape(FEATURES, DIMS) * 2 - 1


def coordinates(ids: np.ndarray, off: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projected documents in whole parts: roots of hashed token counts, of unit length."""
    n = len(off) - 1
    out = np.zeros((n, DIMS), np.int64)
    feature = (mix64(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(FEATURES)).astype(np.int64)
    for a in range(0, n, 256):
        b = min(n, a + 256)
        rows = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
        counts = np.bincount(rows * FEATURES + feature[off[a] : off[b]], minlength=(b - a) * FEATURES).reshape(b - a, FEATURES)
        x = np.sqrt(counts)
        length = np.sqrt(counts.sum(axis=1, keepdims=True))
        out[a:b] = np.rint((x / np.maximum(length, 1)) @ matrix * UNIT)
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of cells (n x dims, below 2^bits): neighbours on the curve share a face.

    Skilling's transform (2004): from the top bit down, coordinates are exchanged or inverted so that the curve enters and
    leaves every sub-cube where its neighbours do; a Gray code over the dimensions then gives the digits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for high in range(bits - 1, 0, -1):
        low = (1 << high) - 1
        for i in range(dims):
            set_ = (x[i] >> high & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for high in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> high & 1, (1 << high) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for high in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> high & 1)
    return key


def _tokenized(path: str, end: int | None):
    def rows(batches):
        coder, matrix = WordTokens.get(path), projection()
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                ids, off = coder(part.column(1))
                if end is not None:
                    ids = np.insert(ids, off[1:], end)
                    off = off + np.arange(len(off))
                xs = coordinates(ids, off, matrix)
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((2 * off).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), body, *[pa.array(xs[:, k]) for k in range(DIMS)]], names=["id", "tokens", "ids", *[f"x{k}" for k in range(DIMS)]])
        release()

    return rows


def _keys(mean: list[float], spread: list[float]):
    """Coordinates to keys: a logistic curve spreads each over the cells as evenly as if it were normal."""

    def rows(batches):
        for batch in batches:
            xs = np.stack([np.asarray(batch.column(batch.schema.get_field_index(f"x{k}"))) for k in range(DIMS)], 1)
            z = np.round((xs - np.array(mean)) / np.array(spread), 9)
            cells = np.clip((1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(cells, BITS)), *batch.columns[:4]], names=["curve", "id", "tie", "row", "tokens"])

    return rows


def _cut(length: int):
    def rows(batches):
        for batch in batches:
            first, tokens = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2))
            bodies = batch.column(3)
            last = (first + tokens - 1) // length
            n = np.where(tokens > 0, last - first // length + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (first // length)[row]
            begin = np.maximum(sequence * length, first[row])
            size = np.minimum((sequence + 1) * length, (first + tokens)[row]) - begin
            start = begin - first[row]
            ids = [np.frombuffer(bodies[i].as_buffer(), "<u2", s, 2 * a).astype("<u4").tobytes() for i, a, s in zip(row.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), pa.array(tokens[row]), pa.array(sequence), pa.array(begin - sequence * length)],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return rows


def tokenized(docs: DataFrame, path: str, end: int | None = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens, ids, x0 .., row): every text's ids as little-endian 16-bit integers, ``end`` after them, and its coordinates."""
    kind = docs.schema[id_column].dataType.simpleString()
    xs = ", ".join(f"x{k} long" for k in range(DIMS))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(_tokenized(path, end), f"id {kind}, tokens long, ids binary, {xs}")
    return rows.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())


def moments(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and standard deviation of each coordinate over all rows, from exact sums."""
    wide = "decimal(38,0)"
    sums = [f(F.col(f"x{k}").cast(wide)) for k in range(DIMS) for f in (F.sum, lambda x: F.sum((x * x).cast(wide)))]
    n, *s = rows.agg(F.count("*"), *sums).first()
    if not n:
        return [0.0] * DIMS, [1.0] * DIMS
    variance = [max(1, (n * int(b) - int(a) ** 2) // (n * n)) for a, b in zip(s[::2], s[1::2])]
    return [int(a) / n for a in s[::2]], [v**0.5 for v in variance]


@scratch
def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int | None = 1, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Pieces of packed sequences: (id column, start, length, ids, doc_tokens, sequence_id, offset); with ``digests`` the CRC-32 of
    the ids (ids_crc32) instead of the ids, so that these are not written again.

    Token counts are hashed to FEATURES numbers, of which a fixed projection keeps DIMS; cells of these coordinates are ordered
    by a Hilbert curve, and texts are laid end to end by (place on the curve, id, hash of the ids) and cut every ``length``
    tokens, so that a sequence holds neighbours of the curve. Only the last sequence has less than ``length`` tokens. ``start``
    counts a text's ids before the piece, ``offset`` the sequence's; ``ids`` are little-endian unsigned 32-bit integers.

    ``path`` is a file of the tokenizers library with up to 65,536 ids, see WordTokens for what it must do; ``end`` is an id
    put after each text. A null text is empty, and an empty text has ``end`` alone; without ``end`` it has no piece. Texts of
    any length are tokenized whole and cut into as many pieces as they fill; a null id stands first among equals; repeated rows
    are packed as often as they are there; other columns are not read. An empty table gives no rows.
    """
    rows = saved(tokenized(docs, path, end, id_column, text), "tokenized", "zstd")
    mean, spread = moments(rows)
    kind = rows.schema["id"].dataType.simpleString()
    keys = rows.select("id", "tie", "row", "tokens", *[f"x{k}" for k in range(DIMS)]).mapInArrow(_keys(mean, spread), f"curve long, id {kind}, tie long, row long, tokens long")
    places = saved(placed(keys, ["curve", "id", "tie", "row"], "first", "all_tokens", weight="tokens").select("row", "first"), "packed-places")
    cut = rows.join(places, "row").select("id", "first", "tokens", "ids").mapInArrow(_cut(length), f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    body = F.crc32("ids").alias("ids_crc32") if digests else F.col("ids")
    return cut.select(F.col("id").alias(id_column), "start", "length", body, "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): each sequence's ids, and where its texts begin in it; at most one sequence in a group."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "start", "doc_id", "ids")))
    whole = pieces.groupBy("sequence_id").agg(held.alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.transform("held", lambda p: p.dropFields("ids")).alias("pieces"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with the CRC-32 of their ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, path, digests=True)

"""Suffix-array dedup: bytes covered by long strings that occur again anywhere in the corpus.

Candidates are found by content-defined anchors, so that a string meets its equals in one task without shipping every
suffix of the corpus; in each task a suffix array, built by two-stage sorting, and its adjacent common prefixes decide.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, forget, mix64, pieces, release, saved, text_column, unused

#: Bytes of a string that must not occur twice.
LENGTH = 200
#: Bytes of an anchor; each string of LENGTH bytes has the one with the least hash.
ANCHOR = 48
#: Anchors of a bucket, on average.
BUCKET = 1 << 17
#: Bytes of candidate text of a bucket, on average.
BLOCK = 1 << 20
#: Bytes of text from which a suffix array is built: its work arrays are 80 times as large.
SORTED = 256 << 10
#: Different texts of an anchor at most, for a suffix array; beyond, their strings meet by longer anchors.
HOT = 2_000
#: Ranges of offsets that a crowded anchor's strings are split into at once.
PARTS = 4
#: Runs that a task holds at once, to find equal ones before they are dealt.
HELD = 1 << 16
#: Ids that are broadcast to pick documents at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Low bits of the keys of the sliding minimum that hold places, and so the bytes hashed at once.
PLACE = np.uint64(26)
STRETCH = 16 << 20
#: Separates texts in a suffix array; no byte of UTF-8.
BREAK = 0xFF

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


# ---- suffix arrays ----


def _key8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number in the order of the bytes; places past the end read as BREAK."""
    padded = np.concatenate((t, np.full(8, BREAK, np.uint8)))
    out = np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(t)].astype(np.uint64)
    return out


def _sorted_directly(at: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of the first ``depth`` bytes (rounded up to 8) of their suffixes: ties of eight bytes are
    sorted by the next eight, and so on, until none is left or the depth is reached."""
    n = len(key8)
    order = at[np.argsort(key8[at], kind="stable")]
    key = key8[order]
    same = key[1:] == key[:-1]
    for skip in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        new_group = np.ones(len(where), bool)
        new_group[1:] = ~(same[where[1:] - 1] & (where[1:] == where[:-1] + 1))
        group = np.cumsum(new_group)
        places = order[where] + skip
        key = np.where(places < n, key8[np.minimum(places, n - 1)], np.uint64(0xFFFFFFFFFFFFFFFF))
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        order[where] = order[where[by]]
        key, group = key[by], group[by]
        same = np.zeros(len(order) - 1, bool) if len(order) else same
        again = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same[where[:-1][again]] = True
    return order


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successors (the ones a byte shorter) are sorted directly. The others follow by one scan
    over the buckets of first bytes: whoever comes first in order puts its predecessor at the head of that one's
    bucket. A bucket is scanned as a whole: first what earlier buckets put there, then, as long as there are any, the
    predecessors of these in the same bucket, then the directly sorted ones."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix compares with its successor as the first two unequal neighbouring bytes do
    unequal = np.flatnonzero(t[1:] != t[:-1])
    nxt = np.searchsorted(unequal, np.arange(n))
    smaller = np.zeros(n, bool)
    has = nxt < len(unequal)
    at = unequal[np.minimum(nxt, max(len(unequal) - 1, 0))] if len(unequal) else np.zeros(n, np.int64)
    smaller[has] = t[at[has]] < t[at[has] + 1]
    direct = _sorted_directly(np.flatnonzero(smaller), _key8(t), depth)
    edges = np.searchsorted(t[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[t[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for c in range(256):
        level = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        levels = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[(t[before] == c) & ~smaller[before]]
            levels.append(level)
        bucket = np.concatenate([*levels, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (t[before] > c)]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cut):
                heads[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefix_reaches(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and at b have their first ``length`` bytes in common."""
    out = np.ones(len(a), bool)
    left = np.arange(len(a))
    key8 = _key8(t)
    for skip in [*range(0, length - 7, 8), length - 8]:
        equal = key8[a[left] + skip] == key8[b[left] + skip]
        out[left[~equal]] = False
        left = left[equal]
    return out


def repeated_starts(t: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of the places where ``valid`` holds, those whose string of ``length`` bytes also starts at another of them."""
    sa = suffix_array(t, length)
    sa = sa[valid[sa]]
    out = np.zeros(len(t), bool)
    if len(sa) > 1:
        same = common_prefix_reaches(t, sa[:-1], sa[1:], length)
        out[sa[:-1][same]] = True
        out[sa[1:][same]] = True
    return out


# ---- anchors ----


def anchored_runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of neighbouring strings of ``length`` bytes that have the same anchor: doc, start, number of strings, how far
    behind the start the anchor stands, the anchor's hash, and two hashes of the run's bytes. A string's anchor is the one
    with the least hash of the byte strings of ``anchor`` bytes in it (the first of several), so equal strings have equal
    anchors at equal places. Strings never cross documents."""
    out = [[] for _ in range(7)]
    n = len(data)
    for lo in range(0, max(n - length + 1, 0), STRETCH):
        part = data[lo : lo + STRETCH + length - 1]
        m = len(part)
        if m < length:
            break
        (upto, inverse), (upto2, inverse2) = (_prefix_sums(part, base, back) for base, back in zip(_BASES, _INVERSES))
        with np.errstate(over="ignore"):
            h = mix64((upto[anchor:] - upto[:-anchor]) * inverse[: m - anchor + 1])
        key = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(key, length - anchor + 1)
        where = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        s = np.arange(len(where))
        doc = np.searchsorted(off, s + lo, side="right") - 1
        fits = s + lo + length <= off[doc + 1]
        s, doc, where = s[fits], doc[fits], where[fits]
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(s)))
        begin, doc, at = s[first], doc[first], where[first]
        end = begin + count - 1 + length
        shape = (count.astype(np.uint64) << np.uint64(8)) | (at - begin).astype(np.uint64)
        with np.errstate(over="ignore"):
            marks = [mix64(mix64((u[end] - u[begin]) * back[begin]) + shape) for u, back in ((upto, inverse), (upto2, inverse2))]
        for x, v in zip(out, (doc, begin + lo - off[doc], count, at - begin, h[at], *marks)):
            x.append(v)
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z, z, z, z, *(np.zeros(0, np.uint64) for _ in range(3))
    return tuple(np.concatenate(x) for x in out)


def _prefix_sums(part: np.ndarray, base: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes so far, each times a power of the base, and the inverses of the powers: any string's polynomial
    is a difference of sums times an inverse."""
    m = len(part)
    powers = np.full(m, base, np.uint64)
    powers[0] = 1
    inverse = np.full(m, back, np.uint64)
    inverse[0] = 1
    upto = np.zeros(m + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverse, out=inverse)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers, out=upto[1:])
    return upto, inverse


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours: minima from both ends of blocks of w meet at the window."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


# ---- the distributed operator ----

#: The columns that name a row: 128 bits of its id and text.
UID = ["u0", "u1"]
_RUN = {"h": np.uint64, "s0": np.uint64, "s1": np.uint64, "u0": np.int64, "u1": np.int64, "start": np.int32, "count": np.uint8, "off": np.uint8, "lo": np.uint8, "hi": np.uint8, "dup": np.uint8}
_MET = "u0 long, u1 long, start int, count int, off int, lo int, hi int, key long, state int"
#: What a row of a meeting says: all strings of the run occur again; the run stands for its equals and is to be compared
#: with the other texts of its anchor; the same, of an anchor with more than HOT texts.
REPEATED, COMPARE, CROWDED = 0, 1, 2


def _planes(x: np.ndarray) -> bytes:
    width = x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()


def _unplaned(blobs: list[bytes], dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.concatenate([np.zeros(0, dtype), *[np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel() for b in blobs]])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and u0, u1: 128 bits of the row's id and text, by which the stages below name it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("u0"), F.xxhash64(F.lit(1), "doc_id", "text").alias("u1"))


def picked(docs: DataFrame, ids: DataFrame, how: str, on: list[str] | None = None) -> DataFrame:
    on = on or UID
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, on, how)


def _classes(run: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which runs of an anchor are neighbours, and in it equal runs, and where a new class of equal runs begins."""
    order = np.lexsort((run["s1"], run["s0"], run["h"]))
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in ("h", "s0", "s1"):
        x = run[c][order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _dealt(run: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Runs packed by bucket of their anchor: of equal ones a single one, marked ``dup``, is dealt; that all of them are
    repeated is known already, and goes along in buckets below zero."""
    order, new = _classes(run)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.repeat(size > 1, size)
    run["dup"] = np.zeros(len(order), np.uint8)
    run["dup"][order[again]] = 1
    lone = order[new]
    bucket = (mix64(run["h"][lone]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    lone, bucket = lone[by], bucket[by]
    rows: list[tuple] = []
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        rows.append((int(bucket[a]), *(_planes(run[c][lone[a:b]]) for c in _RUN)))
    known = order[again]
    if len(known):
        salt = int(run["u0"][known[0]]) & 0x7FFFFFFFFFFFFFFF
        rows.append((-1 - salt % buckets, *(_planes(run[c][known]) for c in _RUN)))
    cols = list(zip(*rows)) or [[] for _ in range(len(_RUN) + 1)]
    return pa.record_batch([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", *_RUN])


_DEALT = "bucket long, " + ", ".join(f"{c} binary" for c in _RUN)


def _met(dealt: DataFrame) -> DataFrame:
    """What the runs of each anchor say of each other (see REPEATED, COMPARE, CROWDED); runs that met none are gone."""

    def meet(table: pa.Table) -> pa.Table:
        run = {c: _unplaned(table.column(c).to_pylist(), t) for c, t in _RUN.items()}

        def said(rows: np.ndarray, state) -> pa.Table:
            cols = {c: run[c][rows] for c in UID} | {c: run[c][rows].astype(np.int32) for c in ("start", "count", "off", "lo", "hi")}
            return pa.table(cols | {"key": run["h"][rows].view(np.int64), "state": np.broadcast_to(np.int32(state), len(rows)).copy()})

        if table.column("bucket")[0].as_py() < 0:
            return said(np.arange(len(run["h"])), REPEATED)
        order, new = _classes(run)
        h = run["h"][order]
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        again = np.repeat(size > 1, size) & (run["dup"][order] == 0)
        anchor = np.ones(len(h), bool)
        anchor[1:] = h[1:] != h[:-1]
        texts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor)) if len(h) else np.zeros(0, np.int64)
        texts = np.repeat(texts, np.diff(np.append(np.flatnonzero(anchor), len(h))))
        heads = new & (texts > 1)
        return pa.concat_tables([said(order[again], REPEATED), said(order[heads & (texts <= HOT)], COMPARE), said(order[heads & (texts > HOT)], CROWDED)])

    return dealt.groupBy("bucket").applyInArrow(meet, _MET)


def anchor_meetings(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Rows of _MET of the runs whose anchor occurs at another place too."""

    def deal(batches):
        held: list[tuple] = []
        size = 0

        def flushed():
            cols = [np.concatenate(x) for x in zip(*held)]
            n = len(cols[0])
            run = dict(zip(("h", "s0", "s1", "u0", "u1", "start", "count", "off"), cols))
            return _dealt(run | {"lo": np.zeros(n, np.uint8), "hi": np.full(n, length - ANCHOR, np.uint8)}, buckets)

        for batch in batches:
            for part in pieces(batch, limit=256 << 10):
                doc, start, count, off, h, s0, s1 = anchored_runs(*text_column(part), length)
                u0, u1 = (np.asarray(part.column(part.schema.get_field_index(c)))[doc] for c in UID)
                held.append((h, s0, s1, u0, u1, start.astype(np.int32), count.astype(np.uint8), off.astype(np.uint8)))
                size += len(h)
                if size >= HELD:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()
        release()

    return _met(docs.select(*UID, "text").mapInArrow(deal, _DEALT))


def refined_meetings(docs: DataFrame, crowded: DataFrame, buckets: int, length: int) -> DataFrame:
    """Rows of _MET of the parts of runs whose anchor has too many texts.

    A string holds its anchor at some offset; strings of different ranges of offsets can't be equal, and all strings of a
    range have, around the anchor, bytes in common that are longer than the anchor: they are the part's new anchor. Runs
    whose new anchor is found once go; ranges are cut into PARTS until an offset is left and the anchor is the whole
    string."""

    def split(batches):
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                cols: dict[str, list] = {c: [] for c in _RUN if c != "dup"}
                rows = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (*UID, "text", "runs")))
                for u0, u1, text, runs in rows:
                    raw = text.encode()
                    for r in runs:
                        width = -(-(r["hi"] - r["lo"] + 1) // PARTS)
                        anchor = r["start"] + r["off"]
                        for a in range(r["lo"], r["hi"] + 1, width):
                            b = min(a + width - 1, r["hi"])
                            k0, k1 = max(r["off"] - b, 0), min(r["off"] - a, r["count"] - 1)
                            if k0 > k1:
                                continue
                            s = r["start"] + k0
                            key = hashlib.blake2b(raw[anchor - a : anchor - b + length], digest_size=8, salt=bytes((a, b))).digest()
                            seg = hashlib.blake2b(raw[s : r["start"] + k1 + length], digest_size=16, salt=bytes((r["off"] - k0, k1 - k0))).digest()
                            new = (int.from_bytes(key, "little"), int.from_bytes(seg[:8], "little"), int.from_bytes(seg[8:], "little"), u0, u1, s, k1 - k0 + 1, r["off"] - k0, a, b)
                            for c, v in zip(cols, new):
                                cols[c].append(v)
                if cols["h"]:
                    yield _dealt({c: np.array(v, _RUN[c]) for c, v in cols.items()}, buckets)
        release()

    runs = crowded.groupBy(*UID).agg(F.collect_list(F.struct("start", "count", "off", "lo", "hi")).alias("runs"))
    rows = picked(docs, crowded.select(*UID).distinct(), "left_semi").join(runs, UID)
    return _met(rows.select(*UID, "text", "runs").mapInArrow(split, _DEALT))


def repeated_runs(docs: DataFrame, met: DataFrame, buckets: int, length: int) -> DataFrame:
    """(u0, u1, a, b) of runs to be compared: their strings of ``length`` bytes that start at a .. b - 1 occur again.

    A bucket holds all different texts of its anchors, at most HOT an anchor. Texts of an anchor are laid end to end and
    sorted as suffixes; a string is repeated if its suffix shares ``length`` bytes with a neighbour."""
    runs = met.groupBy(*UID).agg(F.collect_list(F.struct("start", "count", "key", "lo", "hi")).alias("runs"))

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                u0, u1, at, keys, segs = [], [], [], [], []
                rows = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (*UID, "text", "runs")))
                for x, y, text, found in rows:
                    raw = text.encode()
                    for r in found:
                        u0.append(x)
                        u1.append(y)
                        at.append(r["start"])
                        keys.append(r["key"])
                        segs.append(raw[r["start"] : r["start"] + r["count"] - 1 + length])
                key = np.array(keys, np.int64)
                bucket = (mix64(key.view(np.uint64) ^ np.uint64(0x51)) % np.uint64(buckets)).astype(np.int64)
                yield pa.record_batch({"bucket": pa.array(bucket), "key": pa.array(key), "seg": pa.array(segs, pa.binary()), "u0": pa.array(u0, pa.int64()), "u1": pa.array(u1, pa.int64()), "start": pa.array(at, pa.int64())})
        release()

    def decide(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("key"))
        texts = table.column("seg").to_pylist()
        order = np.argsort(keys, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        rows, begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        block: list[int] = []
        size = 0

        def sort_block():
            t = np.frombuffer(b"".join(texts[i] + bytes([BREAK]) for i in block), np.uint8)
            lens = np.array([len(texts[i]) for i in block])
            begin = np.cumsum(lens + 1) - lens - 1
            valid = np.zeros(len(t) + 1, np.int32)
            np.add.at(valid, begin, 1)
            np.add.at(valid, begin + lens - length + 1, -1)
            again = repeated_starts(t, np.cumsum(valid)[:-1] > 0, length)
            change = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
            at = np.searchsorted(begin, change[::2], side="right") - 1
            rows.append(np.array(block, np.int64)[at])
            begins.append(change[::2] - begin[at])
            ends.append(change[1::2] - begin[at])

        for a, b in zip(edge, np.append(edge[1:], len(order))):
            block += order[a:b].tolist()
            size += sum(len(texts[i]) for i in order[a:b])
            if size >= SORTED:
                sort_block()
                block, size = [], 0
        if block:
            sort_block()
        row = np.concatenate(rows)
        start = np.asarray(table.column("start"))[row]
        release()
        return pa.table({"u0": np.asarray(table.column("u0"))[row], "u1": np.asarray(table.column("u1"))[row], "a": start + np.concatenate(begins), "b": start + np.concatenate(ends)})

    rows = picked(docs, met.select(*UID).distinct(), "left_semi").join(runs, UID)
    segs = rows.select(*UID, "text", "runs").mapInArrow(cut, "bucket long, key long, seg binary, u0 long, u1 long, start long")
    return segs.groupBy("bucket").applyInArrow(decide, "u0 long, u1 long, a long, b long")


def copies(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose whole text another row also has: (u0, u1, n_bytes) of all of them, and the ids of all but one of each."""
    name = F.struct(*UID)
    keys = saved(docs.select(*UID, F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5")).where(F.col("n_bytes") >= length), "suffix-keys")
    several = keys.groupBy("md5", "n_bytes").agg(F.min(name).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    same = saved(keys.join(several, ["md5", "n_bytes"]).select(*UID, "n_bytes", (name != F.col("first")).alias("spare")).distinct(), "suffix-copies")
    forget(keys)
    return same, same.where("spare").select(*UID)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(u0, u1, starts) of the rows of identified() that hold a string which occurs again: where these strings start, as
    intervals (a, b)."""
    if not ANCHOR + 8 <= length <= ANCHOR + 255:
        raise ValueError(f"length must be {ANCHOR + 8} to {ANCHOR + 255} bytes")
    whole, spare = copies(docs, length)
    distinct = picked(docs, spare, "left_anti")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * total // (length - ANCHOR + 2)
    tables = [saved(anchor_meetings(distinct, max(1, -(-expected // BUCKET)), length), "suffix-met")]
    while crowd := tables[-1].where(F.col("state") == CROWDED).count():
        tables.append(saved(refined_meetings(distinct, tables[-1].where(F.col("state") == CROWDED), -(-PARTS * crowd // BUCKET), length), "suffix-met"))
    collect_garbage(docs.sparkSession)
    met = functools.reduce(DataFrame.unionByName, tables)
    compare = met.where(F.col("state") == COMPARE)
    size = compare.agg(F.sum(F.col("count") + length)).first()[0] or 0
    found = repeated_runs(distinct, compare, max(1, -(-size // BLOCK)), length)
    known = met.where(F.col("state") == REPEATED).select(*UID, F.col("start").cast("long").alias("a"), (F.col("start") + F.col("count")).cast("long").alias("b"))
    every = found.unionByName(known).unionByName(whole.select(*UID, F.lit(0).cast("long").alias("a"), (F.col("n_bytes") - length + 1).cast("long").alias("b")))
    out = saved(every.groupBy(*UID).agg(F.collect_set(F.struct("a", "b")).alias("starts")), "suffix-starts")
    forget(whole, *tables)
    return out


def _removals(batch: pa.RecordBatch, column: str, length: int):
    """Of each row the bytes of its text, how many go, in how many maximal runs, and what is left."""
    lists = batch.column(batch.schema.get_field_index(column))
    upto = np.asarray(lists.offsets)
    a, b = (np.asarray(lists.values.field(c)) for c in ("a", "b"))
    for k, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
        raw = (text or "").encode()
        at = slice(upto[k], upto[k + 1])
        cover = np.zeros(len(raw) + 1, np.int32)
        np.add.at(cover, a[at], 1)
        np.add.at(cover, b[at] - 1 + length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        yield raw, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each whole text once every byte is removed that is covered
    by a string of ``length`` bytes which also starts elsewhere in the table.

    Null text: empty. Texts under ``length`` bytes keep all; a text of any size is scanned in stretches of STRETCH bytes.
    Repeated rows are copies of each other; a null doc_id is kept; an empty table gives an empty table; further columns
    are ignored. Equal runs are known by 192 bits of hashes, rows by 128."""
    d = identified(docs)
    starts = repeated(d, length)
    ids = starts.select(*UID)
    some, none = picked(d, ids, "left_semi").join(starts, UID), picked(d, ids, "left_anti")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                rows = [(len(raw), gone, spans, hashlib.sha256(kept).hexdigest()) for raw, gone, spans, kept in _removals(part, "starts", length)]
                size, gone, spans, kept = zip(*rows)
                yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = some.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    rest = none.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    return done.unionByName(rest)


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of docs, ``text`` without the removed bytes (characters cut in two go as a whole); ``n_chars``, if
    there, is counted again. Further columns may have any name; rows are treated as dedup_report() treats them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u0, u1, at = (unused(docs, c) for c in ("u0", "u1", "starts"))
    named = [F.xxhash64(F.col("doc_id").cast("long"), text).alias(u0), F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), text).alias(u1)]
    base = docs.select("*", *named)
    starts = repeated(identified(docs), length).select(F.col("u0").alias(u0), F.col("u1").alias(u1), F.col("starts").alias(at))
    ids = starts.select(u0, u1)
    some = picked(base, ids, "left_semi", [u0, u1]).join(starts, [u0, u1])
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                left = [kept.decode(errors="ignore") for *_, kept in _removals(part, at, length)]
                cols = {n: part.column(part.schema.get_field_index(n)) for n in schema.names} | {"text": pa.array(left, pa.string())}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) for t in left], cols["n_chars"].type)
                yield pa.record_batch(cols)

    done = some.select(*schema.names, at).mapInArrow(run, schema)
    return done.unionByName(picked(base, ids, "left_anti", [u0, u1]).select(*schema.names))

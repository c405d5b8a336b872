"""Embedding near-duplicates: exact cosine links by PCA-ordered tiles with early stopping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, scratch
from .graph import components, local_components

#: Distinct vectors that the rotation is fitted on at most. It only decides how early a comparison stops.
PCA_SAMPLE = 4_096
#: Vectors of a tile, on average; a task compares two tiles.
TILE = 1_536
#: Leading principal coordinates by which vectors are dealt to cells; distinct vectors that the cells are made from at most,
#: the least of them in a cell, and labels that have cells (of the others all vectors are one cell, as hash-dealt tiles).
LEADING, TREE_SAMPLE, LEAF_SAMPLE, CELL_LABELS = 8, 16_384, 8, 4_096
#: Vectors of a side compared at once, which bounds the task's memory.
STRIP = 512
#: Leading dimensions after which the bound is tried.
STOPS = (8, 16, 32)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, greatest variance first."""
    if not len(sample):
        return np.eye(sample.shape[1])
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1].copy()


def linked(a: np.ndarray, b: np.ndarray, a_raw: np.ndarray, b_raw: np.ndarray, threshold: float):
    """Places (i, j) of the pairs of rows with cosine of at least the threshold.

    a and b are unit vectors in principal coordinates. After each stop the product so far plus the product of the
    norms of what is left bounds the cosine; rows and columns without a pair that can reach the threshold drop out,
    and the comparison ends when none is left. Pairs that stay are decided by the raw vectors, in double precision."""
    dims = a.shape[1]
    stops = [s for s in STOPS if s < dims] + [dims]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total, done = np.zeros((len(a), len(b))), 0
    for stop in stops:
        total += a[rows, done:stop] @ b[cols, done:stop].T
        done = stop
        rest = np.sqrt((a[rows, done:] ** 2).sum(1))[:, None] * np.sqrt((b[cols, done:] ** 2).sum(1))[None, :]
        can = total + rest >= threshold - 1e-9
        r, c = can.any(1), can.any(0)
        rows, cols, total, can = rows[r], cols[c], total[np.ix_(r, c)], can[np.ix_(r, c)]
        if not len(rows):
            break
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(can)
    i, j = rows[i], cols[j]
    keep = np.zeros(len(i), bool)
    for begin in range(0, len(i), 1 << 16):
        s = slice(begin, begin + (1 << 16))
        x, y = a_raw[i[s]], b_raw[j[s]]
        cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        keep[s] = cos >= threshold
    return i[keep], j[keep]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between a half and one: cosines stay, and neither
    squares nor products leave the range of a double."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Cells:
    """A label's cells: a tree of cuts through the leading coordinates, made from a sample. Any vector falls into one."""

    def __init__(self, points: np.ndarray, tiles: int):
        self.axis, self.cut, self.left, self.right = [], [], [], []
        self.leaves = 0
        self.root = self._grow(points, tiles)

    def _grow(self, points: np.ndarray, tiles: int) -> int:
        """The number of a new node, cut where the middle half of the points has its widest gap in a coordinate; leaves are
        numbered below zero."""
        n, best = len(points), (0.0, 0, 0.0)
        if tiles >= 2 and n >= 2 * LEAF_SAMPLE:
            begin, end = max(LEAF_SAMPLE, n // 4), min(n - LEAF_SAMPLE, n - n // 4)
            for axis in range(points.shape[1]):
                v = np.sort(points[:, axis])
                gap = v[begin : end + 1] - v[begin - 1 : end]
                k = int(gap.argmax())
                if gap[k] > best[0]:
                    best = (float(gap[k]), axis, float((v[begin - 1 + k] + v[begin + k]) / 2))
        if not best[0]:
            self.leaves += 1
            return -self.leaves
        node, low = len(self.axis), points[:, best[1]] < best[2]
        for x, v in ((self.axis, best[1]), (self.cut, best[2]), (self.left, 0), (self.right, 0)):
            x.append(v)
        self.left[node] = self._grow(points[low], tiles // 2)
        self.right[node] = self._grow(points[~low], tiles - tiles // 2)
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        axis, cut, left, right = (np.array(x or [0]) for x in (self.axis, self.cut, self.left, self.right))
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = np.where(points[inner, axis[n]] < cut[n], left[n], right[n])
        return -at - 1


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """classes with their leading coordinates ``x``, cell and ``rest``, the norm of what the coordinates leave out."""

    def lead(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turn = axes.get(raw.shape[1], np.eye(raw.shape[1]))[:, :LEADING]
        x = scaled(raw)
        x = (x / np.sqrt((x * x).sum(1))[:, None]) @ turn
        x = np.pad(x, ((0, 0), (0, LEADING - x.shape[1])))
        return x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))

    sizes = {(r["label"], r["dims"]): r["n"] for r in classes.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > TILE).limit(CELL_LABELS).collect()}
    points: dict[tuple, list] = {}
    if sizes:  # of labels with several tiles; one beyond CELL_LABELS is a single cell
        big = classes.sparkSession.createDataFrame(list(sizes), "label string, dims int")
        drawn = classes.join(F.broadcast(big), ["label", "dims"]).orderBy(F.xxhash64("key", F.lit(2))).select("label", "dims", "e").limit(TREE_SAMPLE).toArrow()
        labels, dims = drawn.column("label").to_pylist(), np.asarray(drawn.column("dims"))
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x, _ = lead(_vectors(drawn.column("e").take(pa.array(rows))))
            for k, row in enumerate(rows):
                points.setdefault((labels[row], int(d)), []).append(x[k])
    cells = {k: _Cells(np.array(v), -(-sizes[k] // TILE)) for k, v in points.items()}

    def place(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            dims, labels = np.asarray(get("dims")), get("label").to_pylist()
            x, rest, cell = np.zeros((len(dims), LEADING)), np.zeros(len(dims)), np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x[rows], rest[rows] = lead(_vectors(get("e").take(pa.array(rows))))
            for k in set(zip(labels, dims.tolist())) & set(cells):
                rows = np.array([i for i, own in enumerate(zip(labels, dims.tolist())) if own == k])
                cell[rows] = cells[k].of(x[rows])
            yield pa.record_batch({c: get(c) for c in ("label", "dims", "key", "rep", "size", "e")} | {"x": pa.array(list(x), pa.list_(pa.float64())), "rest": pa.array(rest), "cell": pa.array(cell)})

    return classes.select("label", "dims", "key", "rep", "size", "e").mapInArrow(place, "label string, dims int, key string, rep string, size long, e array<double>, x array<double>, rest double, cell long")


def _cell_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """(label, dims, cell, other, tiles): cells with a pair of vectors that may reach the threshold, both ways round, and the
    tiles that the other one has. The product of two unit vectors is at most the sum of the greatest products that the
    cells' bounds allow coordinate by coordinate, and of what is left of both; and at most 1 less half the squared
    distance that the bounds leave between them."""
    box = [g(F.col("x")[k]).alias(f"{n}{k}") for k in range(LEADING) for n, g in (("a", F.min), ("z", F.max))]
    cells = placed.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.max("rest").alias("rest"), F.min("rest").alias("least"), *box)
    cells = saved(cells, "vector-cells")
    other = cells.select("label", "dims", *[F.col(c).alias(f"o_{c}") for c in cells.columns if c not in ("label", "dims")])
    best, zero = F.col("rest") * F.col("o_rest"), F.lit(0.0)
    apart = F.pow(F.greatest(zero, F.col("least") - F.col("o_rest"), F.col("o_least") - F.col("rest")), 2)
    for k in range(LEADING):
        best = best + F.greatest(*[F.col(f"{n}{k}") * F.col(f"o_{m}{k}") for n in "az" for m in "az"])
        apart = apart + F.pow(F.greatest(zero, F.col(f"a{k}") - F.col(f"o_z{k}"), F.col(f"o_a{k}") - F.col(f"z{k}")), 2)
    may = F.least(best, 1 - apart / 2) >= threshold - 1e-9
    j = cells.join(other, ["label", "dims"]).where((F.col("cell") == F.col("o_cell")) | may)
    return j.select("label", "dims", "cell", F.col("o_cell").alias("other"), F.col("tiles").alias("own_tiles"), F.col("o_tiles").alias("other_tiles"))


def _paired(placed: DataFrame, threshold: float) -> DataFrame:
    """Every vector once for each pair of tiles that its tile is in: i and j name the pair, tile the vector's own."""
    allowed = _cell_pairs(placed, threshold)
    own = F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("key"), "own_tiles")
    dealt = placed.join(allowed, ["label", "dims", "cell"]).withColumn("tile", own)
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("other_tiles") - 1), lambda t: F.col("other") * (1 << 24) + t)).alias("o")
    both = dealt.select("label", "dims", "tile", "rep", "size", "e", other)
    return both.select("label", "dims", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "rep", "size", "e")


#: Ids are shifted by this much to be written as digits that sort like numbers.
SHIFT = 2**63


def _class_name(least: Column, key: Column) -> Column:
    """A name of a class of equal vectors that sorts by its smallest id (without one, last); classes that share it differ by key."""
    digits = F.lpad((least.cast("decimal(20,0)") + F.lit(str(SHIFT)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(digits, F.lit("x" * 20)), F.substring(key, 1, 32))


def _least_id(name: Column) -> Column:
    """The id in such a name, null for none."""
    digits = F.substring(name, 1, 20)
    return F.when(~digits.startswith("x"), (digits.cast("decimal(20,0)") - F.lit(str(SHIFT)).cast("decimal(20,0)")).cast("long"))


@scratch
def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links between vectors of a label with cosine of at least the threshold.

    vectors: vec_id, embedding (array of numbers), label. Returns vec_id, n_links (other vectors linked to it
    directly), component_id (smallest vec_id reachable, its own included) and kept (vec_id is component_id).
    Vectors of different lengths, and those that are null, empty, zero or hold null or non-finite components, or whose
    label is null, link with nothing. Equal vectors are compared once and linked with each other. Rows are the vectors: rows
    that share a vec_id are counted and linked each by its own vector. A row without vec_id links like any other; its
    component_id is the smallest id there is in its component, null if there is none, in which case all its rows are kept. An
    empty table gives an empty table; further columns are ignored.

    A label's distinct vectors are dealt to cells by their leading principal coordinates, and a cell by hash to tiles of
    about TILE. Pairs of tiles whose cells' bounds rule out the threshold are never made; each other pair is a task of
    bounded size whose result is a count per vector and a spanning forest of the links found, never the links themselves.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), e.alias("e"))
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("key", F.when(usable, F.sha2(F.encode(F.to_json(F.struct(F.col("label").cast("string").alias("label"), "e")), "UTF-8"), 256)))
    classes = v.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min(F.struct("label", "e")).alias("x"))
    classes = saved(classes.select("key", _class_name(F.col("least"), F.col("key")).alias("rep"), "size", F.col("x.label").cast("string").alias("label"), F.col("x.e").alias("e"), F.size("x.e").alias("dims")), "vector-classes")
    sample = classes.orderBy(F.xxhash64("key")).select("dims", "e").limit(PCA_SAMPLE).toArrow()
    dims = np.asarray(sample.column("dims"))
    axes = {}
    for d in np.unique(dims):
        x = scaled(np.array([r for r, k in zip(sample.column("e").to_pylist(), dims) if k == d]))
        axes[int(d)] = rotation(x / np.sqrt((x * x).sum(1))[:, None])

    placed = saved(_placed(classes, axes, threshold), "vector-tiles")
    pairs = _paired(placed, threshold)

    def compare(table: pa.Table) -> pa.Table:
        d, i, j = (table.column(c)[0].as_py() for c in ("dims", "i", "j"))
        turn = axes.get(d, np.eye(d))
        tile, rep, size = (table.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "rep", "size"))
        raw = scaled(_vectors(table.column("e")))
        unit = raw / np.sqrt((raw * raw).sum(1))[:, None] @ turn
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        n = np.zeros(len(rep), np.int64)
        us, vs = [], []
        for a in range(0, len(left), STRIP):
            x = left[a : a + STRIP]
            root = None
            for b in range(a if i == j else 0, len(right), STRIP):
                y = right[b : b + STRIP]
                p, q = linked(unit[x], unit[y], raw[x], raw[y], threshold)
                p, q = x[p], y[q]
                if i == j:
                    once = p < q if a == b else np.ones(len(p), bool)
                    p, q = p[once], q[once]
                n += np.bincount(p, weights=size[q], minlength=len(n)).astype(np.int64) + np.bincount(q, weights=size[p], minlength=len(n)).astype(np.int64)
                root = local_components(len(rep), p, q)
                lead = np.flatnonzero(root != np.arange(len(rep)))
                us.append(lead)
                vs.append(root[lead])
        u, w = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
        root = local_components(len(rep), u, w)
        seen = (n > 0) | (root != np.arange(len(rep)))
        return pa.table({"rep": pa.array(rep[seen], pa.string()), "n": n[seen], "root": pa.array(rep[root[seen]], pa.string())})

    found = saved(pairs.groupBy("label", "dims", "i", "j").applyInArrow(compare, "rep string, n long, root string"), "vector-links")
    forget(placed)
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = classes.select("key", "rep", "size").join(counted, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), _least_id(F.coalesce("root", "rep")).alias("component_id"))
    out = v.select("vec_id", "key").join(per_class, "key", "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

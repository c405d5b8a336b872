"""A Merkle manifest of a dataset: digests of rows, trees per group, one root, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch
from .order import placed

#: Children of a node; the last one of a level may have fewer.
ARITY = 16
#: Nodes that the fold hands on at a time.
NODES = 2_048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EVENT = "tree string, size long, level int, idx long, digest string"
FOLDED = EVENT + ", kids array<string>"
SIBLINGS = "array<struct<before:string,after:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 of the fields end to end: ``-`` for null, else byte count, ``:``, value."""
    texts = [c.cast("string") for c in columns]
    fields = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def tree_key(group: Column) -> Column:
    """A name for the tree of a group that is never null."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))


def width(size: int, level: int) -> int:
    """Nodes at a level of a tree over ``size`` leaves."""
    return -(-size // ARITY**level)


def _fold(batches):
    """Combine events (a node is done) into parents: a partial parent holds the digests of its children by their index until it
    has as many as the tree's size says, and is then an event itself. Partial parents of the partition's edges go out as their
    children's events, without ``kids``."""
    waiting: dict[tuple, tuple[int, dict[int, str]]] = {}
    out: list[tuple] = []
    schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        for tree, size, level, idx, digest in zip(*[c.to_pylist() for c in batch.columns[:5]]):
            while (nodes := width(size, level)) > 1:
                parent, slot = divmod(idx, ARITY)
                arity = min(ARITY, nodes - parent * ARITY)
                _, kids = waiting.setdefault((tree, level, parent), (size, {}))
                kids[slot] = digest
                if len(kids) < arity:
                    break
                del waiting[tree, level, parent]
                ordered = [kids[k] for k in range(arity)]
                digest, level, idx = hashlib.sha256("".join(ordered).encode()).hexdigest(), level + 1, parent
                out.append((tree, size, level, idx, digest, ordered))
            if len(out) >= NODES:
                yield packed(out)
                out = []
    out += [(tree, size, level, parent * ARITY + slot, digest, None) for (tree, level, parent), (size, kids) in waiting.items() for slot, digest in kids.items()]
    if out:
        yield packed(out)


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, size, level, idx, digest, kids) from the leaves' events (tree, size, level 0, idx, digest).

    Each partition folds what it has: sorted leaves resolve all but the edges of their runs. What is unresolved is dealt by
    parent, at most ARITY events each, and folded again; every round ends at least one level."""
    done: list[DataFrame] = []
    events = leaves
    while True:
        out = saved(events.select("tree", "size", "level", "idx", "digest").mapInArrow(_fold, FOLDED), "merkle")
        done.append(out.where("kids IS NOT NULL"))
        frontier = out.where("kids IS NULL")
        if frontier.isEmpty():
            break
        events = frontier.repartition("tree", "level", F.expr(f"idx div {ARITY}"))
    if len(done) < 3:
        return reduce(DataFrame.unionByName, done)
    return done[0].unionByName(saved(reduce(DataFrame.unionByName, done[1:]), "merkle-top"))


def siblings(kids: str | Column, slot: Column) -> Column:
    """The digests beside the child at ``slot``, joined, before and after it."""
    kids = F.col(kids) if isinstance(kids, str) else kids
    return F.struct(F.array_join(F.slice(kids, F.lit(1), slot), "").alias("before"), F.array_join(F.slice(kids, slot + 2, F.lit(ARITY)), "").alias("after"))


def descend(nodes: DataFrame, tops: DataFrame, depth: int) -> DataFrame:
    """Reverse links: (tree, idx, kids, up, subroot) for each parent of leaves, ``up`` being the siblings met on the way from it
    to the root, bottom first. tops: (tree, level, up, subroot) of each tree's topmost node. A lone leaf has no parent: its tree
    comes with idx 0 and no kids."""
    lone = tops.where("level = 0").select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("kids"), "up", "subroot")
    above = None
    for level in range(depth, 0, -1):
        starts = tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "up", "subroot")
        above = starts if above is None else above.unionByName(starts)
        here = nodes.where(F.col("level") == level).select("tree", "idx", "kids").join(above, ["tree", "idx"])
        if level == 1:
            return here.unionByName(lone)
        slots = here.select("*", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("slot"))
        above = slots.select("tree", (F.col("idx") * ARITY + F.col("slot")).alias("idx"), F.concat(F.array(siblings("kids", F.col("slot"))), F.col("up")).alias("up"), "subroot")
    return lone


@scratch
def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id", group: str = "source", received: dict[str, Column] | None = None) -> DataFrame:
    """A proof for every row: (id, group, leaf, received_leaf, size, idx, subroot, root, siblings, folded_root, verified).

    A row's leaf is the sha256 of ``columns``. Leaves of a group stand by (id, leaf), and each ARITY of them become the sha256
    of their digests until one is left, the subroot; subroots stand by group (null first, then UTF-8 bytes) and become the root
    in the same way. ``siblings`` are the digests beside the row's path, level by level, before and after it. ``received``
    replaces columns as somebody else may hold them: ``folded_root`` is what their leaf and the siblings give, ``verified``
    whether that is the root.

    Null ids come first; repeated rows are leaves of their own, side by side; a null value and an empty text have different
    leaves; texts of any length are read whole; null is a group of its own. Columns besides those named are not covered and not
    returned, whatever their names. An empty table gives no rows.
    """
    had = [F.col(f"`{c}`") for c in columns]
    got = [(received or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaf = leaf_digest(had)
    rows = saved(docs.select(F.col(id_column).alias("id"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), (leaf_digest(got) if received else F.lit(None).cast("string")).alias("other")), "merkle-leaves")
    leaves = saved(placed(rows, ["id", "leaf"], "idx", "size", group="grp").withColumn("tree", tree_key(F.col("grp"))), "merkle-numbered")
    event = leaves.select("tree", "size", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    nodes = grow(event)
    trees = event.where("size = 1").select("tree", "level", "digest").unionByName(nodes.where(F.expr(f"idx = 0 AND size <= power({ARITY}, level)")).select("tree", "level", "digest"))
    groups = leaves.where("idx = 0").select("tree", "grp")
    subroots = saved(placed(trees.join(groups, "tree"), ["grp"], "idx", "size"), "merkle-subroots")
    top_event = subroots.select(F.lit("root").alias("tree"), "size", F.lit(0).alias("level"), "idx", "digest")
    top_nodes = grow(top_event)
    n_trees, depth = subroots.agg(F.max("size"), F.max("level")).first()
    top = next(k for k in range(64) if width(n_trees or 1, k) == 1)
    found = (top_nodes.where(F.col("level") == top) if top else subroots).select("digest").first()
    root = F.lit(found.digest if found else None).cast("string")
    ends = descend(top_nodes, top_event.sparkSession.sql(f"SELECT 'root' AS tree, {top} AS level, CAST(array() AS {SIBLINGS}) AS up, '' AS subroot"), top).withColumnsRenamed({"tree": "_", "idx": "parent"}).select("parent", "kids", "up")
    slot = (F.col("idx") % ARITY).cast("int")
    whole = lambda: F.when(F.col("kids").isNull(), F.col("up")).otherwise(F.concat(F.array(siblings("kids", slot)), F.col("up")))
    tops = subroots.withColumn("parent", F.expr(f"idx div {ARITY}")).join(ends, "parent").select("tree", "level", whole().alias("up"), F.col("digest").alias("subroot"))
    links = descend(nodes, saved(tops, "merkle-tops"), depth or 0).withColumnRenamed("idx", "parent")
    proof = leaves.withColumn("parent", F.expr(f"idx div {ARITY}")).join(links, ["tree", "parent"]).withColumn("siblings", whole())
    folded = F.aggregate("siblings", F.coalesce("other", "leaf"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))
    return proof.select("id", "grp", "leaf", F.coalesce("other", "leaf").alias("received_leaf"), "size", "idx", "subroot", root.alias("root"), "siblings", folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: str = "siblings") -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def tampered_text(id_column: str = "doc_id", text: str = "text", every: int = 5) -> Column:
    """The text in lower case (A-Z only) in rows whose decimal id has a CRC-32 that ``every`` divides; a null id has none."""
    return F.when(F.crc32(F.col(id_column).cast("string").cast("binary")) % every == 0, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))


def report(docs: DataFrame) -> DataFrame:
    """The manifest with proofs as digests, checked against texts tampered with: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified."""
    rows = manifest(docs, received={"text": tampered_text()})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB SQL, where the one row of crc_table_sql() is joined."""
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def crc_table_sql() -> str:
    return """crc_bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM crc_bits WHERE k = 8)"""


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB SQL: trees level by level, then every row climbs its own."""

    def leaf(text):
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name, rows):
        return f"""{name}(tree, level, i, h, n) AS ({rows} UNION ALL SELECT tree, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY tree, level, i // {ARITY}, n)"""

    return f"""
WITH RECURSIVE {crc_table_sql()},
d AS (SELECT row_number() OVER () AS r, *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
  CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM {table}, crc_table),
l AS (SELECT r, doc_id, tree, source, {leaf('text')} AS leaf, {leaf('other')} AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
{tree('t', 'SELECT tree, 0, i, leaf, n FROM p')},
s AS (SELECT t.*, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS trees FROM t JOIN (SELECT DISTINCT tree, source FROM p) USING (tree) WHERE n = 1),
{tree('u', "SELECT '/', 0, place, h, trees FROM s")},
nodes AS (SELECT * FROM t UNION ALL SELECT * FROM u),
beside AS (SELECT a.tree, a.level, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // {ARITY} = b.i // {ARITY} WHERE a.n > 1 GROUP BY 1, 2, 3, 4),
climb(r, tree, level, i, proof, h) AS (
  SELECT r, tree, 0, i, '', changed FROM p
  UNION ALL (
    SELECT r, c.tree, c.level + 1, c.i // {ARITY}, proof || before || after, sha256(before || h || after) FROM climb c JOIN beside b ON b.tree = c.tree AND b.level = c.level AND b.i = c.i
    UNION ALL
    SELECT r, '/', 0, s.place, proof, c.h FROM climb c JOIN s ON s.tree = c.tree AND s.level = c.level)),
ends AS (SELECT r, proof, c.h FROM climb c JOIN u ON c.tree = u.tree AND u.level = c.level AND u.n = 1)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN ends USING (r) JOIN s ON s.tree = p.tree"""

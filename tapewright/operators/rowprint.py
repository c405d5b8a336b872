"""Rows as canonical JSON, made by the engine: fingerprints that equal those of values.fingerprint(), and a hash tree over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import saved, scratch

#: Characters that JSON writes with a letter.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _quoted(text: Column) -> Column:
    """A JSON string in ASCII: other characters by their UTF-16 units."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    short = F.create_map(*[F.lit(x) for c, e in SHORT.items() for x in (f"{ord(c):04X}", e)])

    def unit(i: Column) -> Column:
        h = F.substring(hexed, i * 4 + 1, F.lit(4))
        plain = (h >= "0020") & (h <= "007E")
        return F.coalesce(F.try_element_at(short, h), F.when(plain, F.decode(F.unhex(F.substring(h, 3, 2)), "US-ASCII")), F.concat(F.lit("\\u"), F.lower(h)))

    units = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1), unit)
    simple = ~text.rlike(r'[^ !#-\[\]-~]')
    return F.concat(F.lit('"'), F.when(simple, text).otherwise(F.array_join(units, "")), F.lit('"'))


def _plain(number: Column, kind: T.DecimalType) -> Column:
    """A decimal without an exponent, with all its digits after the point."""
    text = number.cast("string")
    if not kind.scale:
        return text
    digits = F.lpad(F.abs(number * F.lit(10**kind.scale).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string"), kind.scale + 1, "0")
    small = F.concat(F.when(number < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, kind.scale))
    return F.when(F.instr(text, "E") > 0, small).otherwise(text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """values.canonical_json() of a value as an expression: sorted keys, no spaces, ASCII, decimals as text. What has no canonical
    form is refused when the plan is made: floats (give a decimal), times, bytes."""
    if isinstance(kind, T.StringType):
        out = _quoted(value)
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = F.concat(F.lit('"'), _plain(value, kind), F.lit('"'))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: k))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(_quoted(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical form" + (": give a decimal" if isinstance(kind, T.FractionalType) else ""))
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_row(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical JSON of each row as an object of its columns."""
    chosen = sorted(columns or rows.columns)
    fields = [F.concat(_quoted(F.lit(c)), F.lit(":"), canonical(F.col(f"`{c}`"), rows.schema[c].dataType)) for c in chosen]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def fingerprints(rows: DataFrame, columns: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """rows with the sha256 of their canonical JSON."""
    return rows.withColumn(name, F.sha2(canonical_row(rows, columns).cast("binary"), 256))


#: Rows of a leaf of the tree, about.
LEAF = 256


def depth_for(rows: int) -> int:
    """Hexadecimal digits of the keys' hashes by which so many rows are dealt to leaves."""
    depth = 0
    while rows > LEAF * 16**depth:
        depth += 1
    return depth


def _hashed(rows: DataFrame, keys: list[str], columns: list[str] | None) -> DataFrame:
    by = F.sha2(canonical_row(rows, keys).cast("binary"), 256)
    return fingerprints(rows, columns, "_print").select(*keys, by.alias("_by"), "_print")


def hash_tree(rows: DataFrame, keys: list[str], depth: int, columns: list[str] | None = None) -> DataFrame:
    """(prefix, digest): a node for each prefix of up to ``depth`` digits of the keys' hashes that rows have; '' is the root.

    A leaf's digest is that of its rows' fingerprints in text order (equal rows as one, with their number), an inner node's
    that of its children, which are 16 at most."""
    prints = _hashed(rows, keys, columns).groupBy(F.substring("_by", 1, depth).alias("prefix"), "_print").agg(F.count("*").alias("n"))
    entry = F.concat("_print", F.lit(":"), F.col("n").cast("string"))
    level = saved(prints.groupBy("prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n").cast("binary"), 256).alias("digest")), "tree-leaves")
    tree = level
    for d in range(depth, 0, -1):
        child = F.concat("prefix", F.lit(":"), "digest")
        level = level.select(F.substring("prefix", 1, d - 1).alias("up"), child.alias("child")).groupBy("up").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("child")), "\n").cast("binary"), 256).alias("digest")).withColumnRenamed("up", "prefix")
        tree = tree.unionByName(level)
    return tree


@scratch
def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, change): rows that were added, removed or changed, found from the root down: only branches whose digests differ are
    followed, and only rows of leaves that differ are compared. Keys name a row; null keys and repeated rows are counted."""
    depth = depth_for(max(before.count(), after.count()))
    old, new = (saved(hash_tree(x, keys, depth, columns), "tree") for x in (before, after))
    differ = None
    for d in range(depth + 1):
        a, b = (x.where(F.length("prefix") == d) for x in (old, new))
        if differ is not None:
            a, b = (x.join(differ, F.substring("prefix", 1, d - 1) == F.col("up"), "left_semi") for x in (a, b))
        differ = a.join(b.withColumnRenamed("digest", "other"), "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select(F.col("prefix").alias("up"))
    differ = saved(differ, "tree-branches")
    mine = [_hashed(x, keys, columns).join(differ, F.substring("_by", 1, depth) == F.col("up"), "left_semi").groupBy("_by", "_print").agg(F.count("*").alias("n"), *[F.first(k).alias(k) for k in keys]).withColumn("_side", F.lit(s)) for s, x in enumerate((before, after))]
    seen = mine[0].unionByName(mine[1]).groupBy("_by").agg(
        *[F.first(k).alias(k) for k in keys],
        *[F.array_sort(F.collect_list(F.when(F.col("_side") == s, F.concat("_print", F.lit(":"), F.col("n").cast("string"))))).alias(f"_{s}") for s in (0, 1)],
    )
    change = F.when(F.size("_0") == 0, "added").when(F.size("_1") == 0, "removed").otherwise("changed")
    return seen.where(F.col("_0") != F.col("_1")).select(*keys, change.alias("change"))

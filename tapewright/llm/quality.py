"""Quality rules: exact base rules, then robust multivariate outliers per language and source. No Python on executors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, scratch, unused

WS = "[ \\t-\\r]+"
#: Squared distance from which a row is an outlier: of five normal variables one in 1e12 lies beyond (the upper 1e-12
#: quantile of chi-square with five degrees of freedom), so that hardly any clean document goes at any size of a table.
CUTOFF = 65.239
#: The 97.5 % quantile of chi-square with five degrees of freedom: rows within it vary as usual.
NEAR = 12.8325
#: The transformed statistics, and the least spread each is granted (a constant column has none of its own). That of x_rep
#: lets a text that else varies as usual repeat as many words as the base rules allow.
FEATURES = {"x_len": 0.25, "x_word": 0.10, "x_sym": 0.10, "x_dup": 0.10, "x_rep": math.sqrt(0.5 / (CUTOFF - NEAR))}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("t", WS), lambda x: x != "").alias("w"),
        F.char_length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    # windows as (hash, place); equal ones are neighbours once sorted
    d = d.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("tri"),
    )
    some = F.size("tri") > F.size(F.array_distinct("tri"))
    d = d.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.when(some, F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
    )
    d = d.withColumn(
        "at",
        F.when(
            F.col("s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        "s",
                        lambda x, k: F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(F.transform("at", lambda a, k: F.coalesce(F.least(F.lit(3), F.get("at", k + 1) - a), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n).alias("x_len"),
        F.log((F.col("word_chars") + 1) / n).alias("x_word"),
        F.log1p(20 * F.col("n_symbols") / n).alias("x_sym"),
        F.log1p(20 * F.col("n_dup_lines") / n).alias("x_dup"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_rep"),
    ]


def _moments(rows: DataFrame, weight: Column, tag: str) -> list[Column]:
    """Sums for the mean and covariance of the rows with a weight of 1."""
    xs = list(FEATURES)
    pick = lambda c: F.sum(F.when(weight, c))
    out = [F.sum(F.when(weight, 1)).alias(f"{tag}n")] + [pick(F.col(x)).alias(f"{tag}s_{x}") for x in xs]
    return out + [pick(F.col(x) * F.col(y)).alias(f"{tag}q_{x}_{y}") for i, x in enumerate(xs) for y in xs[: i + 1]]


def _whitened(stats: DataFrame, tag: str, factor: float) -> DataFrame:
    """From the sums: centre, inverse of the covariance's Cholesky factor (rows as arrays) and log determinant."""
    xs = list(FEATURES)
    n = F.col(f"{tag}n").cast("double")
    stats = stats.withColumns({f"m_{x}": F.col(f"{tag}s_{x}") / n for x in xs})
    cov = {}
    for i, x in enumerate(xs):
        for j, y in enumerate(xs[: i + 1]):
            c = (F.col(f"{tag}q_{x}_{y}") / n - F.col(f"m_{x}") * F.col(f"m_{y}")) * factor
            cov[f"c{i}{j}"] = F.greatest(c, F.lit(FEATURES[x] ** 2)) if i == j else c
    stats = stats.withColumns(cov)
    for i in range(len(xs)):  # Cholesky, a row at a time
        for j in range(i + 1):
            done = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            stats = stats.withColumn(f"l{i}{j}", F.sqrt(F.greatest(done, F.lit(1e-9))) if i == j else done / F.col(f"l{j}{j}"))
    for j in range(len(xs)):  # its inverse, a column at a time
        for i in range(j, len(xs)):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"v{k}{j}"), range(j, i), F.lit(1.0 if i == j else 0.0))
            stats = stats.withColumn(f"v{i}{j}", rest / F.col(f"l{i}{i}"))
    logdet = reduce(lambda a, i: a + 2 * F.log(F.col(f"l{i}{i}")), range(len(xs)), F.lit(0.0))
    return stats.withColumn("logdet", logdet)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m_ and v_."""
    xs = list(FEATURES)
    z = [reduce(lambda a, j: a + F.col(f"v{i}{j}") * (F.col(xs[j]) - F.col(f"m_{xs[j]}")), range(i + 1), F.lit(0.0)) for i in range(len(xs))]
    return reduce(lambda a, b: a + b, [c * c for c in z])


def _params(stats: DataFrame, keys: list[str]) -> DataFrame:
    xs = range(len(FEATURES))
    return stats.select(*keys, "logdet", *[f"m_{x}" for x in FEATURES], *[f"v{i}{j}" for i in xs for j in range(i + 1)])


#: Groups whose estimates are broadcast at most (a row is under 400 bytes); beyond, joins shuffle and AQE splits.
BROADCAST_GROUPS = 50_000
#: Rows from which a group has an estimate of its own: six for each statistic. Rows of smaller groups are judged by the
#: estimate over the small groups of their language, and if these have fewer together, over all that are left.
LEAST_ROWS = 30
#: Make the covariance of the nearest 75 % and 97.5 % of five normal variables that of all: share / P(chi2_7 <= quantile of
#: chi2_5 at the share).
CONSISTENCY, REWEIGHTED = 1.4121, 1.0555
#: Bins a unit of a statistic, and of the logarithm of a distance, by which quantiles are counted.
BINS, LOG_BINS = 256, 64


def _quantiles(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys and ``q``: the bins at which the shares are reached. counts: keys, bin, n. Counts are exact, so quantiles do not
    depend on how rows are dealt; bins are as fine as BINS and LOG_BINS say."""
    h = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))

    def reached(share: float) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("bin"))

        def step(s, x):
            upto = s["upto"] + x["n"]
            return F.struct(upto.alias("upto"), F.when(s["bin"].isNull() & (upto >= share * F.col("total")), x["bin"]).otherwise(s["bin"]).alias("bin"))

        return F.aggregate("h", zero, step, lambda s: s["bin"])

    return h.select(*keys, F.array(*[reached(x) for x in shares]).alias("q"))


def robust_estimates(rows: DataFrame, few: bool, share: float = 0.75, steps: int = 3) -> DataFrame:
    """Reweighted minimum covariance determinant per group ``g``.

    Of two deterministic starts (rows within the middle spread of every coordinate; all rows), each concentrated ``steps``
    times onto the ``share`` of rows at the least distance, the one with the smaller determinant is taken; the rows whose
    distances it puts within NEAR make the final estimate. Steps aggregate sums and counts of bins only, so a hot
    group is pre-aggregated where its rows lie."""
    xs = list(FEATURES)
    small = F.broadcast if few else (lambda x: x)
    bins = F.posexplode(F.array(*[F.floor(F.col(x) * BINS) for x in xs])).alias("pos", "bin")
    quart = _quantiles(rows.select("g", bins).groupBy("g", "pos", "bin").agg(F.count("*").alias("n")), ["g", "pos"], [0.25, 0.5, 0.75])
    quart = quart.groupBy("g").agg(*[F.max(F.when(F.col("pos") == i, F.transform("q", lambda b: (b + 0.5) / BINS))).alias(f"p_{x}") for i, x in enumerate(xs)])
    z = [F.abs(F.col(x) - F.col(f"p_{x}")[1]) / (F.col(f"p_{x}")[2] - F.col(f"p_{x}")[0] + FEATURES[x]) for x in xs]
    inner = rows.join(small(quart), "g").withColumn("d", F.greatest(*z))
    starts = [inner.groupBy("g").agg(*_moments(inner, F.col("d") <= 1.5, "a")), rows.groupBy("g").agg(*_moments(rows, F.lit(True), "a"))]
    first = starts[0].withColumn("start", F.lit(0)).unionByName(starts[1].withColumn("start", F.lit(1)))
    current, key = saved(_params(_whitened(first, "a", 1.0), ["g", "start"]), "mcd"), ["g", "start"]
    for _ in range(steps):  # of both starts at once
        near = rows.join(small(current), "g").select(*key, *xs, F.floor(F.log(F.greatest(_distance(), F.lit(1e-12))) * LOG_BINS).alias("bin"))
        cut = _quantiles(near.groupBy(*key, "bin").agg(F.count("*").alias("n")), key, [share]).select(*key, F.col("q")[0].alias("cut"))
        near = near.join(small(cut), key)
        after = saved(_params(_whitened(near.groupBy(*key).agg(*_moments(near, F.col("bin") <= F.col("cut"), "a")), "a", 1.0), key), "mcd")
        forget(current)
        current = after
    names = [c for c in current.columns if c not in key]
    best = current.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("x")).select("g", *[F.col(f"x.{c}").alias(c) for c in names])
    near = rows.join(small(best), "g").select("g", *xs, (_distance() / CONSISTENCY <= NEAR).alias("near"))
    return saved(_params(_whitened(near.groupBy("g").agg(*_moments(near, F.col("near"), "a")), "a", REWEIGHTED), ["g"]), "mcd")


def _groups(rows: DataFrame) -> DataFrame:
    """own (l, s) and ``g``, the group whose estimate judges it."""
    sizes = rows.groupBy("own").agg(F.count("*").alias("k"))
    pools = sizes.where(F.col("k") < LEAST_ROWS).groupBy(F.col("own.l").alias("pool")).agg(F.sum("k").alias("pooled"))
    g = F.when(F.col("k") >= LEAST_ROWS, F.to_json("own")).when(F.col("pooled") >= LEAST_ROWS, F.to_json(F.struct(F.col("own.l").alias("l")))).otherwise("*")
    return sizes.join(pools, F.col("own.l") == F.col("pool"), "left").select("own", g.alias("g"))


@scratch
def quality(docs: DataFrame, cutoff: float = CUTOFF, share: float = 0.75) -> DataFrame:
    """A verdict per document: base rules, then outliers among the documents that pass them.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared
    Mahalanobis distance of the transformed statistics under the robust estimate of the document's language and
    source; null where base_failed) and kept (false if base_failed or distance > cutoff).
    Null or empty text: no words, base_failed. Texts of any length are counted whole. Null lang or source: a group of its
    own. Groups of fewer than LEAST_ROWS rows are pooled by language, then all together. Repeated rows are judged alike,
    and ties share a bin. An empty table gives an empty table; further columns of docs are ignored.
    """
    base = saved(with_base(docs), "quality-base")
    rows = base.where(~base_failed()).select(F.struct(F.coalesce("lang", F.lit("∅")).alias("l"), F.coalesce("source", F.lit("∅")).alias("s")).alias("own"), *_features())
    sizes = saved(_groups(rows), "quality-groups")
    few = sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda x: x)
    rows = rows.join(small(sizes), "own").drop("own")
    best = robust_estimates(rows, few, share)
    own = F.struct(F.coalesce("lang", F.lit("∅")).alias("l"), F.coalesce("source", F.lit("∅")).alias("s"))
    judged = base.withColumn("base_failed", base_failed()).withColumn("own", own).select("*", *_features())
    judged = judged.join(small(sizes), "own", "left").join(small(best), "g", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", *BASE, "base_failed", "distance", kept.alias("kept"))


#: Rows that are broadcast to drop documents at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def filter_quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs (all columns, which may have any names) that quality() keeps, each judged by itself."""
    u0, u1 = unused(docs, "u0"), unused(docs, "u1")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "lang", "source", "text")]
    named = docs.select("*", F.xxhash64(*parts).alias(u0), F.xxhash64(F.lit(1), *parts).alias(u1))
    judged = quality(named.select(F.struct(F.col(u0).alias("u0"), F.col(u1).alias("u1")).alias("doc_id"), "lang", "source", "text"), cutoff)
    gone = saved(judged.where("NOT kept").select(F.col("doc_id.u0").alias(u0), F.col("doc_id.u1").alias(u1)).distinct(), "quality-gone")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return named.join(F.broadcast(gone) if small else gone, [u0, u1], "left_anti").select(*docs.columns)

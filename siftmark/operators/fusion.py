"""Uncertainty-gated fusion of a model's posterior with a knowledge posterior.

Joined rows have p0, p1 (model), q0, q1 (knowledge), uncertainty and coarse_label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions import scores as S
from siftmark.functions.scores import bucket
from siftmark.operators import metrics, monotone

#: Slices of uncertainty.
SLICES = (("u_<_0.1", 0.1), ("u_0.1_0.3", 0.3), ("u_≥_0.3", None))


def join_posteriors(pred: DataFrame, know: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key, with posteriors as p0, p1, q0, q1."""
    k = know.select(F.col(key).alias("__k"), F.col("q0")[0].alias("q0"), F.col("q0")[1].alias("q1"))
    return pred.join(k, F.col(key) == F.col("__k")).drop("__k")


def overlap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: distinct keys of either side and of both, in one shuffle."""
    x = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).union(b.select(F.col(key).alias("k"), F.lit(2).alias("s")))
    x = x.groupBy("k").agg(F.max(F.when(F.col("s") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("s") == 2, 1).otherwise(0)).alias("b"))
    return x.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))


def assign_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each row with the bucket that u falls into; 1.0 belongs to the last one, rows of no bucket are left out.

    A range join with a bucket table of a few rows, which is broadcast.
    """
    b = F.broadcast(buckets.select(F.col("bucket_id").alias("bucket_id"), F.col("u_min").alias("__lo"), F.col("u_max").alias("__hi")))
    u = F.col("uncertainty")
    inside = ((F.col("__lo") <= u) & (u < F.col("__hi"))) | ((u == 1.0) & (F.abs(F.col("__hi") - 1.0) < 1e-9))
    return rows.join(b, inside).drop("__lo", "__hi")


def fused(rows: DataFrame, alpha: Column) -> DataFrame:
    """``rows`` with f0, f1 and the fused label; the steps of :func:`siftmark.functions.scores.fuse`, each computed once."""

    def share(a: str, b: str) -> dict[str, Column]:
        s = F.col(a) + F.col(b)
        return {a: F.when(s > 0, F.col(a) / s).otherwise(F.col(a)), b: F.when(s > 0, F.col(b) / s).otherwise(F.col(b))}

    x = rows.withColumns({"__a": alpha, "__p0": F.col("p0"), "__p1": F.col("p1"), "__q0": F.col("q0"), "__q1": F.col("q1")})
    x = x.withColumns(share("__p0", "__p1") | share("__q0", "__q1"))
    a = F.col("__a")
    x = x.withColumns({"f0": a * F.col("__p0") + (1 - a) * F.col("__q0"), "f1": a * F.col("__p1") + (1 - a) * F.col("__q1")})
    x = x.withColumns(share("f0", "f1")).withColumns({f: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f))) for f in ("f0", "f1")})
    return x.withColumns(share("f0", "f1")).withColumn("fused_label", S.argmax2(F.col("f0"), F.col("f1"))).drop("__a", "__p0", "__p1", "__q0", "__q1")


def gated(rows: DataFrame, alpha: Column, threshold: float | None = None, consistency: bool = False) -> Column:
    p0, p1, q0, q1 = (F.col(c) for c in ("p0", "p1", "q0", "q1"))
    if threshold is not None:
        alpha = S.gate_threshold(alpha, q0, q1, threshold)
    return S.gate_consistency(alpha, p0, p1, q0, q1) if consistency else alpha


def alpha_grid_search(rows: DataFrame, by: list[str], grid: tuple[float, ...], metric: str = "f1") -> DataFrame:
    """f1 and nll of every alpha for each value of ``by`` (a long table, with the grid's order as ``pos``).

    Rows meet the grid of a few numbers in one pass; the shuffle carries partial sums.
    """
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(grid)])).alias("g")
    x = fused(rows.filter(F.col("coarse_label").isin(0, 1)).select("*", g).select("*", "g.*").drop("g"), F.col("alpha"))
    y = F.col("coarse_label")
    m = metrics.binary(y, F.col("fused_label"))
    return x.groupBy(*by, "pos", "alpha").agg(m["f1"].alias("f1"), metrics.nll(y, F.col("f1")).alias("nll"))


def best_alpha(searched: DataFrame, by: list[str], metric: str = "f1") -> DataFrame:
    """The first best alpha in grid order for each value of ``by``."""
    pick = F.struct("alpha", "f1", "nll")
    rank = F.struct(F.col("f1"), -F.col("pos")) if metric == "f1" else F.struct(-F.col("nll"), -F.col("pos"))
    out = searched.groupBy(*by).agg(F.max_by(pick, rank).alias("__best"))
    return out.select(*by, F.col("__best.alpha").alias("alpha_star"), F.col("__best.f1").alias("f1_at_alpha_star"), F.col("__best.nll").alias("nll_at_alpha_star"))


def alpha_pivot(searched: DataFrame, by: list[str], grid: tuple[float, ...]) -> DataFrame:
    """alpha_<a>_f1 and alpha_<a>_nll columns; the point of a number becomes an underscore."""
    out = searched.groupBy(*by).pivot("pos", list(range(len(grid)))).agg(F.first("f1").alias("f1"), F.first("nll").alias("nll"))
    names = [F.col(f"`{i}_{m}`").alias(f"alpha_{str(a).replace('.', '_')}_{m}") for i, a in enumerate(grid) for m in ("f1", "nll")]
    return out.select(*by, *names)


def fit_monotone(points: DataFrame, u: str = "u", alpha: str = "alpha", decreasing: bool = True) -> DataFrame:
    """Least-squares monotone fit of any number of points: u, alpha, fitted."""
    return monotone.fit(points, u, alpha, decreasing)


def lut(fitted: DataFrame, points: int = 100) -> DataFrame:
    """``points`` evenly spaced u between the smallest and largest, with alpha interpolated and clipped: pos, u, alpha.

    Points of an equal u count as their mean. Between two places of the table only the first and the last point matter, so
    that many come to the driver, however many were fitted.
    """
    x = fitted.groupBy("u").agg(F.avg("fitted").alias("fitted"))
    spark = fitted.sparkSession
    lo, hi = fitted.agg(F.min("u"), F.max("u")).first()
    if lo is None:
        return spark.createDataFrame([], "pos int, u double, alpha double")
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    places = [hi if k == points - 1 else lo + k * step for k in range(points)]
    cell = F.size(F.filter(F.array(*map(F.lit, places)), lambda p: p <= F.col("u")))
    ends = x.groupBy(cell.alias("cell")).agg(F.min_by(F.struct("u", "fitted"), "u").alias("a"), F.max_by(F.struct("u", "fitted"), "u").alias("b"))
    rows = sorted({(r[k]["u"], r[k]["fitted"]) for r in ends.collect() for k in ("a", "b")})
    x = spark.createDataFrame(list(enumerate(places)), "pos int, u double")
    return x.withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.lut_alpha(F.col("u"), rows))))


def lut_pairs(table: DataFrame) -> list[tuple[float, float]]:
    """A lookup table's pairs for :func:`siftmark.functions.scores.lut_alpha`; it has as many rows as it was built with."""
    return [(r["u"], r["alpha"]) for r in table.orderBy("u").select("u", "alpha").collect()]


def evaluate(rows: DataFrame, alphas: dict[str, Column | None], by: list[str] | None = None) -> DataFrame:
    """Metrics of several methods over the same rows, in one pass: accuracy, precision, recall, f1, nll, ece, n by method.

    A method is an alpha expression; None is the model alone. Methods are rows of one aggregation,
    first by bucket of the probability, for the calibration error.
    """
    by = by or []
    y = F.col("coarse_label")
    options = [F.struct(F.lit(name).alias("method"), (F.lit(None).cast("double") if a is None else a).alias("alpha")) for name, a in alphas.items()]
    x = rows.filter(y.isin(0, 1)).select(*by, y.alias("y"), "p0", "p1", "q0", "q1", F.explode(F.array(*options)).alias("m")).select("*", "m.*").drop("m")
    x = fused(x, F.col("alpha"))
    alone = F.col("alpha").isNull()
    x = x.select(*by, "y", "method", F.when(alone, F.col("p0")).otherwise(F.col("f0")).alias("m0"), F.when(alone, F.col("p1")).otherwise(F.col("f1")).alias("m1"))
    pred = S.argmax2(F.col("m0"), F.col("m1"))
    c = metrics.confusion(F.col("y"), pred)
    loss = F.sum(-F.log(F.greatest(F.least(F.when(F.col("y") == 1, F.col("m1")).otherwise(1 - F.col("m1")), F.lit(1 - metrics.EPS)), F.lit(metrics.EPS))))
    x = x.groupBy(*by, "method", bucket(F.col("m1")).alias("b")).agg(
        *[v.alias(k) for k, v in c.items()], F.count("*").alias("k"), loss.alias("loss"), F.abs(F.sum(F.col("y").cast("double")) - F.sum("m1")).alias("gap")
    )
    tp, fp, fn, tn, n = (F.sum(k) for k in ("tp", "fp", "fn", "tn", "k"))
    return x.groupBy(*by, "method").agg(
        n.alias("n_samples"), metrics.ratio(tp + tn, n).alias("accuracy"), metrics.ratio(tp, tp + fp).alias("precision"), metrics.ratio(tp, tp + fn).alias("recall"),
        metrics.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.sum("loss") / n).alias("nll"), (F.sum("gap") / n).alias("ece"),
    )


def u_slice(u: Column) -> Column:
    return F.when(u < SLICES[0][1], SLICES[0][0]).when(u < SLICES[1][1], SLICES[1][0]).otherwise(SLICES[2][0])


def compare_methods(evaluated: DataFrame, method: str = "emg", against: tuple[str, ...] = ("baseline", "fixed_alpha")) -> DataFrame:
    """Improvements of one method over others: f1 gained, nll and ece reduced, and by how many percent (0 where there is nothing to reduce)."""
    m = evaluated.filter(F.col("method") == method).select(*[F.col(c).alias(f"m_{c}") for c in ("f1", "nll", "ece")])
    b = evaluated.filter(F.col("method").isin(*against)).select(F.col("method").alias("versus"), "f1", "nll", "ece")
    x = b.crossJoin(F.broadcast(m))  # one row

    def percent(gain: Column, base: str) -> Column:
        return F.when(F.col(base) > 0, gain / F.col(base) * 100).otherwise(0.0)

    up, nll, ece = F.col("m_f1") - F.col("f1"), F.col("nll") - F.col("m_nll"), F.col("ece") - F.col("m_ece")
    return x.select(
        "versus", up.alias("f1_improvement"), percent(up, "f1").alias("f1_improvement_pct"), nll.alias("nll_reduction"), percent(nll, "nll").alias("nll_reduction_pct"),
        ece.alias("ece_reduction"), percent(ece, "ece").alias("ece_reduction_pct"),
    )


def threshold_search(rows: DataFrame, alpha: Column, grid: tuple[float, ...]) -> DataFrame:
    """f1 and nll of every knowledge threshold: threshold, pos, f1, nll, in one pass over the rows."""
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)])).alias("g")
    x = rows.filter(F.col("coarse_label").isin(0, 1)).withColumn("__a", alpha).select("*", g).select("*", "g.*").drop("g")
    x = fused(x, F.when(F.greatest("q0", "q1") < F.col("threshold"), 1.0).otherwise(F.col("__a")))
    y = F.col("coarse_label")
    return x.groupBy("pos", "threshold").agg(metrics.binary(y, F.col("fused_label"))["f1"].alias("f1"), metrics.nll(y, F.col("f1")).alias("nll"))


def best_threshold(searched: DataFrame, metric: str = "f1") -> DataFrame:
    """The first best threshold in grid order."""
    rank = F.struct(F.col("f1"), -F.col("pos")) if metric == "f1" else F.struct(-F.col("nll"), -F.col("pos"))
    return searched.agg(F.max_by(F.struct("threshold", "f1", "nll"), rank).alias("b")).select(F.col("b.threshold").alias("best_threshold"), "b.f1", "b.nll")

"""Least squares and grouped cross-validated ridge regression from moments.

The data are read once for sums and cross products, by group; what is solved on the driver is as
large as the number of predictors.  A training fold's moments are the total's less the fold's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetrail.functions.text import sentence_key
from gazetrail.sources import interim

FOLDS = 5


@dataclass
class Moments:
    """n, means, and sums of squares and products about the means, of predictors and then the target."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        n = self.n - other.n
        if n <= 0:
            return Moments(0, np.zeros_like(self.mean), np.zeros_like(self.cross))
        mean = (self.n * self.mean - other.n * other.mean) / n
        between = np.outer(mean - other.mean, mean - other.mean) * (n * other.n / self.n)
        return Moments(n, mean, self.cross - other.cross - between)


def _sums(columns: list[str], about: np.ndarray) -> list:
    c = [F.col(x).cast("double") - F.lit(float(m)) for x, m in zip(columns, about)]
    out = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(c)]
    return out + [F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i in range(len(c)) for j in range(i + 1)]


def _moments(row, k: int, about: np.ndarray) -> Moments:
    n = float(row["n"] or 0)
    if not n:
        return Moments(0, np.zeros(k), np.zeros((k, k)))
    s = np.array([row[f"s{i}"] for i in range(k)])
    p = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            p[i, j] = p[j, i] = row[f"p{i}_{j}"]
    return Moments(n, about + s / n, p - np.outer(s, s) / n)


def _center(df: DataFrame, columns: list[str]) -> np.ndarray:
    got = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return np.array([got[c] or 0.0 for c in columns])


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Of the rows of `df` that have all `columns`."""
    rows = df.select(*columns).dropna("any")
    about = _center(rows, columns)
    return _moments(rows.agg(*_sums(columns, about)).first(), len(columns), about)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + top * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + top / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_pvalue(t: float, df: float) -> float:
    """Two-sided."""
    return float("nan") if not math.isfinite(t) or df <= 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def ols(m: Moments, names: list[str]) -> dict:
    """Fit of the target on the predictors with an intercept; a collinear predictor shares its weight."""
    k = len(names)
    xx, xy, yy = m.cross[:k, :k], m.cross[:k, k], float(m.cross[k, k])
    inv = np.linalg.pinv(xx)
    w = inv @ xy
    rank = int(np.linalg.matrix_rank(xx)) + 1
    rss = max(float(yy - w @ xy), 0.0)
    left = m.n - rank
    r2 = 1 - rss / yy if yy > 0 else float("nan")
    llf = -m.n / 2 * (math.log(2 * math.pi) + math.log(rss / m.n) + 1) if rss > 0 else float("inf")
    intercept = m.mean[k] - w @ m.mean[:k]
    var = rss / left if left > 0 else float("nan")
    se = np.sqrt(np.append(var * (1 / m.n + m.mean[:k] @ inv @ m.mean[:k]), var * np.diag(inv)))
    params = dict(zip(["Intercept", *names], [float(intercept), *map(float, w)]))
    return {
        "n": int(m.n),
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (m.n - 1) / left if left > 0 else float("nan"),
        "aic": -2 * llf + 2 * rank,
        "bic": -2 * llf + rank * math.log(m.n),
        "params": params,
        "pvalues": {p: t_pvalue(float(v / s), left) if s > 0 else float("nan") for (p, v), s in zip(params.items(), se)},
    }


def fit_ols(df: DataFrame, target: str, names: list[str], least: int = 100) -> dict:
    """Ordinary least squares on the complete rows; fewer than `least` are an error."""
    m = moments(df, [*names, target])
    if m.n < least:
        raise ValueError(f"{target} on {names}: only {int(m.n)} complete rows")
    return ols(m, names)


def ridge(m: Moments, alpha: float = 1.0) -> np.ndarray:
    """Intercept and weights on the raw scale: predictors standardised, intercept free of the penalty."""
    k = len(m.mean) - 1
    sd = np.sqrt(np.maximum(np.diag(m.cross)[:k], 0) / max(m.n, 1))
    sd[sd <= 1e-12 * np.maximum(1, np.abs(m.mean[:k]))] = 1.0
    xx, xy = m.cross[:k, :k] / np.outer(sd, sd), m.cross[:k, k] / sd
    w = np.linalg.solve(xx + alpha * np.eye(k), xy) / sd
    return np.append(m.mean[k] - w @ m.mean[:k], w)


def turns(loads: list[int], n: int, m: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How m groups of n rows go to folds of these loads, each to the lightest (the lowest number of equals).

    Fold f takes a group whenever its load is loads[f] + k * n for the next k, so the order is that of all such numbers,
    and of equals that of the folds.  Cut into levels of n rows, a level has one number of each
    fold that is not above it, always in the same order: hence a few stretches, each with a fixed cycle of folds.
    Returns [(first rank, cycle)] and the new loads."""
    start = [load // n for load in loads]
    order = sorted(range(len(loads)), key=lambda f: (loads[f] % n, f))
    levels, loads = sorted(set(start)), list(loads)
    out, at = [], 0
    for level, above in zip(levels, [*levels[1:], None]):
        cycle = [f for f in order if start[f] <= level]
        many = m - at if above is None else min(m - at, (above - level) * len(cycle))
        if many <= 0:
            break
        out.append((at, cycle))
        for k, f in enumerate(cycle):
            loads[f] += n * (many // len(cycle) + (k < many % len(cycle)))
        at += many
    return out, loads


FEW = 100_000  # sizes of groups whose table is broadcast


def group_folds(sizes: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(g, n) -> (g, n, fold): the largest group first, each into the lightest fold (the lowest number of equals);
    of equal groups the greater key comes first.

    Groups of one size differ only by rank, and `turns` says which ranks go where; the driver sees one
    row for each size, of which there are at most the root of twice the number of rows.  Ranks come
    from a range-partitioned sort that is written once, and the counts of its partitions."""
    spark = sizes.sparkSession
    schema = "n long, before long, at array<long>, cycles array<array<int>>"
    loads, rows, before = [0] * folds, [], 0
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect():
        stretches, loads = turns(loads, r["n"], r["m"])
        rows.append((r["n"], before, [at for at, _ in stretches], [cycle for _, cycle in stretches]))
        before += r["m"]
    table = spark.createDataFrame(rows, schema)
    table = F.broadcast(table) if len(rows) <= FEW else table
    order = F.desc("n"), sentence_key(F.col("g")).desc()
    placed = sizes.select("g", F.col("n").cast("long").alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = interim.written(placed.withColumn("_i", F.monotonically_increasing_id()), "group-ranks")
    part, own = F.shiftrightunsigned("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["c"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    starts = [0]
    for p in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(p, 0))
    rank = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), part.cast("int")) + own
    ranked = placed.withColumn("_rank", rank).join(table, "n").withColumn("_rank", F.col("_rank") - F.col("before"))
    # the last stretch that begins at or before the rank
    k = F.size(F.filter("at", lambda x: x <= F.col("_rank"))) - 1
    cycle = F.get("cycles", k)
    fold = F.get(cycle, ((F.col("_rank") - F.get("at", k)) % F.size(cycle)).cast("int"))
    return ranked.select("g", "n", fold.alias("fold"))


PLAIN = {"string", "tinyint", "smallint", "int", "bigint", "date"}  # types of which different values have different texts


def _group(df: DataFrame, name: str) -> Column:
    """What tells groups apart: the column as it is where its text would tell no more and take more room, else its text."""
    return F.col(name) if dict(df.dtypes).get(name) in PLAIN else sentence_key(F.col(name))


@dataclass
class CrossValidation:
    predictions: DataFrame | None  # g, fold, y, prediction
    folds: DataFrame | None  # fold, n, rmse, mae, r2
    pooled: dict  # cv_rmse, cv_mae


NONE = {"cv_rmse": float("nan"), "cv_mae": float("nan")}


class Fits:
    """Several predictor lists for one target, from four readings of the table whatever their number: means, sums and cross
    products, the groups' sizes, and the rows with their folds.  Those are written once and read for the folds' sums and for
    the errors of the folds' models; of a group only its size and its folds are shuffled.

    A list is fitted on the rows that have all its columns.  Lists that miss no row which others have share the sums of
    all columns; the others get sums of their own in the same pass.  Rows without a group count for
    least squares and not for cross-validation."""

    def __init__(self, df: DataFrame, target: str, specs: dict[str, list[str]], group: str, folds: int = FOLDS, alpha: float = 1.0):
        self.target, self.specs, self.n_folds, self.alpha = target, specs, folds, alpha
        self.columns = list(dict.fromkeys([*(c for v in specs.values() for c in v), target]))
        at = {c: i for i, c in enumerate(self.columns)}
        self.where = {name: [at[c] for c in [*v, target]] for name, v in specs.items()}
        self.rows = df.select(_group(df, group).alias("g"), *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(self.columns)))
        every = list(range(len(self.columns)))
        kinds = list({tuple(v): None for v in self.where.values()})
        got = self.rows.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in every), *(F.count(F.when(self._whole(v), 1)).alias(f"n{k}") for k, v in enumerate([every, *kinds]))).first()
        self.about = np.array([got[f"m{i}"] or 0.0 for i in every])
        alone = [v for k, v in enumerate(kinds) if got[f"n{k + 1}"] != got["n0"]]
        self.bases = ([every] if len(alone) < len(kinds) else []) + [list(v) for v in alone]
        self.of = {name: self.bases.index(list(v)) if tuple(v) in set(alone) else 0 for name, v in self.where.items()}
        sums = [x for b, v in enumerate(self.bases) for x in self._sums(b, v)]
        self.total = self.rows.agg(*sums).first()

    def _whole(self, v) -> Column:
        cond = F.lit(True)
        for i in v:
            cond = cond & F.col(f"x{i}").isNotNull()
        return cond

    def _sums(self, b: int, v: list[int]) -> list[Column]:
        ok = self._whole(v)
        c = [F.when(ok, F.col(f"x{i}") - F.lit(float(self.about[i]))) for i in v]
        out = [F.count(F.when(ok, 1)).alias(f"b{b}_n")] + [F.sum(x).alias(f"b{b}_s{i}") for i, x in enumerate(c)]
        return out + [F.sum(c[i] * c[j]).alias(f"b{b}_p{i}_{j}") for i in range(len(c)) for j in range(i + 1)]

    def _moments(self, row, b: int) -> Moments:
        v = self.bases[b]
        names = ["n", *(f"s{i}" for i in range(len(v))), *(f"p{i}_{j}" for i in range(len(v)) for j in range(i + 1))]
        return _moments({k: row[f"b{b}_{k}"] or 0.0 for k in names}, len(v), self.about[v])

    def _own(self, m: Moments, name: str) -> Moments:
        v = self.bases[self.of[name]]
        at = [v.index(i) for i in self.where[name]]
        return Moments(m.n, m.mean[at], m.cross[np.ix_(at, at)])

    def ols(self, name: str, least: int = 100) -> dict:
        """Ordinary least squares on the complete rows; fewer than `least` are an error."""
        m = self._own(self._moments(self.total, self.of[name]), name)
        if m.n < least:
            raise ValueError(f"{self.target} on {self.specs[name]}: only {int(m.n)} complete rows")
        return ols(m, self.specs[name])

    def _fold_models(self) -> dict[str, list[list[float]] | None]:
        """Intercept and weights of each fold's model, for each list; None where there are fewer groups than folds.
        Folds of each basis are columns f0, f1, ... of `self.placed`, the rows with their folds."""
        self.placed, tables = None, {}
        sizes = self.rows.filter("g is not null").groupBy("g").agg(*(F.count(F.when(self._whole(v), 1)).alias(f"b{b}_n") for b, v in enumerate(self.bases)))
        sizes = interim.written(sizes, "group-sizes")
        counts = sizes.agg(*(F.count(F.when(F.col(f"b{b}_n") > 0, 1)).alias(f"b{b}") for b in range(len(self.bases)))).first()
        able = [b for b in range(len(self.bases)) if counts[f"b{b}"] >= self.n_folds]
        fold_of = None
        for b in able:
            own = sizes.filter(F.col(f"b{b}_n") > 0).select("g", F.col(f"b{b}_n").alias("n"))
            fold = group_folds(own, self.n_folds).select("g", F.col("fold").alias(f"f{b}"))
            fold_of = fold if fold_of is None else fold_of.join(fold, "g", "full")
        if fold_of is not None:
            self.placed = interim.written(self.rows.join(fold_of, "g"), "fold-rows")  # rows without a group are in no fold
        for b in able:
            got = self.placed.filter(F.col(f"f{b}").isNotNull()).groupBy(f"f{b}").agg(*self._sums(b, self.bases[b])).collect()
            parts = {r[f"f{b}"]: self._moments(r, b) for r in got}
            whole = self._moments({c: sum(r[c] or 0 for r in got) for c in got[0].asDict() if c != f"f{b}"}, b)
            k = len(self.bases[b])
            none = Moments(0, np.zeros(k), np.zeros((k, k)))
            for name in (x for x, of in self.of.items() if of == b):
                tables[name] = [[float(x) for x in ridge(self._own(whole - parts.get(f, none), name), self.alpha)] for f in range(self.n_folds)]
        return {name: tables.get(name) for name in self.specs}

    def predictions(self) -> tuple[DataFrame | None, dict[str, Column]]:
        """Rows with their folds, and each list's prediction (null for rows that the list is not fitted on)."""
        models = self._fold_models()
        if self.placed is None:
            return None, {}
        out = {}
        for name, table in models.items():
            if table is None:
                continue
            fold = F.col(f"f{self.of[name]}")
            at = lambda i: F.get(F.array(*(F.lit(t[i]) for t in table)), fold.cast("int"))  # noqa: B023, E731
            value = at(0)
            for i, c in enumerate(self.where[name][:-1]):
                value = value + at(i + 1) * F.col(f"x{c}")
            out[name] = F.when(self._whole(self.where[name]) & fold.isNotNull(), value)
        return self.placed, out

    def cross_validated(self) -> dict[str, dict]:
        """Pooled RMSE and MAE of each list."""
        rows, predicted = self.predictions()
        out = {name: dict(NONE) for name in self.specs}
        if rows is None:
            return out
        y = F.col(f"x{self.columns.index(self.target)}")
        sums = []
        for k, value in enumerate(predicted.values()):
            sums += [F.sqrt(F.avg((y - value) * (y - value))).alias(f"rmse{k}"), F.avg(F.abs(y - value)).alias(f"mae{k}")]
        got = rows.agg(*sums).first()
        for k, name in enumerate(predicted):
            out[name] = {"cv_rmse": got[f"rmse{k}"], "cv_mae": got[f"mae{k}"]}
        return out


def cross_validate(df: DataFrame, target: str, names: list[str], group: str = "sentence_id", folds: int = FOLDS, alpha: float = 1.0) -> CrossValidation:
    """Ridge in `folds` grouped folds, pooled and by fold; fewer groups than folds give NaN."""
    fits = Fits(df, target, {"": names}, group, folds, alpha)
    rows, predicted = fits.predictions()
    if rows is None:
        return CrossValidation(None, None, dict(NONE))
    out = rows.select(sentence_key(F.col("g")).alias("g"), F.col("f0").alias("fold"), F.col(f"x{fits.columns.index(target)}").alias("y"), predicted[""].alias("prediction")).dropna("any")
    return CrossValidation(out, fold_metrics(out), pooled_metrics(out))


def pooled_metrics(predictions: DataFrame) -> dict:
    """RMSE and MAE over all rows."""
    e = F.col("y") - F.col("prediction")
    r = predictions.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).first()
    return {"cv_rmse": r["rmse"], "cv_mae": r["mae"]}


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, n, rmse, mae, r2)."""
    e = F.col("y") - F.col("prediction")
    return predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


def mean_std(folds: DataFrame, sample: bool = False) -> DataFrame:
    """Mean and standard deviation over folds of r2, rmse and mae, in one row."""
    std = F.stddev_samp if sample else F.stddev_pop
    return folds.agg(*(f(c).alias(f"{c}_{k}") for c in ("r2", "rmse", "mae") for k, f in (("mean", F.avg), ("std", std))))

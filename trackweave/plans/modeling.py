"""From group features and scores to a sparse linear model.

The feature table has a row per group.  Fits run on the executors, one task
per fold, weight or left-out group; the table travels with them, so it must
stay below ``MOST`` cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regress

MOST = 20_000_000


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its median, over its interquartile range."""
    parts = {"l": 0.25, "m": 0.5, "h": 0.75}
    out = df.crossJoin(F.broadcast(df.agg(*[F.percentile(c, F.lit(p)).alias(f"_{k}_{c}") for c in columns for k, p in parts.items()])))  # one row
    spread = {c: F.col(f"_h_{c}") - F.col(f"_l_{c}") for c in columns}
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(spread[c] == 0, 1.0).otherwise(spread[c]) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def zscored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, over its population standard deviation; null where that is 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).select(*df.columns)


def _matrix(df: DataFrame, key: str, target: str) -> tuple[list, list[str], np.ndarray, np.ndarray]:
    names = [c for c in df.columns if c not in (key, target)]
    if df.count() * len(names) > MOST:
        raise ValueError("the feature table is too large to travel with the tasks")
    pdf = df.toPandas()
    pdf = pdf.iloc[np.argsort(pdf[key].map(lambda s: [int(x) if x.isdigit() else x for x in str(s).split()]).map(str).to_numpy(), kind="stable")]
    return pdf[key].tolist(), names, pdf[names].to_numpy(float), pdf[target].to_numpy(float)


def _scaled_lasso(x, y, alpha, at):
    mid, spread = regress.robust_scaler(x)
    w, b = regress.lasso((x - mid) / spread, y, alpha)
    return w, (at - mid) / spread @ w + b


def grid_search(df: DataFrame, key: str, target: str, alphas: list[float], folds: int) -> DataFrame:
    """(alpha, mse): mean over contiguous folds of the held-out error of a scaled lasso."""
    spark = df.sparkSession
    _, _, x, y = _matrix(df, key, target)
    fold = regress.contiguous_folds(len(y), folds)
    shared = spark.sparkContext.broadcast((x, y, fold))

    def run(batches):
        x, y, fold = shared.value
        for pdf in batches:
            mse = []
            for alpha, k in zip(pdf["alpha"], pdf["fold"]):
                out = fold == k
                _, predicted = _scaled_lasso(x[~out], y[~out], alpha, x[out])
                mse.append(float(((y[out] - predicted) ** 2).mean()))
            yield pdf.assign(mse=mse)

    tasks = spark.createDataFrame([(float(a), k) for a in alphas for k in range(folds)], "alpha double, fold int")
    each = tasks.repartition("alpha", "fold").mapInPandas(run, "alpha double, fold int, mse double")
    return each.groupBy("alpha").agg(F.avg("mse").alias("mse"))


def best_alpha(search: DataFrame) -> float:
    return search.orderBy("mse", "alpha").first()["alpha"]


def lasso_model(df: DataFrame, key: str, target: str, alpha: float) -> DataFrame:
    """(feature, coef) of a scaled lasso on all groups."""
    _, names, x, y = _matrix(df, key, target)
    w, _ = _scaled_lasso(x, y, alpha, x)
    return df.sparkSession.createDataFrame(list(zip(names, w.tolist())), "feature string, coef double")


def leave_one_out(df: DataFrame, key: str, target: str, method: str = "lasso", alphas: list[float] | None = None, rate: float = 1 - 1e-20, leak: bool = False) -> DataFrame:
    """(key, actual, predicted, difference, selected, coefs): each group predicted from the others.

    lasso: the weight is searched among the others.  random_experiments:
    columns are selected, then fitted by least squares on scaled columns;
    leak=True selects on all groups, the left-out one included.
    """
    spark = df.sparkSession
    ids, names, x, y = _matrix(df, key, target)
    shared = spark.sparkContext.broadcast((x, y, names))
    alphas = alphas or np.arange(0.01, 100, 5).tolist()

    def one(i: int):
        x, y, names = shared.value
        rest = np.arange(len(y)) != i
        xt, yt = x[rest], y[rest]
        if method == "lasso":
            fold = regress.contiguous_folds(len(yt), min(13, len(yt)))
            errors = []
            for a in alphas:
                mse = []
                for k in range(fold.max() + 1):
                    out = fold == k
                    mse.append(((yt[out] - _scaled_lasso(xt[~out], yt[~out], a, xt[out])[1]) ** 2).mean())
                errors.append(np.mean(mse))
            w, p = _scaled_lasso(xt, yt, alphas[int(np.argmin(errors))], x[i : i + 1])
            return float(p[0]), [n for n, c in zip(names, w) if abs(c) > 0], [float(c) for c in w if abs(c) > 0]
        chosen = regress.random_experiments(regress.zscore(x if leak else xt), regress.zscore(y if leak else yt), rate)
        mid, spread = regress.robust_scaler(xt)
        w, b = regress.least_squares(((xt - mid) / spread)[:, chosen], yt)
        return float(((x[i] - mid) / spread)[chosen] @ w + b), [n for n, c in zip(names, chosen) if c], w.tolist()

    def run(batches):
        for pdf in batches:
            got = [one(int(i)) for i in pdf["i"]]
            yield pdf.assign(predicted=[g[0] for g in got], selected=[g[1] for g in got], coefs=[g[2] for g in got])[["k", "actual", "predicted", "selected", "coefs"]]

    tasks = spark.createDataFrame([(i, str(k), float(v)) for i, (k, v) in enumerate(zip(ids, y))], "i int, k string, actual double").repartition("i")
    out = tasks.mapInPandas(run, "k string, actual double, predicted double, selected array<string>, coefs array<double>")
    return out.select(F.col("k").alias(key), "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("difference"), "selected", "coefs")


def select_features(df: DataFrame, key: str, target: str, rate: float = 1 - 1e-20) -> list[str]:
    """Columns that terminated random experiments select on all groups."""
    _, names, x, y = _matrix(df, key, target)
    return [n for n, c in zip(names, regress.random_experiments(regress.zscore(x), regress.zscore(y), rate)) if c]


def linear_model(df: DataFrame, key: str, target: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """((feature, coef), (key, actual, predicted)) of least squares on scaled columns."""
    ids, names, x, y = _matrix(df.select(key, target, *features), key, target)
    mid, spread = regress.robust_scaler(x)
    xs = (x - mid) / spread
    w, b = regress.least_squares(xs, y)
    spark = df.sparkSession
    rows = [(str(k), float(a), float(p)) for k, a, p in zip(ids, y, xs @ w + b)]
    return spark.createDataFrame([*zip(names, w.tolist()), ("intercept", b)], "feature string, coef double"), spark.createDataFrame(rows, f"{key} string, actual double, predicted double")


def fit_quality(predictions: DataFrame) -> DataFrame:
    """(r2, mae) of (actual, predicted)."""
    p = predictions.select("actual", "predicted")
    total = F.var_pop("actual") * F.count("*")
    rest = F.sum((F.col("actual") - F.col("predicted")) * (F.col("actual") - F.col("predicted")))
    return p.agg((1 - rest / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))


def selection_frequency(loo: DataFrame) -> DataFrame:
    """How often each feature was selected, least often first."""
    return loo.select(F.explode("selected").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).orderBy("n", "feature")


def with_scores(features: DataFrame, labels: DataFrame, key: str = "squad") -> DataFrame:
    return features.join(labels, key)

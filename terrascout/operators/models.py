"""MLlib models on cell features: fit, ensemble, hold-outs and sweeps (ML1-ML9, T4)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from terrascout.functions.portable import permuted, uniform
from terrascout.operators import rank
from terrascout.operators.features import tabular_features
from terrascout.session import cut, steps


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights that give both classes the same total."""
    row = df.agg(F.count(F.lit(1)), F.sum((F.col(label) == 1).cast("bigint"))).first()
    n, pos = int(row[0]), int(row[1] or 0)
    w_pos, w_neg = n / (2.0 * max(pos, 1)), n / (2.0 * max(n - pos, 1))
    return df.withColumn("weight", F.when(F.col(label) == 1, w_pos).otherwise(w_neg))


def _prepared(df: DataFrame, cols: Sequence[str], label: str, weigh: bool) -> DataFrame:
    out = tabular_features(df, cols, "_raw").withColumn("_label", F.col(label).cast("double"))
    if weigh and "weight" not in out.columns:
        out = balanced(out, label)
    return out


class CellModel:
    """A fitted pipeline that scores a table with the same feature columns."""

    def __init__(self, cols: Sequence[str], pipeline: PipelineModel):
        self.cols, self.pipeline = list(cols), pipeline

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the probability of the positive class (ML7); works on streams too."""
        done = self.pipeline.transform(tabular_features(df, self.cols, "_raw"))
        return (done.withColumn(out, vector_to_array("probability")[1])
                .drop("_raw", "_scaled", "rawPrediction", "probability", "prediction"))


def _fit(df: DataFrame, cols: Sequence[str], label: str, estimator, scale: bool, weigh: bool) -> CellModel:
    stages = []
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
    estimator = estimator.setFeaturesCol("_scaled" if scale else "_raw").setLabelCol("_label")
    return CellModel(cols, Pipeline(stages=[*stages, estimator]).fit(_prepared(df, cols, label, weigh)))


def fit_logreg(df: DataFrame, cols: Sequence[str], label: str = "label", reg: float = 1e-3,
               iterations: int = 100) -> CellModel:
    """Balanced logistic regression on standardised features (ML2)."""
    return _fit(df, cols, label, LogisticRegression(weightCol="weight", regParam=reg, maxIter=iterations,
                                                    standardization=False), True, True)


def fit_forest(df: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 200, depth: int = 10,
               leaf: int = 1, seed: int = 42) -> CellModel:
    """Random forest (ML3)."""
    return _fit(df, cols, label, RandomForestClassifier(
        weightCol="weight", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed), False, True)


def fit_boosted(df: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 200, depth: int = 6,
                rate: float = 0.1, share: float = 0.9, seed: int = 42) -> CellModel:
    """Gradient-boosted trees (ML4)."""
    return _fit(df, cols, label, GBTClassifier(
        weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed), False, True)


def fit_mlp(df: DataFrame, cols: Sequence[str], label: str = "label", hidden: Sequence[int] = (128, 128, 64),
            iterations: int = 100, seed: int = 42) -> CellModel:
    """Perceptron with three hidden layers on standardised features (ML5)."""
    return _fit(df, cols, label, MultilayerPerceptronClassifier(
        layers=[len(cols), *hidden, 2], maxIter=iterations, seed=seed), True, False)


def rule_score(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """One channel taken as the score (ML1)."""
    return df.withColumn(out, F.col(col).cast("double"))


# -------------------------------------------------------------------- ensemble

def poisson_weight(id_col: Column, seed: int) -> Column:
    """Poisson(1) weight of a row in one bootstrap member."""
    u, steps, p, total = uniform(id_col, seed), [], 0.36787944117144233, 0.0
    for count in range(8):
        total += p
        steps.append(total)
        p /= count + 1
    return sum(((u >= s).cast("double") for s in steps), F.lit(0.0))


def fit_ensemble(df: DataFrame, cols: Sequence[str], *, id_col: str = "cell_id", label: str = "label",
                 members: int = 5, seed: int = 42,
                 fit: Callable[..., CellModel] = fit_logreg, parallel: int = 4) -> list[CellModel]:
    """``members`` models, each on its own bootstrap weights (ML6)."""
    base = balanced(df, label).persist(StorageLevel.MEMORY_AND_DISK)

    def one(i: int) -> CellModel:
        boot = base.withColumn("weight", F.col("weight") * poisson_weight(F.col(id_col), seed + i))
        return fit(boot.filter("weight > 0"), cols, label)

    with ThreadPoolExecutor(parallel) as pool:
        models = list(pool.map(one, range(members)))
    base.unpersist()
    return models


def score_with_uncertainty(df: DataFrame, models: Sequence[CellModel], mean: str = "p_mean",
                           std: str = "p_std") -> DataFrame:
    """Mean and population std over the members, in one pass without a shuffle (ML6)."""
    out = df
    for i, model in enumerate(models):
        out = model.score(out, f"_p{i}")
    parts = [F.col(f"_p{i}") for i in range(len(models))]
    m = sum(parts, F.lit(0.0)) / len(parts)
    out = out.withColumn(mean, m)
    var = sum(((p - F.col(mean)) * (p - F.col(mean)) for p in parts), F.lit(0.0)) / len(parts)
    return out.withColumn(std, F.sqrt(var)).drop(*[f"_p{i}" for i in range(len(models))])


# ------------------------------------------------------------ hold-outs, sweeps

_TILE_ROWS = 8192   # rows of a feature matrix
_MODELS = 256        # models whose sums one task forms at a time
_SPLIT = 32          # parts that a block's sums are added up in first


def _matrices(rows: DataFrame) -> DataFrame:
    """(ids, label, x): Arrow batches of (id, label, x) as one row each."""
    kind = dict(rows.dtypes)["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _TILE_ROWS):
                part = batch.slice(start, _TILE_ROWS)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"ids": ids, "label": pa.array([part.column("label").to_numpy().astype(np.int8).tobytes()], pa.binary()),
                                                  "x": pa.array([x.tobytes()], pa.binary())})

    return rows.select("id", "label", "x").mapInArrow(pack, f"ids array<{kind}>, label binary, x binary")


def _class_sums(ids, label: np.ndarray, x: np.ndarray, held, beta: np.ndarray) -> np.ndarray:
    """For each held-out model and class: loss, gradient and upper half of the Hessian over the rows of other ids."""
    ones = np.column_stack([np.ones(len(x)), x])
    i, j = np.triu_indices(ones.shape[1])
    squares = ones[:, i] * ones[:, j]
    out = []
    for c in (0, 1):
        own = label == c
        z = ones[own] @ beta.T
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        keep = np.ones_like(z) if c == 0 else (np.array(ids, object)[own][:, None] != np.array(held, object)).astype(float)
        loss = (np.logaddexp(0.0, -z if c else z) * keep).sum(0)
        out += [loss[:, None], (ones[own].T @ ((p - c) * keep)).T, (squares[own].T @ (p * (1 - p) * keep)).T]
    return np.concatenate(out, axis=1)


def _newton(row: dict, sums: np.ndarray) -> dict:
    """The next coefficients of one model; a step that raised the loss is halved."""
    beta, d = np.array(row["beta"]), len(row["beta"])
    half = 1 + d + d * (d + 1) // 2
    neg, pos = sums[:half], sums[half:]
    total = (neg / (2.0 * max(row["n_neg"], 1)) + pos / (2.0 * max(row["n_pos"], 1)))  # both classes weigh the same
    pen = np.concatenate([[0.0], row["pen"]])
    loss = total[0] + 0.5 * float((pen * beta ** 2).sum())
    if row["loss"] is not None and loss > row["loss"] + 1e-13:
        return row | {"beta": ((np.array(row["good"]) + beta) / 2).tolist()}
    hess = np.zeros((d, d))
    hess[np.triu_indices(d)] = total[1 + d:]
    hess = hess + np.triu(hess, 1).T + np.diag(pen + 1e-12)
    step = np.linalg.solve(hess, total[1:1 + d] + pen * beta)
    return row | {"good": beta.tolist(), "loss": float(loss), "beta": (beta - step).tolist(), "done": bool(np.abs(step).max() < 1e-9)}


def fit_without_each(positives: DataFrame, negatives: DataFrame, cols: Sequence[str], *, id_col: str, reg: float = 1e-3,
                     iterations: int = 100) -> DataFrame:
    """(id, intercept, weights): balanced logistic regressions, each without the positives of one id.

    The models are ``fit_logreg``'s, on raw columns.  Blocks of models meet blocks of rows, and
    loss, gradients and Hessians of all models come from one aggregation a Newton step, so
    the number of jobs does not depend on the number of models.  NULL features count as 0.
    """
    d = len(cols)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])

    def side(df: DataFrame, label: int) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.lit(label).alias("label"), x.alias("x"))

    with steps(positives.sparkSession) as own:
        rows = cut(side(positives, 1).unionByName(side(negatives, 0)))
        totals = rows.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
                          *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(d)],
                          *[F.stddev_pop(F.col("x")[j]).alias(f"s{j}") for j in range(d)]).first()
        n_pos, n_neg = totals["pos"], totals["neg"]
        mean = [totals[f"m{j}"] or 0.0 for j in range(d)]
        scale = [totals[f"s{j}"] or 1.0 for j in range(d)]
        z = F.array(*[(F.col("x")[j] - F.lit(mean[j])) / F.lit(scale[j]) for j in range(d)])
        tables = cut(_matrices(rows.withColumn("x", z)))

        # What the rows of an id change in the scaling of its model.
        flat = rows.filter("label = 1").select("id", z.alias("z"))
        sums = flat.groupBy("id").agg(F.count(F.lit(1)).alias("own"), *[F.sum(F.col("z")[j]).alias(f"a{j}") for j in range(d)],
                                      *[F.sum(F.col("z")[j] * F.col("z")[j]).alias(f"b{j}") for j in range(d)])
        n = F.lit(n_pos + n_neg) - F.col("own")
        square = F.lit(float(n_pos + n_neg))

        def spread(j: int):
            """Sample variance without the id's rows; over all rows the sum is 0 and that of squares the count."""
            flat_column = F.lit(not totals[f"s{j}"])
            var = (square - F.col(f"b{j}") - F.col(f"a{j}") * F.col(f"a{j}") / n) / F.greatest(n - 1, F.lit(1))
            return F.when(flat_column, F.lit(1.0)).otherwise(F.greatest(var, F.lit(1e-12)))

        blocks = max(1, -(-sums.count() // _MODELS))
        state = cut(sums.select(
            "id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), (F.lit(n_pos) - F.col("own")).cast("double").alias("n_pos"),
            F.lit(float(n_neg)).alias("n_neg"), F.array(*[F.lit(reg) * spread(j) for j in range(d)]).alias("pen"),
            F.array(*[F.lit(0.0)] * (d + 1)).alias("beta"), F.lit(None).cast("array<double>").alias("good"),
            F.lit(None).cast("double").alias("loss"), F.lit(False).alias("done")))
        schema = ", ".join(f"{c} {t}" for c, t in state.dtypes)

        def meet(models: DataFrame) -> DataFrame:
            packed = models.groupBy("block").agg(F.collect_list(F.struct("id", "beta")).alias("models"))  # at most about _MODELS
            spread_out = tables.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            return spread_out.join(packed, "block")

        def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    held = [m["id"] for m in row["models"]]
                    table = np.frombuffer(row["x"]).reshape(len(row["ids"]), -1)
                    made = _class_sums(row["ids"], np.frombuffer(row["label"], np.int8), table, held, np.array([m["beta"] for m in row["models"]]))
                    part = zlib.crc32(row["x"][:64]) % _SPLIT
                    yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int32()), "part": pa.array([part], pa.int32()),
                                                      "held": pa.array([held], pa.list_(id_type)), "sums": pa.array([made.tobytes()], pa.binary())})

        id_kind = dict(state.dtypes)["id"]
        id_type = to_arrow_type(state.schema["id"].dataType)
        made = f"block int, part int, held array<{id_kind}>, sums binary"

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            """Sums of a block's models; ``held`` has the same order in all of them but for recomputed tasks."""
            total: dict = {}
            for held, data in zip(frame["held"], frame["sums"]):
                for name, values in zip(list(held), np.frombuffer(data).reshape(len(held), -1)):
                    total[name] = total[name] + values if name in total else values
            return pd.DataFrame([{"block": frame["block"].iloc[0], "part": 0, "held": list(total), "sums": np.stack(list(total.values())).tobytes()}])

        def advance(models: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            whole = add(parts).iloc[0]
            sums_of = dict(zip(list(whole["held"]), np.frombuffer(whole["sums"]).reshape(len(whole["held"]), -1)))
            rows_ = [{k: (None if v is None or (isinstance(v, float) and np.isnan(v)) else v) for k, v in r.items()} for r in models.to_dict("records")]
            return pd.DataFrame([_newton(r, sums_of[r["id"]]) for r in rows_])[list(models.columns)]

        for _ in range(iterations):
            open_ = state.filter("not done")
            if open_.isEmpty():
                break
            parts = meet(open_).mapInArrow(part_sums, made).groupBy("block", "part").applyInPandas(add, made)
            moved = open_.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(advance, schema)
            state = cut(moved.unionByName(state.filter("done")))
        weight = [F.col("beta")[j + 1] / F.lit(scale[j]) for j in range(d)]
        shift = sum((w * F.lit(m) for w, m in zip(weight, mean)), F.lit(0.0))
        return own.keep(state.select(F.col("id").alias(id_col), (F.col("beta")[0] - shift).alias("intercept"), F.array(*weight).alias("weights")))


def leave_one_site_out(positives: DataFrame, negatives: DataFrame, cols: Sequence[str], *, id_col: str, reg: float = 1e-3,
                       iterations: int = 100) -> DataFrame:
    """Hold out each positive, refit, and give its percentile among the negatives (ML8).

    (id, held_out_score, percentile_vs_neg, intercept, weights).  Of several rows with one id the
    best counts.  Negatives within 1e-9 of the held-out log-odds are not below it.
    """
    d = len(cols)

    def odds(weights: str):
        return F.col("intercept") + sum((F.col(weights)[j] * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for j, c in enumerate(cols)), F.lit(0.0))

    with steps(positives.sparkSession) as own:
        fits = cut(fit_without_each(positives, negatives, cols, id_col=id_col, reg=reg, iterations=iterations))
        top = cut(positives.select(id_col, *cols).join(fits, id_col).groupBy(id_col).agg(F.max(odds("weights")).alias("z")).join(fits, id_col))
        block = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-top.count() // _MODELS)))).cast("int")
        blocks = cut(top.withColumn("block", block))
        packed = blocks.groupBy("block").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "z", "intercept", "weights")).alias("models"))
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
        tables = _matrices(negatives.select(F.lit(0).alias("id"), F.lit(0).alias("label"), x.alias("x")))
        every = tables.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-top.count() // _MODELS)) - 1)))).join(packed, "block")
        id_type = to_arrow_type(top.schema[id_col].dataType)

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    z = np.frombuffer(row["x"]).reshape(-1, d) @ np.array([m["weights"] for m in row["models"]]).T + np.array([m["intercept"] for m in row["models"]])
                    mark = np.array([m["z"] for m in row["models"]]) - 1e-9
                    yield pa.RecordBatch.from_pydict({"id": pa.array([m["id"] for m in row["models"]], id_type),
                                                      "below": pa.array((z < mark).sum(0), pa.int64()), "of": pa.array(np.full(len(mark), len(z)), pa.int64())})

        counted = every.mapInArrow(below, f"id {dict(top.dtypes)[id_col]}, below long, of long").groupBy("id") \
            .agg((100.0 * F.sum("below") / F.sum("of")).alias("percentile_vs_neg")).withColumnRenamed("id", id_col)
        return own.keep(top.join(counted, id_col, "left").select(
            id_col, (1.0 / (1.0 + F.exp(-F.col("z")))).alias("held_out_score"), "percentile_vs_neg", "intercept", "weights"))


@dataclass
class LinearModel:
    """Published coefficients on raw columns; scores are log-odds, so that any engine finds the same."""

    cols: Sequence[str]
    weights: Sequence[float]
    intercept: float = 0.0

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        total = F.lit(float(self.intercept))
        for c, w in zip(self.cols, self.weights):
            total = total + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return df.withColumn(out, total)


def permutation_importance(model: CellModel | LinearModel, df: DataFrame, groups: dict[str, Sequence[str]], *, id_col: str,
                           label: str = "label", repeats: int = 3, seed: int = 42) -> DataFrame:
    """Loss of AUROC when one feature group is shuffled across rows (T4).

    Rows are ordered once by a hash of their ids.  A keyed bijection of the ranks names the
    donor of each row in each repeat, so repeats cost a join each and no further order.
    """
    spark = df.sparkSession
    with steps(spark) as own:
        order = df.withColumn("_u", uniform(F.col(id_col), seed))
        ranked = cut(rank.cumulate(order, "_u", id_col).drop("_u", "n"))
        n = ranked.count()
        runs = ranked.withColumns({"feature_group": F.lit(""), "repeat": F.lit(-1)})
        for g, (name, cols) in enumerate(groups.items()):
            for r in range(repeats):
                place = permuted(F.col("rn") - 1, n, seed + 1 + g * repeats + r) + 1
                donor = ranked.select(F.col("rn").alias("_d"), *cols)
                mixed = ranked.drop(*cols).withColumn("_d", place).join(donor, "_d").drop("_d")
                runs = runs.unionByName(mixed.withColumns({"feature_group": F.lit(name), "repeat": F.lit(r)}))
        found = cut(rank.auroc(model.score(runs), "score", label, ["feature_group", "repeat"]))
        base = found.filter("repeat = -1").first()
        drop = F.lit(float(base["auroc"]) if base and base["auroc"] is not None else None) - F.col("auroc")
        return own.keep(found.filter("repeat >= 0").groupBy("feature_group").agg(
            F.avg(drop).alias("drop_mean"), F.stddev_pop(drop).alias("drop_std"), F.count(F.lit(1)).alias("repeats")))


def sweep(df: DataFrame, settings: dict[str, dict], run: Callable[..., DataFrame], parallel: int = 2) -> DataFrame:
    """One metrics row per setting (ML9): ``run(df, **setting)`` returns one row."""
    def one(item: tuple[str, dict]) -> DataFrame:
        name, setting = item
        return run(df, **setting).withColumn("setting", F.lit(name))

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, settings.items()))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out

"""Model jobs around the chunks: batch scoring, a per-step detector, out-of-fold runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.staging import stage

EVENTS = ("onset", "wakeup")
ChunkFn = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _stacked(column: pa.Array) -> np.ndarray:
    """A (nested) list column whose lists are equally long, as one array; its values are not copied."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.flatten()
        size = len(values) // max(len(column), 1)
        if not pc.all(pc.equal(pc.fill_null(pc.list_value_length(column), -1), size)).as_py():
            raise ValueError("chunks must have arrays of one length, without nulls")
        column = values
        shape.append(size)
    return column.to_numpy(zero_copy_only=False).reshape(shape)


def _listed(values: np.ndarray) -> pa.Array:
    """The inverse of :func:`_stacked`."""
    out = pa.array(values.ravel(), pa.float64())
    for axis in range(values.ndim - 1, 0, -1):
        rows = int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * values.shape[axis]), out)
    return out


def score_chunks(chunks: DataFrame, fn: ChunkFn, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` and ``scores [length][events]`` from ``fn(features [chunks, length, n], mask [chunks, length])``.

    ``fn`` travels to the tasks once and is called once for each Arrow batch.  Chunks are independent, so
    nothing is shuffled; they must be equally long.  ``keep`` is by default all but the
    features and targets; the features go to the workers and don't come back.
    """
    keep = list(keep) if keep is not None else [c for c in chunks.columns if c not in ("features", "target")]
    inputs = chunks.select(*dict.fromkeys([*keep, "mask", "features"]))
    scores = T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType())))
    schema = T.StructType([*[chunks.schema[c] for c in keep], scores])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(fn(_stacked(batch.column("features")), _stacked(batch.column("mask"))), dtype=float)
                columns = [*[batch.column(c) for c in keep], _listed(found)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "scores"])

    return inputs.mapInArrow(score, schema)


def logistic_scorer(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> ChunkFn:
    """A scorer with fixed weights: one linear layer and a sigmoid per event."""
    w, b = np.asarray(weights, dtype=float), np.asarray(bias, dtype=float)

    def fn(features: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(features @ w.T + b)))

    return fn


def _fold_sums(rows: DataFrame, features: Sequence[str], weights: dict[tuple[int, str], np.ndarray]) -> list:
    """Loss, gradient and curvature of every model at its weights, from one pass over ``rows``.

    A model ``(fold, event)`` learns from all rows but those of its fold.  Sums are formed where
    the rows are; what comes back is one row per model.
    """
    n = len(features) + 1
    models = F.array(
        *[
            F.struct(F.lit(fold).alias("held"), F.lit(event).alias("event"), F.array(*[F.lit(float(v)) for v in w]).alias("w"))
            for (fold, event), w in weights.items()
        ]
    )
    teaches = F.filter(models, lambda m: F.col("fold").isNull() | (m["held"] != F.col("fold")))
    each = rows.withColumn("m", F.explode(teaches))
    target = F.coalesce(*[F.when(F.col("m.event") == e, F.col(e)) for e in dict.fromkeys(e for _, e in weights)])
    x = [*[F.col(f"`{f}`") for f in features], F.lit(1.0)]
    z = sum((x[i] * F.col("m.w")[i] for i in range(1, n)), x[0] * F.col("m.w")[0])
    each = each.withColumns({"t": target, "z": z}).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    each = each.withColumns({"slope": F.col("t") - F.col("p"), "bend": F.col("p") * (1 - F.col("p"))})
    # log(1 + e^z) - t z, without overflow
    loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("t") * F.col("z")
    sums = [F.sum(loss).alias("loss"), *[F.sum(F.col("slope") * x[i]).alias(f"g{i}") for i in range(n)]]
    sums += [F.sum(F.col("bend") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
    return each.groupBy(F.col("m.held").alias("held"), F.col("m.event").alias("event")).agg(*sums).collect()


def fit_detectors(
    rows: DataFrame,
    features: Sequence[str],
    held_out: Sequence[int] = (-1,),
    events: Sequence[str] = EVENTS,
    rounds: int = 8,
    ridge: float = 1.0,
) -> dict[tuple[int, str], np.ndarray]:
    """Logistic detectors ``(held-out fold, event) -> weights`` (intercept last) by Newton steps.

    ``rows`` have ``fold`` (null: in no fold, so every model learns from them), ``mask``, the
    features and soft targets.  A row with target t counts as a positive of weight t
    and a negative of weight 1 - t; masked rows are left out; nulls are 0.  Minimised is the
    sum of the log losses plus ``ridge`` / 2 times the squared weights, intercept left out.

    All models take a step in each pass over the rows.  ``rounds`` passes evaluate the start
    and the steps; a step that does not lower the loss is halved in the next.  Held out
    fold -1 learns from all rows.  A model without rows keeps weights of 0.
    """
    n = len(features) + 1
    zero = F.lit(0.0)
    columns = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), zero), zero).alias(c) for c in features]
    targets = [F.least(F.coalesce(F.col(e).cast("double"), zero), F.lit(1.0)).alias(e) for e in events]
    rows = stage(rows.where("mask = 1").select(F.col("fold").cast("int").alias("fold"), *columns, *targets), "fit-rows")
    penalty = ridge * np.diag([1.0] * (n - 1) + [0.0])
    tried = {(h, e): np.zeros(n) for h in held_out for e in events}
    best = {key: (np.inf, w, np.zeros(n)) for key, w in tried.items()}
    for _ in range(rounds):
        for r in _fold_sums(rows, features, tried):
            key = r["held"], r["event"]
            w = tried[key]
            loss = r["loss"] + 0.5 * w @ penalty @ w
            if loss <= best[key][0] + 1e-9 * abs(loss):
                curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + penalty
                slope = np.array([r[f"g{i}"] for i in range(n)]) - penalty @ w
                best[key] = loss, w, np.linalg.lstsq(curve, slope, rcond=None)[0]
            else:
                best[key] = *best[key][:2], best[key][2] / 2
            tried[key] = best[key][1] + best[key][2]
    return {key: w for key, (_, w, _) in best.items()}


def detector_weights(spark: SparkSession, models: dict[tuple[int, str], np.ndarray], features: Sequence[str]) -> DataFrame:
    """Fitted weights as rows ``fold, event, feature, weight``; the intercept is a feature of that name."""
    rows = [
        (fold, event, f, float(v))
        for (fold, event), w in models.items()
        for f, v in zip([*features, "intercept"], w, strict=True)
    ]
    return spark.createDataFrame(rows, "fold int, event string, feature string, weight double")


def predict(rows: DataFrame, models: dict[tuple[int, str], np.ndarray], features: Sequence[str]) -> DataFrame:
    """Replace the target columns by the probabilities of the model of the row's ``fold``.

    A row whose fold has no model gets nulls.
    """
    zero = F.lit(0.0)
    x = [F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), zero), zero) for f in features]
    out: dict[str, Column] = {}
    for event in dict.fromkeys(e for _, e in models):
        known = [(fold, w) for (fold, e), w in models.items() if e == event]
        z = F.coalesce(*[F.when(F.col("fold") == fold, sum((c * float(v) for c, v in zip(x, w)), F.lit(float(w[-1])))) for fold, w in known])
        out[event] = 1 / (1 + F.exp(-z))
    return rows.withColumns(out)


def out_of_fold_predictions(
    train_rows: DataFrame,
    valid_rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    n_folds: int = 5,
    events: Sequence[str] = EVENTS,
    **params,
) -> DataFrame:
    """Each row of a fold scored by models that have not seen the fold; all fits share their passes.

    Rows of series in no fold teach every model and are not scored.
    """
    fold = folds.select("series_id", F.col("fold").cast("int").alias("fold"))
    known = train_rows.drop("fold").join(fold, "series_id", "left")
    models = fit_detectors(known, features, range(n_folds), events, **params)
    held_out = valid_rows.drop("fold").where("mask = 1").join(fold.where(F.col("fold").between(0, n_folds - 1)), "series_id")
    return predict(held_out, models, features)

"""User models over columns, spoof scorers trained on features, and the choice of a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.functions.annotation import label
from presentia.operators.evaluation import curve, eer_of, evaluate_at
from presentia.operators.quality import class_weights
from presentia.operators.splits import fingerprint
from presentia.plans.materialize import scratch_path
from presentia.sources.annotations import path_exists, read_run_summary, write_report

PATIENCE, NEAR = 8, 1e-9
RECORD = ("place", "reg", "val_eer", "threshold", "loss")
RECORD_SCHEMA = "place bigint, reg double, val_eer double, threshold double, loss double"


def score_with(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, dim: int, out: str, batch: int = 1024) -> DataFrame:
    """Adds ``out`` from a user model: ``make_predict_fn`` runs once in each worker, batches are matrices of ``dim`` columns."""
    return df.withColumn(out, predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[dim]])(F.col(column)))


def spoof_scores(model: PipelineModel, samples: DataFrame, column: str = "v") -> DataFrame:
    """``samples`` with ``score``, the model's probability of an attack."""
    out = model.transform(samples.withColumn("features", array_to_vector(column)))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def detached(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """``model`` as it is after saving and loading.

    A model that was just fitted keeps its training summary, and with it the session. Scoring ships the model to
    the tasks, which the session must not go along with.
    """
    path = scratch_path(spark, "fitted")
    model.save(path)
    return PipelineModel.load(path)


def fit_scorer(train: DataFrame, val: DataFrame, grid: Sequence[float] = (0.001, 0.01, 0.1), column: str = "v", max_iter: int = 20) -> tuple[PipelineModel, list[dict]]:
    """The logistic model of ``grid`` (regularisation) with the lowest validation EER, and the record of all.

    Classes are weighted; ties go to the lower training loss. The record of the winner comes first, with the
    validation EER threshold that serves from then on.
    """
    weights = class_weights(train)
    data = train.withColumn("label", label(F.col("attack_type"))).join(F.broadcast(weights.select("label", "weight")), "label")
    data = data.withColumns({"features": array_to_vector(column), "label": F.col("label").cast("double")}).select("features", "label", "weight")
    found = []
    for reg in grid:
        fitted = LogisticRegression(weightCol="weight", regParam=reg, maxIter=max_iter).fit(data)
        model = detached(PipelineModel([fitted]), data.sparkSession)
        e = eer_of(curve(spoof_scores(model, val, column))).first()
        found.append(({"reg": reg, "val_eer": e["eer"], "threshold": e["eer_threshold"], "loss": fitted.summary.objectiveHistory[-1]}, model))
    found.sort(key=lambda r: (round(r[0]["val_eer"], 9), r[0]["loss"]))
    return found[0][1], [r for r, _ in found]


@dataclass
class Run:
    """What a training run left: ``model`` is None where only scores were given."""

    model: PipelineModel | None
    threshold: float
    split_by: str
    fingerprint: DataFrame
    history: DataFrame
    validation: DataFrame


def save_run(path: str, model: PipelineModel | None, records: Sequence[dict], split: DataFrame, validation: DataFrame, by: str = "subject", run_id: int = 1) -> None:
    """Writes a run below ``path``: model, history of the grid, fingerprint of the split, report of the chosen model on the validation scores, summary.

    The summary holds the threshold and is written last: a run without it has not ended and does not load. A path
    that has a run already raises.
    """
    spark = split.sparkSession
    if path_exists(spark, f"{path}/summary"):
        raise ValueError(f"{path} has a run already")
    threshold = float(records[0]["threshold"])
    if model is not None:
        model.write().overwrite().save(f"{path}/model")  # what is there is of a run that did not end
    spark.createDataFrame([(k, *(float(r[c]) for c in RECORD[1:])) for k, r in enumerate(records)], RECORD_SCHEMA).write.mode("overwrite").json(f"{path}/history")
    fingerprint(split, by).write.mode("overwrite").parquet(f"{path}/fingerprint")
    report = evaluate_at(validation, threshold).withColumn("threshold_source", F.lit("validation EER"))
    write_report(report, f"{path}/validation", "overwrite")
    summary = spark.createDataFrame([(run_id, threshold, by)], "run_id bigint, threshold double, split_by string")
    write_report(summary, f"{path}/summary")


def load_run(spark: SparkSession, path: str) -> Run:
    """The run saved at ``path``; raises if its summary is missing, corrupt or has no threshold."""
    stored = read_run_summary(spark, f"{path}/summary").collect() if path_exists(spark, f"{path}/summary") else []
    if len(stored) != 1 or not stored[0]["verifiable"]:
        raise ValueError(f"{path} has no run with a stored threshold")
    model = PipelineModel.load(f"{path}/model") if path_exists(spark, f"{path}/model") else None
    return Run(
        model, stored[0]["threshold"], stored[0]["split_by"], spark.read.schema("split_by string, split string, group_key string").parquet(f"{path}/fingerprint"),
        spark.read.schema(RECORD_SCHEMA).json(f"{path}/history"), spark.read.json(f"{path}/validation"),
    )


def select_checkpoint(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """run_id, best_epoch, best_eer, stopped_at: in epoch order, until ``patience`` epochs in a row bring nothing.

    An epoch is better if its EER is lower, or equal within 1e-9 and its loss lower. The epochs of a run stream
    through one task in order; what is held is the best epoch and the misses since.
    """
    run_type = history.schema["run_id"].dataType
    schema = T.StructType([T.StructField("run_id", run_type), T.StructField("best_epoch", T.LongType()), T.StructField("best_eer", T.DoubleType()), T.StructField("stopped_at", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, run, kind = [], None, pa.int64()
        best, eer, loss, misses, last = -1, float("inf"), float("inf"), 0, -1

        def out() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=schema.names)

        for b in batches:
            kind = b.column("run_id").type
            for r, at, e, x in zip(*(b.column(c).to_pylist() for c in ("run_id", "epoch", "eer", "loss")), strict=True):
                if r != run:
                    if last >= 0:
                        done.append((run, best, eer, last))
                    run, best, eer, loss, misses, last = r, -1, float("inf"), float("inf"), 0, -1
                if misses >= patience:
                    continue
                if e < eer - NEAR or abs(e - eer) <= NEAR and x < loss:
                    best, eer, loss, misses = at, e, x, 0
                else:
                    misses += 1
                last = at
            if done:
                yield out()
                done = []
        if last >= 0:
            done.append((run, best, eer, last))
            yield out()

    steps = history.select("run_id", F.col("epoch").cast("long").alias("epoch"), F.col("val_eer").cast("double").alias("eer"), F.col("val_loss").cast("double").alias("loss"))
    return steps.repartition("run_id").sortWithinPartitions("run_id", "epoch").mapInArrow(fold, schema)

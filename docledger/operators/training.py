"""Token datasets, subtoken labels, the frozen-feature probe and checkpoint choice."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.labels import bio_ids

IGNORED = -100


def label_id(label: Column) -> Column:
    pairs = [c for name, i in bio_ids().items() for c in (F.lit(name), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), label)


def token_dataset(pages: DataFrame) -> DataFrame:
    """Pages with label ids per token: masked and ``IGNORE``-marked tokens become -100.

    A page with an unknown label has null ``label_ids``, so that it can be set aside.
    """
    mask = F.coalesce(F.col("ignore_mask"), F.transform("tokens", lambda t: F.lit(False)))
    ids = F.zip_with("labels", mask, lambda label, ignored: F.when(ignored | (label == "IGNORE"), F.lit(IGNORED)).otherwise(label_id(label)))
    return pages.withColumn("_ids", ids).withColumn(
        "label_ids", F.when(F.forall("_ids", lambda i: i.isNotNull()), F.col("_ids"))).drop("_ids")


def align_subtokens(word_ids: Column, word_labels: Column, *, label_all: bool = False) -> Column:
    """Label ids per subtoken: special tokens and later pieces are -100; null when an index is out of range."""
    def piece(word: Column, i: Column) -> Column:
        label = F.get(word_labels, word)
        first = (i == 0) | ~word.eqNullSafe(F.get(word_ids, i - 1))
        return F.when(word.isNull(), F.lit(IGNORED)).when(first | F.lit(label_all), label).otherwise(F.lit(IGNORED))

    sound = F.forall(word_ids, lambda w: w.isNull() | ((w >= 0) & (w < F.size(word_labels))))
    return F.when(sound, F.transform(word_ids, piece))


def best_checkpoint(candidates: DataFrame, *, greater_is_better: bool = True) -> tuple[DataFrame, DataFrame]:
    """(best validation candidate per run, refused candidates); ties go to the earliest epoch."""
    valid = candidates.where("evaluated_split = 'validation'")
    refused = candidates.where("evaluated_split <> 'validation'")
    row = F.struct(*valid.columns)
    if greater_is_better:
        best = F.max_by(row, F.struct("metric_value", -F.col("epoch")))
    else:
        best = F.min_by(row, F.struct("metric_value", "epoch"))
    return valid.groupBy("run_id").agg(best.alias("_best")).select("_best.*"), refused


def linear_probe(features: DataFrame, *, grid: tuple[float, ...] = (0.0, 0.01), max_iter: int = 30):
    """Fit a linear head on frozen features: train split fits, validation selects, test is reported once.

    ``features`` has embedding (array), label (int) and split. Returns (model, report).
    """
    vectors = features.select("vec_id", "split", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    train, validation, test = (vectors.where(F.col("split") == s) for s in ("train", "validation", "test"))
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    scored = []
    for strength in grid:
        model = Pipeline(stages=[LogisticRegression(regParam=strength, maxIter=max_iter, family="multinomial")]).fit(train)
        scored.append((judge.evaluate(model.transform(validation)), -strength, model))
    best = max(scored, key=lambda s: s[:2])
    report = features.sparkSession.createDataFrame(
        [(float(-best[1]), float(best[0]), float(judge.evaluate(best[2].transform(test))), len(grid))],
        "reg_param double, validation_accuracy double, test_accuracy double, candidates int")
    vectors.unpersist()
    return best[2], report


def probe_head(model: PipelineModel) -> tuple[np.ndarray, np.ndarray]:
    """(weights by class and dimension, one bias per class) of a fitted probe."""
    fitted = model.stages[-1]
    return fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()

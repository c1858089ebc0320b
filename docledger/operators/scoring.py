"""Batch scoring of rows by a user model, and the native step that turns scores into labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Loader = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def score_table(df: DataFrame, load: Loader, schema: StructType | str, *, model_name: str, model_revision: str) -> DataFrame:
    """Apply a model batch by batch; it is loaded once per task and results carry its identity.

    ``load`` returns a function from an input batch to an output batch with ``schema``'s columns.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema).withColumn("model_name", F.lit(model_name)).withColumn("model_revision", F.lit(model_revision))


def linear_head(spark: SparkSession, weights: np.ndarray, bias: np.ndarray, *, vector: str = "embedding") -> Loader:
    """A linear head as a model for :func:`score_table`: ``vector`` gives way to ``logits``, one per class.

    The head is as large as classes times dimensions and reaches every executor once. A vector that is
    null, of another length, or holds anything but finite numbers has null logits.
    """
    shared = spark.sparkContext.broadcast((np.asarray(weights, float), np.asarray(bias, float)))

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        matrix, offset = shared.value
        width = matrix.shape[1]

        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            rows = [None if v is None or len(v) != width else np.asarray(v, float) for v in batch[vector]]
            sound = np.array([row is not None and bool(np.isfinite(row).all()) for row in rows], bool)
            logits: list = [None] * len(rows)
            if sound.any():
                scores = np.stack([row for row, good in zip(rows, sound) if good]) @ matrix.T + offset
                for at, score in zip(np.flatnonzero(sound), scores):
                    logits[at] = score.tolist()
            return batch.drop(columns=vector).assign(logits=logits)

        return predict

    return load


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def label_entities(scores: DataFrame, names: list[str]) -> DataFrame:
    """Subtoken logits to entities: best label, ``O`` dropped, first subtoken of a region wins."""
    probabilities = softmax(F.col("logits"))
    best = F.array_max(probabilities)
    first = Window.partitionBy("document_id", "page_index", "region_id").orderBy("subtoken")
    heads = scores.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    named = heads.withColumn("_p", probabilities).withColumn("confidence", F.array_max("_p")).withColumn(
        "label", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("_p", F.col("confidence")).cast("int")))
    return named.where("label <> 'O'").drop("_r", "_p", "logits")

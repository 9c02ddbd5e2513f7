"""Batch scoring with a caller's model (I1): arrays in, score vectors out, the model built
once per Python worker and fed Arrow batches by ``predict_batch_udf``."""

from __future__ import annotations

from collections.abc import Callable

import sys

from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusmill.functions.scores import target_logprob


def score_batches(df: DataFrame, make_predict_fn: Callable, inputs: str, width: int,
                  batch_size: int = 256, out: str = "logits") -> DataFrame:
    """Adds ``out``: the model's score vector for ``inputs`` (a fixed-width numeric array)."""
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[width]])
    return df.withColumn(out, udf(F.col(inputs)))


def linear_weight(i, o):
    """The linear layer's weight from input ``i`` to score ``o``: a fixed pattern in [-1, 1] by
    eighths, so that any engine computes the same layer."""
    return ((7 * i + 3 * o + i * o) % 17 - 8) / 8


def linear_model(width: int, outputs: int) -> Callable:
    """A linear layer of ``width`` inputs and ``outputs`` scores, built once per worker."""
    def make():
        import numpy as np

        weights = linear_weight(np.arange(width)[:, None], np.arange(outputs)[None, :])

        def predict(x):
            return (x.astype(np.float64) @ weights).astype(np.float32)
        return predict
    return make


def nll_of_scores(df: DataFrame, logits: str, target: str) -> DataFrame:
    """F4+F5 on model output: ``nll = -log_softmax(logits)[target]``."""
    return df.withColumn("nll", -target_logprob(logits, target))


# Python workers need not have this package installed: functions of this module travel
# by value with the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

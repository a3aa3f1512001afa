"""Batch inference with a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predict = Callable[[np.ndarray], np.ndarray]


def batch_infer(
    tiles: DataFrame,
    make_predict: Callable[[], Predict],
    inputs: str,
    shape: tuple[int, ...],
    out: str = "feat",
    batch_size: int = 4096,
    element: T.DataType | None = None,
) -> DataFrame:
    """Add the model's vector per row.

    ``make_predict`` runs once per Python worker and loads the model there; rows
    stream through it in Arrow batches of ``batch_size``.
    """
    model = predict_batch_udf(
        make_predict, return_type=T.ArrayType(element or T.FloatType()), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    return tiles.withColumn(out, model(F.col(inputs)))

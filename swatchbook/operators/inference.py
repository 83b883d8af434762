"""Applying a user's model to a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField

from swatchbook.operators.rejects import map_with_rejects


def embed_table(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str,
    size: int,
    out: str,
    batch_size: int = 1024,
) -> DataFrame:
    """Add ``out``, the model's vector for the flat input ``column`` of ``size`` values.

    ``make_predict`` loads the model; it runs once per Python worker and
    returns a function of a two-dimensional batch.
    """
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]]
    )
    return df.withColumn(out, predict(column))


def embed_with_rejects(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str,
    size: int,
    out: str,
    carry: list[str],
) -> DataFrame:
    """Like :func:`embed_table`, with ``error`` for the rows that the model refuses; only ``carry`` is kept beside ``out``.

    A batch on which the model or the stacking of its inputs fails with a
    data error is halved until the rows at fault are alone, so the others
    still go through the model in batches. A null input is refused with its
    reason. Works on batch and on streaming tables.
    """
    loaded: list = []

    def vectors(block: pd.DataFrame) -> pd.Series:
        if not loaded:
            # One model per worker.
            loaded.append(make_predict())
        if block[column].isna().any():
            raise ValueError("no input")
        inputs = np.stack(block[column].to_numpy())
        if inputs.shape[1] != size:
            raise ValueError(f"{inputs.shape[1]} values, not {size}")
        return pd.Series(list(np.asarray(loaded[0](inputs), dtype=np.float32)))

    return map_with_rejects(df, vectors, StructField(out, ArrayType(FloatType())), carry)


def project(df: DataFrame, column: str, weights: np.ndarray, out: str) -> DataFrame:
    """Add ``out``, the product of a row vector and a broadcast matrix.

    The matrix is a model parameter, so its size does not depend on the data.
    A null vector, or one of another length, has a null product.
    """
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    size = len(shared.value)

    @F.pandas_udf(ArrayType(DoubleType()))
    def multiply(vectors: pd.Series) -> pd.Series:
        fit = vectors.map(lambda v: v is not None and len(v) == size)
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        if fit.any():
            product = np.stack(vectors[fit].to_numpy()).astype(np.float64) @ shared.value
            out[fit] = pd.Series(list(product), index=vectors.index[fit], dtype=object)
        return out

    return df.withColumn(out, multiply(column))

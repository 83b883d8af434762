"""Tensors in a cell: NPY bytes and native arrays."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType

_ELEMENT = {"float32": FloatType(), "float64": DoubleType(), "int32": IntegerType(), "int64": LongType()}


def npy_header(shape: Sequence[int], dtype: str) -> bytes:
    """The bytes in front of the data of an NPY cell of this shape and type."""
    out = io.BytesIO()
    header = {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": tuple(shape)}
    np.lib.format.write_array_header_1_0(out, header)
    return out.getvalue()


def npy_encode(values: Column, shape: Sequence[int], dtype: str = "float32") -> Column:
    """Flat array column to NPY bytes. A null stays null; a wrong size raises."""
    header, size = npy_header(shape, dtype), int(np.prod(shape))

    @F.pandas_udf("binary")
    def encode(cells: pd.Series) -> pd.Series:
        def cell(v):
            if v is None:
                return None
            if len(v) != size:
                raise ValueError(f"{len(v)} values do not fill shape {tuple(shape)}")
            return header + np.ascontiguousarray(v, dtype=dtype).tobytes()

        return cells.map(cell)

    return encode(values)


def npy_decode(cells: Column, dtype: str = "float32") -> Column:
    """NPY bytes to a flat array column in row-major order; null stays null."""

    @F.pandas_udf(ArrayType(_ELEMENT[dtype]))
    def decode(column: pd.Series) -> pd.Series:
        def cell(raw):
            if raw is None:
                return None
            return np.load(io.BytesIO(raw), allow_pickle=False).astype(dtype, copy=False).ravel()

        return column.map(cell)

    return decode(cells)


def npy_shape(cells: Column) -> Column:
    """Shape recorded in the header of NPY bytes."""

    @F.pandas_udf("array<int>")
    def shape(column: pd.Series) -> pd.Series:
        def cell(raw):
            if raw is None:
                return None
            return list(np.load(io.BytesIO(raw), allow_pickle=False).shape)

        return column.map(cell)

    return shape(cells)

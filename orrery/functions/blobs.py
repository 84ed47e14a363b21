"""Vectors as binary: little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blob: pd.Series) -> pd.Series:
    """Floats of a blob; one to three bytes at the end are left out, null stays null."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))


@F.pandas_udf(T.BinaryType())
def encode(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

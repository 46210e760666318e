"""The normal distribution: Spark has neither its integral nor its inverse."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ERFC = np.vectorize(math.erfc, otypes=[float])


def z_threshold(alpha: float) -> float:
    """|z| from which a two-sided test at alpha is significant."""
    return abs(NormalDist().inv_cdf(alpha / 2))


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(_ERFC(np.abs(z.to_numpy(dtype=float)) / math.sqrt(2.0)))


def two_sided_p(z: Column) -> Column:
    """p of |z| under the normal distribution, by an Arrow function."""
    return _two_sided(z.cast("double"))

"""Division and logarithm as IEEE 754 and the SQL twins have them: infinite or NaN where Spark raises or gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y; over 0 an infinity of x's sign, and NaN for 0 / 0. Null only where x or y is."""
    return F.when(y == 0, x * F.lit(math.inf)).otherwise(x / y)


def ln(x: Column) -> Column:
    """Minus infinity of 0, NaN below."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))

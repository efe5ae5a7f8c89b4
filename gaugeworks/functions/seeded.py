"""Choices that must repeat a seeded generator exactly: the only row functions in Python."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BooleanType())
def coin(key: pd.Series) -> pd.Series:
    """Whether the first number drawn with this seed exceeds one half; a null key is the empty one
    (without a seed the generator would take one from the system)."""
    return key.map(lambda k: random.Random(k or "").random() > 0.5)


def seeded_choice(options: list[str]):
    """A function of a key column: the first choice drawn with this seed among the sorted options."""
    ordered = sorted(options)

    @F.pandas_udf(T.StringType())
    def choose(key: pd.Series) -> pd.Series:
        return key.map(lambda k: random.Random(k or "").choice(ordered))

    return choose

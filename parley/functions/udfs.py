"""The few functions that Spark has no built-in for, as Arrow UDFs, and the boundary to a model."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """Unicode compatibility form, case folded, white space collapsed; null stays null."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts in this order, junk heuristic included; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_from(least: float) -> Callable[[Column, Column], Column]:
    """As sequence_ratio where the ratio is ``least`` or more; below it, anything below it: bounds by length and letters spare the alignment."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        m = difflib.SequenceMatcher(None, x, y)
        for bound in (m.real_quick_ratio, m.quick_ratio):
            if (r := bound()) < least:
                return r
        return m.ratio()

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def model(build: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function ``struct<value, error>`` from a model that ``build`` makes once per Python worker.

    A row whose call fails has a null value and the error's text; null prompts are not sent.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = build()
        for s in batches:
            out = []
            for x in s:
                try:
                    out.append((None if x is None else predict(x), None))
                except Exception as e:  # any failure of a row is that row's result
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["value", "error"], dtype="object")

    return run

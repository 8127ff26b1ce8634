"""Wide and long tables: standard columns, band columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard broadband columns.
STANDARD = ["LAF90", "LAF10", "LAFmax", "LAeq"]
BAND = re.compile(r"^(L\w*?)_(\d+(?:\.\d+)?)$")


def selected(df: DataFrame, want: list[str], keys: list[str]) -> DataFrame:
    """Keys and those of the wanted columns that the table has."""
    return df.select(*keys, *[f"`{c}`" for c in want if c in df.columns and c not in keys])


def standardised(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, standard columns, and bands ordered by level name and frequency; all columns where none of these is there."""
    bands = sorted((c for c in df.columns if BAND.match(c)), key=lambda c: (BAND.match(c)[1], float(BAND.match(c)[2])))
    keep = [c for c in STANDARD if c in df.columns] + bands
    return selected(df, keep or df.columns, keys)


def spectral_params(df: DataFrame) -> list[str]:
    """Names of levels that have band columns."""
    return sorted({m[1] for c in df.columns if (m := BAND.match(c))})


def unpivot_bands(df: DataFrame, keys: list[str], low: float = 20, high: float = 20_000) -> DataFrame:
    """keys, param, freq_hz, level of the band columns between low and high; missing levels go."""
    cols = [c for c in df.columns if (m := BAND.match(c)) and low <= float(m[2]) <= high]
    long = df.unpivot(keys, [f"`{c}`" for c in cols], "column", "level")
    name: Column = F.regexp_replace("column", "`", "")
    return long.select(*keys, F.regexp_extract(name, BAND.pattern, 1).alias("param"), F.regexp_extract(name, BAND.pattern, 2).cast("double").alias("freq_hz"), "level").where("level is not null")

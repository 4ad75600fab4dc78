"""Text and number formatting as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters that a file name may not have, units of sizes, and the form of a duration.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]
DURATION = "%d hour(s) %d minute(s) %d second(s)"


def fix_name(text: Column) -> Column:
    """Runs of other than ASCII letters and digits become one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(F.trim(text), "[^0-9a-zA-Z]+", "_"), F.lit("_"))


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form is dropped. Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def sanitize(text: Column, replacement: str = "_", most: int = 255) -> Column:
    """A safe file name from ASCII text (see fold_accents): characters that file systems refuse and control characters
    are replaced, runs of the replacement become one, spaces and dots at the ends go, and the name is cut."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    safe = F.regexp_replace(ascii_only, FORBIDDEN, replacement)
    return F.left(F.btrim(F.regexp_replace(safe, f"{replacement}+", replacement), F.lit(" .")), F.lit(most))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def size_label(num: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    *small, largest = UNITS
    found: Column = F.format_string(f"%.1f{largest}", num / float(1024 ** len(small)))
    for i in range(len(small) - 1, -1, -1):
        found = F.when(F.abs(num) < float(1024 ** (i + 1)), F.format_string(f"%.1f{small[i]}", num / float(1024**i))).otherwise(found)
    return found


def duration_label(seconds: Column) -> Column:
    """Hours, minutes and seconds within a day."""
    s = F.pmod(F.floor(seconds).cast("long"), F.lit(86400))
    return F.format_string(DURATION, F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))

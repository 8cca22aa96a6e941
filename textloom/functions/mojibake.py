"""UTF-8 that was read as Windows-1252, repaired in place (STR-7, SNK-4)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _octet(octet: int) -> str:
    try:
        return bytes([octet]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(octet)


_OCTETS = {_octet(o): o for o in range(0x80, 0x100)}
_TAIL = "[" + re.escape("".join(c for c, o in _OCTETS.items() if o < 0xC0)) + "]"
_SEQUENCE = re.compile("|".join(f"[{re.escape(''.join(c for c, o in _OCTETS.items() if low <= o < high))}]{_TAIL}{{{n}}}" for low, high, n in ((0xF0, 0xF5, 3), (0xE0, 0xF0, 2), (0xC2, 0xE0, 1))))


def _decoded(match: re.Match) -> str:
    try:
        return bytes(_OCTETS[c] for c in match.group()).decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


def repaired(text: str | None) -> str | None:
    """A text with every sequence that is UTF-8 read as Windows-1252 put right; other text, and lost letters, stay."""
    return text if text is None else _SEQUENCE.sub(_decoded, text)


def repair(column: Column) -> Column:
    """``repaired`` on a column, in Arrow batches; texts without a first character of a sequence stay in the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired, na_action="ignore")

    suspect = F.coalesce(column.rlike(r"[\x{C2}-\x{F4}][^\x00-\x7F]"), F.lit(False))
    return F.when(suspect, run(F.when(suspect, column))).otherwise(column)


def repair_file(spark: SparkSession, source: str, target: str) -> None:
    """A text file, or a folder of such, written again with its lines repaired."""
    spark.read.text(source).select(repair(F.col("value")).alias("value")).write.mode("overwrite").text(target)

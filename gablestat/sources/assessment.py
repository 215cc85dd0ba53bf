"""Reading a roll, repairing its header, and lining snapshots up."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestat.functions import levels
from gablestat.functions.columns import blank_to_null


def read_assessment(
    spark: SparkSession, path: str, schema: T.StructType | None = None, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Delimited file with a header. Every column stays text: no inference pass over the data.

    ``schema`` fixes the columns; ``types`` casts chosen ones after the scan.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path)
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items()})


def write_assessment(df: DataFrame, path: str) -> str:
    """Text snapshot with a header, one file per partition."""
    (
        df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return path


def _plain_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _clean_name(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip().replace("%", "_percent_").replace("#", "_number_"))
    return re.sub(r"[^0-9a-z]+", "_", spaced.lower()).strip("_") or "x"


def normalize_columns(df: DataFrame, style: str = "plain") -> DataFrame:
    """Header repair. ``plain``: strip, lower, blanks to underscores. ``clean``: also
    punctuation to underscores, and repeated names get ``_2``, ``_3``, ..."""
    if style == "plain":
        return df.toDF(*[_plain_name(c) for c in df.columns])
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = _clean_name(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def resolve_column(df: DataFrame, candidates: Sequence[str], to: str, contains: bool = False) -> DataFrame:
    """Bring the first present candidate under one name; with ``contains`` match parts of names."""
    if to in df.columns:
        return df
    for wanted in candidates:
        for name in df.columns:
            if name == wanted or (contains and wanted in name):
                return df.withColumnRenamed(name, to)
    return df


def harmonize(
    df: DataFrame,
    aliases: Mapping[str, str] = levels.HEADER_ALIASES,
    required: Sequence[str] = levels.LATE_COLUMNS,
) -> DataFrame:
    """Current column names, every column as text, absent late columns as null, blanks as null."""
    renames = {old: new for old, new in aliases.items() if old in df.columns and new not in df.columns}
    df = df.withColumnsRenamed(renames)
    present = [blank_to_null(F.col(c).cast("string")).alias(c) for c in df.columns]
    absent = [F.lit(None).cast("string").alias(c) for c in required if c not in df.columns]
    return df.select(*present, *absent)


def blank_strings_to_null(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: blank_to_null(c) for c in text})


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def schema_table(df: DataFrame) -> DataFrame:
    """Column name and type as rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def preview(df: DataFrame, cols: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of chosen columns, in a stated order."""
    return df.orderBy(*order).select(*cols).limit(n)

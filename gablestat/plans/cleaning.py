"""The three cleaning pipelines the analyses start from.

Each is one lazy plan: typed text in, analysis columns out. ``period`` names the
snapshot column, so several years are cleaned in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestat.functions import levels
from gablestat.functions.columns import (
    age, ln_pos, parse_currency, parse_number, price_per_area, ratio_pct, strip_prefix, title_trim, try_double,
)
from gablestat.operators.filters import complete_cases, iqr_filter, valid_records


def parse_roll(df: DataFrame) -> DataFrame:
    """Number columns that are still text become doubles; typed columns stay as they are."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    plan: Mapping[str, Column] = {
        **{c: parse_number(c) for c in [*levels.COMMA_NUMBERS, "sfyi_value"] if c in text},
        **{c: parse_currency(c) for c in levels.CURRENCY_COLUMNS if c in text},
        **{c: try_double(c) for c in levels.PLAIN_NUMBERS if c in text},
    }
    return df.withColumns(plan)


def computed_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows, where the columns are worked out before any filter: Spark would otherwise repeat what they are made of
    in each condition and ratio that names them. Other columns stay as they are, and unused ones are left out."""
    some = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not some:
        return df
    others = [c for c in df.columns if c not in some]
    return df.select(*others, F.inline(F.array(F.struct(*some)))).select(*df.columns)


def derive_ratios(df: DataFrame, as_of_year: int | Column, rounded: bool = False) -> DataFrame:
    """Price per area, age and tax ratio; ``rounded`` keeps 2 and 4 decimals."""
    return df.withColumns(
        {
            "price_per_sqft": price_per_area("total_value", "living_area", 2 if rounded else None),
            "age_of_property": age(as_of_year, "yr_built"),
            "tax_to_value_ratio": ratio_pct("gross_tax", "total_value", 4 if rounded else None),
        }
    )


POSITIVE = ("total_value", "gross_tax", "living_area", "land_sf")
_TESTED = (*POSITIVE, "yr_built")


def clean_for_comparison(
    df: DataFrame, as_of_year: int, period: str = "fiscal_year", bounded_groups: bool | None = None
) -> DataFrame:
    """Valid rows inside each snapshot's own value fences, with ratios and clean labels.

    ``bounded_groups`` says that the periods are few, so that their fences may be broadcast.
    """
    rows = computed_once(parse_roll(df), [*_TESTED, "land_value", "bldg_value"])
    rows = valid_records(rows, as_of_year, POSITIVE)
    rows = iqr_filter(rows, "total_value", by=[period], bounded_groups=bounded_groups)
    rows = derive_ratios(rows, F.col(period)).withColumns(
        {"bldg_type_clean": strip_prefix("bldg_type"), "city_clean": title_trim("city")}
    )
    return complete_cases(
        rows,
        ["total_value", "gross_tax", "land_sf", "living_area", "land_value", "bldg_value", "bldg_type", "city",
         "yr_built", "price_per_sqft", "tax_to_value_ratio"],
    )


def clean_for_tests(df: DataFrame, as_of_year: int, max_psf: float = 5000.0) -> DataFrame:
    """Valid rows below a price-per-area cap."""
    rows = valid_records(computed_once(parse_roll(df), _TESTED), as_of_year, POSITIVE).withColumns(
        {
            "price_per_sqft": price_per_area("total_value", "living_area"),
            "tax_to_value_ratio": ratio_pct("gross_tax", "total_value"),
            "bldg_type_clean": strip_prefix("bldg_type"),
        }
    ).filter(F.col("price_per_sqft") < max_psf)
    return complete_cases(
        rows,
        ["total_value", "gross_tax", "living_area", "land_sf", "price_per_sqft", "tax_to_value_ratio",
         "bldg_type", "own_occ"],
    )


def clean_for_regression(df: DataFrame, as_of_year: int, period: str = "fiscal_year") -> DataFrame:
    """Valid rows with plausible room counts, and the logarithms the models use."""
    rows = computed_once(parse_roll(df), [*_TESTED, "bed_rms", "full_bth", "hlf_bth", "num_parking"])
    rows = valid_records(rows, as_of_year, POSITIVE, {"bed_rms": (0, 10), "full_bth": (0, 8)})
    rows = derive_ratios(rows, F.col(period)).withColumns(
        {
            "log_total_value": ln_pos("total_value"),
            "log_land_sf": ln_pos("land_sf"),
            "log_living_area": ln_pos("living_area"),
            "bldg_type_clean": strip_prefix("bldg_type"),
        }
    )
    return complete_cases(
        rows,
        ["log_total_value", "log_land_sf", "log_living_area", "bed_rms", "full_bth", "hlf_bth", "num_parking",
         "age_of_property", "bldg_type_clean"],
    )

"""Column expressions: parsing, labels, ratios and encodings. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a decimal number. Spark's own cast would also accept suffixes such as
# "1D" or "2F", which are unit identifiers in this domain, and words such as "NaN".
# Text that fails here never reaches the cast, whose failure is far dearer than a match.
NUMBER_CHARACTERS = r"^[0-9eE.+-]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _maybe_round(c: Column, scale: int | None) -> Column:
    return c if scale is None else F.round(c, scale)


def try_double(c: Column | str) -> Column:
    """Plain text to double; anything that is not a number becomes null."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER_CHARACTERS), text.try_cast("double"))


def parse_number(c: Column | str) -> Column:
    """``"1,150"`` to 1150.0; blank or junk to null."""
    return try_double(F.translate(_col(c).cast("string"), ",", ""))


def parse_currency(c: Column | str) -> Column:
    """``"$9,252.42"`` to 9252.42. Every other character goes, a minus sign included."""
    text = F.regexp_replace(_col(c).cast("string"), "[^0-9.]", "")
    return F.when(text != "", text.try_cast("double"))


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def zip5(c: Column | str) -> Column:
    """ZIP code as five-digit text; missing stays missing."""
    number = try_double(c)
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    return F.when(whole.isNotNull(), F.format_string("%05d", whole))


def recode(c: Column | str, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Canonical label of each synonym; other labels are kept."""
    c = _col(c)
    out = None
    for label, variants in synonyms.items():
        hit = c.isin(list(variants))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return c if out is None else out.otherwise(c)


def strip_prefix(c: Column | str) -> Column:
    """``"RE - Row End"`` to ``"Row End"``, up to the last separator."""
    return F.regexp_replace(_col(c), "^.* - ", "")


def title_trim(c: Column | str) -> Column:
    """Trimmed title case; words also start after a hyphen or a slash."""
    out = F.initcap(F.trim(_col(c)))
    for mark in ("-", "/"):
        pieces = F.split(out, mark)
        out = F.array_join(
            F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), mark
        )
    return out


def ordinal_encode(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based rank in a declared level list; unknown labels become null."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), _col(c))
    return F.nullif(position, F.lit(0)).cast("int")


def price_per_area(value: Column | str, area: Column | str, scale: int | None = None) -> Column:
    return _maybe_round(F.try_divide(_col(value), _col(area)), scale)


def ratio_pct(numerator: Column | str, denominator: Column | str, scale: int | None = None) -> Column:
    return _maybe_round(F.try_divide(_col(numerator), _col(denominator)) * 100, scale)


def age(as_of_year: int | Column, year_built: Column | str) -> Column:
    year = as_of_year if isinstance(as_of_year, Column) else F.lit(as_of_year)
    return (year - _col(year_built)).cast("int")


def ln_pos(c: Column | str) -> Column:
    """Natural logarithm; null unless positive."""
    return F.ln(_col(c))


def log10_pos(c: Column | str) -> Column:
    return F.log10(_col(c))


def pct_change(old: Column | str, new: Column | str, scale: int | None = None, ieee: bool = False) -> Column:
    """Relative change in percent. A zero base gives null, or with ``ieee`` a signed infinity."""
    old, new = _col(old), _col(new)
    change = F.try_divide(new - old, old) * 100
    if ieee:
        inf = F.lit(float("inf"))
        change = F.when(old != 0, change).when(new > old, inf).when(new < old, -inf)
    return _maybe_round(change, scale)


def pp_change(old: Column | str, new: Column | str, scale: int | None = None) -> Column:
    """Difference in percentage points of two values that are percentages."""
    return _maybe_round(_col(new) - _col(old), scale)


def two_group(c: Column | str, threshold: float, upper: str, lower: str) -> Column:
    c = _col(c)
    return F.when(c >= threshold, upper).when(c < threshold, lower)


def decision(p: Column | str, alpha: float = 0.05, reject: str = "Reject H0", keep: str = "Fail to Reject H0") -> Column:
    p = _col(p)
    return F.when(p < alpha, reject).when(p >= alpha, keep)


def between_open(c: Column | str, lo: float, hi: float) -> Column:
    c = _col(c)
    return (c > lo) & (c < hi)


def between_closed(c: Column | str, lo: float, hi: float) -> Column:
    return _col(c).between(lo, hi)


def half_open_year(c: Column | str, after: int, upto: int) -> Column:
    """``after < year <= upto``."""
    c = _col(c)
    return (c > after) & (c <= upto)

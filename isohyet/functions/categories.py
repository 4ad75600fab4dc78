"""Categories of values and probabilities. Forecasting and verification have different rules for ties: both are here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tercile probabilities (below, normal, above) of the four consensus categories.
CATEGORY_PROBABILITIES = [[0.40, 0.35, 0.25], [0.35, 0.40, 0.25], [0.25, 0.40, 0.35], [0.25, 0.35, 0.40]]
#: Terciles of the four consensus categories.
CATEGORY_TERCILES = [1, 2, 2, 3]
#: Names and codes of the consensus categories.
CATEGORY_CODES = {"below normal": 1, "normal to below": 2, "normal to above": 3, "above normal": 4}
#: Quantile levels of the thresholds, and the climatological shares that scores use.
TERCILE_LEVELS = (0.33, 0.66)
CLIMATOLOGY_CUMULATIVE = (0.33, 0.66, 1.0)


def tercile(v: Column, q33: Column, q66: Column) -> Column:
    """Verification: 1 up to q33, 2 up to q66, else 3."""
    return F.when(v.isNull(), None).when(v <= q33, 1).when(v <= q66, 2).otherwise(3).cast("int")


def tercile_inclusive(v: Column, q33: Column, q66: Column) -> Column:
    """Forecasting: a value on a threshold belongs to the outer class, and below wins."""
    return F.when(v.isNull(), None).when(v <= q33, "below").when(v >= q66, "above").otherwise("normal")


def quartile_category(v: Column, q33: Column, q50: Column, q66: Column) -> Column:
    """Consensus category 1 to 4 of a value, each class closed on the right."""
    return F.when(v.isNull(), None).when(v <= q33, 1).when(v <= q50, 2).when(v <= q66, 3).otherwise(4).cast("int")


def category_tercile(code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, CATEGORY_TERCILES)), code.cast("int"))


def category_probabilities(code: Column) -> Column:
    """(below, normal, above) as an array."""
    return F.try_element_at(F.array(*(F.array(*map(F.lit, p)) for p in CATEGORY_PROBABILITIES)), code.cast("int"))


def likeliest_tercile(below: Column, normal: Column, above: Column) -> Column:
    """Ties go to above, then normal."""
    return F.when((above >= normal) & (above >= below), "above").when(normal >= below, "normal").otherwise("below")


def likeliest_category(below: Column, normal: Column, above: Column) -> Column:
    """The two likeliest classes as one of four labels; ties go to below, then normal."""
    first_below = (below >= normal) & (below >= above)
    towards = F.when(below >= above, "normal-to-below").otherwise("normal-to-above")
    return F.when(first_below, "below").when(normal >= above, towards).otherwise("above")


def likeliest_class(below: Column, normal: Column, above: Column) -> Column:
    """0 below, 1 normal, 2 above; ties go to the first of them."""
    return F.when((below >= normal) & (below >= above), 0).when(normal >= above, 1).otherwise(2).cast("int")


def binned(v: Column, breaks: list[float]) -> Column:
    """Number of the class of a value: 0 below the first break, then one more from each break on."""
    found: Column = F.lit(0)
    for i, edge in enumerate(breaks):
        found = F.when(v >= edge, i + 1).otherwise(found)
    return F.when(v.isNotNull(), found).cast("int")


def nice_limits(low: Column, high: Column) -> tuple[Column, Column]:
    """Axis limits: the range is padded by 5 % and rounded outwards to its power of ten."""
    pad = (high - low) * 0.05
    low, high = low - pad, high + pad
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(high - low, F.lit(0.0)))))
    return F.floor(low / step) * step, F.ceil(high / step) * step

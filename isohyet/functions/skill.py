"""Skill scores as aggregate and row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.functions.categories import CATEGORY_PROBABILITIES, CLIMATOLOGY_CUMULATIVE

EPSILON = 2.220446049250313e-16


def is_class(obs: Column, k: int) -> Column:
    return F.when(obs == k, 1.0).otherwise(0.0)


def observed_probability(below: Column, normal: Column, above: Column, obs: Column) -> Column:
    """The probability given to the class 0, 1 or 2 that came."""
    return F.when(obs == 0, below).when(obs == 1, normal).when(obs == 2, above)


def mape(forecast: Column, obs: Column) -> Column:
    """Mean absolute error over the size of the forecast."""
    return F.avg(F.abs(forecast - obs) / F.greatest(F.abs(forecast), F.lit(EPSILON)))


def mape_of_observed(forecast: Column, obs: Column) -> Column:
    """The usual form, over the size of the observation."""
    return F.avg(F.abs(forecast - obs) / F.greatest(F.abs(obs), F.lit(EPSILON)))


def rmse(forecast: Column, obs: Column) -> Column:
    return F.sqrt(F.avg(F.pow(forecast - obs, F.lit(2.0))))


def explained_variance(forecast: Column, obs: Column) -> Column:
    return 1 - F.var_pop(forecast - obs) / F.nullif(F.var_pop(forecast), F.lit(0.0))


def rps(p: tuple[Column, Column, Column], obs: Column) -> Column:
    """Ranked probability score of a row, over the three classes in order."""
    first = F.pow(p[0] - is_class(obs, 0), F.lit(2.0))
    second = F.pow(p[0] + p[1] - is_class(obs, 0) - is_class(obs, 1), F.lit(2.0))
    third = F.pow(p[0] + p[1] + p[2] - 1.0, F.lit(2.0))
    return first + second + third


def ignorance(p_obs: Column) -> Column:
    return -F.log2(F.least(F.greatest(p_obs, F.lit(1e-15)), F.lit(1 - 1e-15)))


def brier(below: Column, normal: Column, above: Column, obs: Column) -> Column:
    return sum((F.pow(p - is_class(obs, k), F.lit(2.0)) for k, p in enumerate((below, normal, above))), F.lit(0.0))


def heidke_hit(below: Column, normal: Column, above: Column, obs: Column) -> Column:
    """Classes 1 to 3: one over the number of likeliest classes if the observed is among them, else 0."""
    top = F.greatest(below, normal, above)
    ties = sum((F.when(p == top, 1).otherwise(0) for p in (below, normal, above)), F.lit(0))
    hit = F.when(obs == 1, below).when(obs == 2, normal).when(obs == 3, above) == top
    return F.when(hit, 1.0 / ties).when(obs.isNotNull() & top.isNotNull(), 0.0)


def interest_rate(p_obs: Column) -> Column:
    return (p_obs / CLIMATOLOGY_CUMULATIVE[0] - 1) * 100


def ignorance_of_cell(p_obs: Column) -> Column:
    return -F.log2(F.when(p_obs == 0, 0.01).otherwise(p_obs))


def category_hit(forecast: Column, obs: Column) -> Column:
    """3 for the same consensus category, less one for each step between them."""
    return (3 - F.abs(forecast - obs)).cast("int")


def rpss_of_cell(forecast: Column, obs: Column) -> Column:
    """Ranked probability skill of a consensus category, against climatology."""
    clim = CLIMATOLOGY_CUMULATIVE
    cumulative = F.array(*(F.array(*map(F.lit, (p[0], p[0] + p[1], 1.0))) for p in CATEGORY_PROBABILITIES))
    # An observed category in the lower, middle or upper tercile.
    stepped = F.array(*(F.array(*map(F.lit, s)) for s in ([1.0, 1.0, 1.0], [0.0, 1.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])))
    f, o = F.try_element_at(cumulative, forecast.cast("int")), F.try_element_at(stepped, obs.cast("int"))
    score = lambda x: sum((F.pow(x(i) - F.get(o, F.lit(i)), F.lit(2.0)) for i in range(3)), F.lit(0.0))
    return 1 - score(lambda i: F.get(f, F.lit(i))) / score(lambda i: F.lit(clim[i]))

"""Whole workflows with their settings: forecast, verification, zoning and synthesis."""

from __future__ import annotations

import datetime
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions import calendar as cal
from isohyet.functions import categories as cat
from isohyet.functions import skill
from isohyet.operators import align, clean, fields, lineage, models, overlay, probability, regions, season, spatial, synthesis
from isohyet.operators.shared import SHARED

LEAST_CLIMATOLOGY = 20
LEAST_TIMES = 7  # of a record that principal components are fitted on
LINEAR, OTHER = ("ols", "ridge", "lasso"), ("tree", "forest", "mlp")
MOST_GRID_POINTS = (1 << 30) // (64 * 6)


@dataclass(frozen=True)
class ForecastSpec:
    source_month: int
    target: str  # such as Dec-Feb, or Dec
    climatology: tuple[int, int]
    forecast_year: int
    how: str = "sum"  # of the months of a season
    regressor: str = "ols"  # ols, ridge, lasso, tree, forest, mlp; pcr and cca stand for ols with that preprocessor
    alpha: float | None = None
    preprocessor: str = "none"  # pcr: principal components of all predictors; cca: canonical scores of both fields
    leave_one_out: bool = False
    most_frequent: float = 0.2
    complete_only: bool = True
    keep_all: bool = False
    as_reference: bool = False

    def start_month(self) -> int:
        if self.target[:3] not in cal.MONTHS:
            raise ValueError(f"unknown season {self.target}")
        return cal.MONTHS.index(self.target[:3]) + 1

    def lead(self) -> int:
        lead = (self.start_month() - self.source_month) % 12
        if lead > cal.MAX_LEAD:
            raise ValueError(f"a lead of {lead} months is more than {cal.MAX_LEAD}")
        return lead

    def validate(self) -> None:
        self.lead()
        if self.climatology[0] >= self.climatology[1]:
            raise ValueError("the climatology must end after it starts")
        preprocessor, regressor = self.method()
        if regressor not in LINEAR + OTHER:
            raise ValueError(f"unknown regressor {self.regressor}")
        if preprocessor not in ("none", "pcr", "cca"):
            raise ValueError(f"unknown preprocessor {self.preprocessor}")

    def method(self) -> tuple[str, str]:
        """Preprocessor and regressor."""
        return (self.regressor, "ols") if self.regressor in ("pcr", "cca") else (self.preprocessor, self.regressor)

    def options(self) -> dict[str, float]:
        return {"alpha": self.alpha} if self.alpha is not None and self.method()[1] in ("ridge", "lasso") else {}

    def target_time(self) -> datetime.date:
        return datetime.date(self.forecast_year, self.start_month(), 1)


def _line(spec: ForecastSpec, good: DataFrame, pred: DataFrame, key: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hindcast, forecast and in-sample estimate of a line on one predictor."""
    regressor = spec.regressor
    pairs = align.lead_align(good, pred, spec.lead(), key)
    folded = align.leave_one_out(pairs) if spec.leave_one_out else align.with_folds(pairs)
    fit = align.standard_fit(pairs, **({regressor: spec.alpha} if spec.alpha is not None and regressor != "ols" else {}))
    new = _new_rows(spec, pred, key).withColumn("y", F.lit(None).cast("double"))
    if key is None:
        new = fit.select("loc_id").join(spatial.checked(new), how="cross")
    hcst = align.out_of_fold_linear(folded, regressor, spec.alpha)
    return hcst, align.fitted(new, fit, f"w_{regressor}").select("loc_id", "time", "h"), align.fitted(pairs, fit, f"w_{regressor}").select("loc_id", "time", "h")


def _new_rows(spec: ForecastSpec, pred: DataFrame, key: str | None) -> DataFrame:
    rows = pred.select(*([key] if key else []), F.add_months("time", spec.lead()).alias("time"), F.col("value").alias("x"))
    return rows.filter(F.year("time") == spec.forecast_year)


def _own_model(spec: ForecastSpec, good: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a tree, forest or network of each location on its own predictor."""
    pairs = align.lead_align(good, pred, spec.lead(), "loc_id").withColumn("features", F.array("x"))
    folded = align.leave_one_out(pairs) if spec.leave_one_out else align.with_folds(pairs)
    new = _new_rows(spec, pred, "loc_id").withColumn("features", F.array("x"))
    again = pairs.select("loc_id", "time", "features")
    return models.out_of_fold(folded, spec.regressor), models.fitted(pairs, new, spec.regressor), models.fitted(pairs, again, spec.regressor)


def _field_model(spec: ForecastSpec, good: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of all cells of the predictor together: through principal components or canonical scores, or as they are by
    one tree, forest or network over all locations.

    Locations and predictor cells count if they have a value at each time that the two tables share."""
    preprocessor, regressor = spec.method()
    options, target = spec.options(), spec.target_time()
    shifted = pred.withColumn("time", F.add_months("time", spec.lead()))
    shifted = shifted if "loc_id" in pred.columns else shifted.withColumn("loc_id", F.lit("predictor"))
    times = [t for t in fields.shared_times(good, shifted) if t != target]
    n = len(times)
    if n < LEAST_TIMES:
        raise ValueError(f"{n} times with observations and predictors; {LEAST_TIMES} are needed")
    x, y, every = fields.field(shifted, [*times, target]), fields.field(good, times), np.arange(n)
    fits = fields.fold_fits(n, None if spec.leave_one_out else align.FOLDS)
    kx = fields.products(x, [*fits, every], n + 1)
    if not kx[-1].any():
        raise ValueError("no predictor has a value at each time")
    if regressor in SHARED and preprocessor != "cca":
        # Gains and gradients are of the values as they are, not scaled by location; a network's outputs are scaled.
        ky = fields.products(y, [*fits, every], n, scale=regressor == "mlp")
        plain = None if preprocessor == "pcr" else fields.rows_of(x, n + 1)
        features = lambda i, fit: fields.component_scores(kx[i], fit) if plain is None else plain
        weights = lambda i, fit: fields.shared_weights(features(i, fit), ky[i], fit, n, regressor)
    elif preprocessor == "pcr" and regressor == "lasso":
        scores = [fields.component_scores(k, fit) for k, fit in zip(kx, [*fits, every], strict=True)]
        rows = [(s[:n], fit) for s, fit in zip(scores, fits, strict=False)] + [(scores[-1], every), (np.vstack([scores[-1][:n]] * 2), every)]
        found = fields.regressed(y, rows, regressor, **options).join(y, "loc_id")
        part = lambda start, size: F.slice("h", start + 1, size)
        hcst = fields.dated(found, times, {"y": F.col("features"), "h": part(0, n)})
        return hcst, fields.dated(found, [target], {"h": part(n, 1)}), fields.dated(found, times, {"h": part(n + 1, n)})
    elif preprocessor == "pcr":
        ridge = (1.0 if spec.alpha is None else spec.alpha) if regressor == "ridge" else 0.0
        weights = lambda i, fit: fields.principal_weights(kx[i], fit, n, ridge)
    else:
        ky = fields.products(y, [*fits, every], n)
        weights = lambda i, fit: fields.canonical_weights(kx[i], ky[i], fit, n, regressor, **options)
    whole = weights(len(fits), every)
    hcst = fields.applied(y, fields.out_of_fold_weights(weights, fits, n), times, with_values=True)
    return hcst, fields.applied(y, whole[n:], [target]), fields.applied(y, whole[:n], times)


def predictor_components(spec: ForecastSpec, predictand: DataFrame, predictor: DataFrame) -> dict[str, DataFrame]:
    """What a principal components regression keeps: explained variance, scores by time, and loadings by predictor."""
    obs, pred = _series(spec, predictand, predictor)
    shifted = pred.withColumn("time", F.add_months("time", spec.lead()))
    times = fields.shared_times(obs, shifted)
    x, every = fields.field(shifted, times), np.arange(len(times))
    u, _, s = fields.spectrum(fields.products(x, [every], len(times))[0], every)
    k, ratio = fields.kept_components(s, len(times)), fields.shares(s)
    spark = predictand.sparkSession
    variance = spark.createDataFrame([(i + 1, float(r), float(c), i < k) for i, (r, c) in enumerate(zip(ratio, ratio.cumsum(), strict=True))], "k int, variance_ratio double, cumulative double, kept boolean")
    scores = spark.createDataFrame([(t, j + 1, float(u[i, j] * s[j])) for i, t in enumerate(times) for j in range(k)], "time date, k int, score double")
    load = fields.loadings(fields.scaled_field(x), u[:, :k], s[:k]).select("loc_id", F.posexplode("loadings").alias("k", "loading"))
    return {"variance": variance, "scores": scores, "loadings": load.withColumn("k", F.col("k") + 1)}


def _series(spec: ForecastSpec, predictand: DataFrame, predictor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of the target season and predictors of the source month."""
    obs = predictand.filter("value is not null")
    if cal_is_season(spec.target):
        obs = season.resample(obs, spec.start_month(), spec.how, spec.complete_only)
    else:
        obs = obs.filter(F.month("time") == spec.start_month())
    return obs, predictor.filter((F.month("time") == spec.source_month) & F.col("value").isNotNull())


def fitted_models(spec: ForecastSpec, predictand: DataFrame, predictor: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-validated hindcast (loc_id, time, y, h), forecast and in-sample estimate (loc_id, time, h)."""
    spec.validate()
    preprocessor, regressor = spec.method()
    obs, pred = _series(spec, predictand, predictor)
    good = clean.varied_locations(obs, spec.most_frequent)
    own = "loc_id" in predictor.columns
    if preprocessor != "none" or (regressor in OTHER and not own):
        return _field_model(spec, good, pred)
    return _line(spec, good, pred, "loc_id" if own else None) if regressor in LINEAR else _own_model(spec, good, pred)


def forecast(spec: ForecastSpec, predictand: DataFrame, predictor: DataFrame) -> dict[str, DataFrame]:
    """The five result tables of a forecast from monthly series (loc_id, time, value).

    Without a preprocessor, each location has the predictor of its own loc_id, or all share one without loc_id. With
    one, the predictor is a field and its loc_id names its cells."""
    hcst, new, _ = fitted_models(spec, predictand, predictor)
    obs, _ = _series(spec, predictand, predictor)
    clim = season.climatology(obs.filter(season.in_years(*spec.climatology)))
    fcst = new.select("loc_id", "time", F.col("h").alias("value"))
    limits = clim.select("loc_id", "q33", "q66")
    judged = probability.probabilities(hcst, limits, keep=["y", "h"])
    p_hcst = judged.drop("y", "h")
    p_fcst = probability.forecast_probabilities(fcst.select("loc_id", F.col("value").alias("f")), hcst, limits)
    three = [F.col(c) for c in ("p_below", "p_normal", "p_above")]
    named = {"tercile": cat.likeliest_tercile(*three), "category": cat.likeliest_category(*three)}
    return {
        "deterministic-fcst": season.anomalies(fcst, clim, spec.keep_all),
        "probabilistic-fcst": p_fcst.withColumns(named),
        "skill": probability.skill_table(None, judged, spec.as_reference),
        "deterministic-hcst": season.anomalies(hcst.select("loc_id", "time", F.col("h").alias("value")), clim, spec.keep_all),
        "probabilistic-hcst": p_hcst.withColumns(named),
    }


def cal_is_season(target: str) -> bool:
    return len(target) > 3


@dataclass(frozen=True)
class VerificationSpec:
    season: str  # such as DJF, DJ or Dec
    year: int  # in which the season starts
    climatology: tuple[int, int]  # of the years in which seasons end
    how: str = "sum"

    def params(self) -> tuple[int, int]:
        for code, months, last in cal.season_table():
            if code == self.season:
                return months, last
        raise ValueError(f"unknown season {self.season}")

    def end_year(self) -> int:
        months, last = self.params()
        return self.year + 1 if last - months < 0 else self.year

    def validate(self) -> None:
        self.params()
        first, last = self.climatology
        if first >= last:
            raise ValueError("the climatology must end after it starts")
        if last - first + 1 < LEAST_CLIMATOLOGY:
            warnings.warn(f"a climatology of fewer than {LEAST_CLIMATOLOGY} years", stacklevel=2)


def verification(spec: VerificationSpec, observed: DataFrame, points: DataFrame, edges: DataFrame, forecast_category: DataFrame) -> DataFrame:
    """All layers of one season, a row per location inside the forecast's polygons.

    observed: monthly (loc_id, time, value); points: (loc_id, lat, lon); edges: of the polygons; forecast_category:
    (zone_id, category), 1 to 4."""
    spec.validate()
    months, last = spec.params()
    member = spatial.within(points, edges).join(forecast_category.select("zone_id", F.col("category").cast("string").try_cast("int").alias("fcst_cemcat")), "zone_id")
    inside = observed.withColumn("value", clean.not_negative(F.col("value"))).join(member.select("loc_id").distinct(), "loc_id", "left_semi")
    rolled = season.rolling(inside, months, spec.how).filter(F.month("time") == last)
    sample = rolled.filter(season.in_years(*spec.climatology))
    clim = season.climatology(sample)
    now = season.quantile_anomaly(rolled.filter(F.year("time") == spec.end_year()), sample)
    v, q33, q50, q66 = (F.col(c) for c in ("value", "q33", "q50", "q66"))
    df = now.join(clim, "loc_id").join(member, "loc_id")
    df = df.withColumns({"obs_terc": cat.tercile(v, q33, q66), "obs_cemcat": cat.quartile_category(v, q33, q50, q66), "fcst_terc": cat.category_tercile(F.col("fcst_cemcat")), "_p": cat.category_probabilities(F.col("fcst_cemcat"))})
    p = [F.get("_p", F.lit(i)) for i in range(3)]
    p_obs = F.get("_p", F.col("obs_terc") - 1)
    return df.select(
        "loc_id", "zone_id", "time", F.bround(v, 1).alias("obs_value"), F.bround("mean", 2).alias("obs_clim"), F.bround((v - F.col("mean")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100, 0).alias("obs_relanom"),
        "obs_terc", "obs_cemcat", F.bround("quantile", 3).alias("obs_quantanom"), "fcst_cemcat", "fcst_terc", skill.heidke_hit(*p, F.col("obs_terc")).alias("fcst_heidkehit"), F.bround(skill.interest_rate(p_obs), 1).alias("fcst_intrate"),
        F.bround(skill.ignorance_of_cell(p_obs), 2).alias("fcst_ignorance"), F.bround(skill.rpss_of_cell(F.col("fcst_cemcat"), F.col("obs_cemcat")), 2).alias("fcst_rpss"), skill.category_hit(F.col("fcst_cemcat"), F.col("obs_cemcat")).alias("fcst_cemhit"),
    )


SCORE_LAYERS = ["fcst_heidkehit", "fcst_intrate", "fcst_ignorance", "fcst_rpss", "fcst_cemhit"]


def score_means(layers: DataFrame, zone: str | None = None) -> DataFrame:
    """Means of the score layers, by zone or over all."""
    return (layers.groupBy(zone) if zone else layers.groupBy()).agg(*(F.avg(c).alias(c) for c in SCORE_LAYERS))


@dataclass(frozen=True)
class ZoningSpec:
    box: tuple[float, float, float, float] | None = None  # west, south, east, north; else outwards from the stations
    step: float = 0.05
    explained: float = 70.0
    rotation: str = "varimax"
    zones: int | None = None  # else the elbow of the costs of 1 to 16
    season: str = "JFM"
    how: str = "sum"
    years: tuple[int, int] | None = None  # in which the seasons end
    interpolation: str = "idw"

    def grid_points(self, box: tuple[float, float, float, float]) -> int:
        west, south, east, north = box
        return (int(round((east - west) / self.step)) + 1) * (int(round((north - south) / self.step)) + 1)

    def params(self) -> tuple[int, int]:
        for code, months, last in cal.season_table():
            if code == self.season:
                return months, last
        raise ValueError(f"unknown season {self.season}")

    def check_box(self, box: tuple[float, float, float, float]) -> None:
        if box[0] >= box[2] or box[1] >= box[3]:
            raise ValueError("the box needs west below east and south below north")
        if self.grid_points(box) > MOST_GRID_POINTS:
            raise ValueError("the grid has too many points; take a larger step")

    def validate(self) -> None:
        self.params()
        if self.rotation not in ("none", "varimax", "quartimax"):
            raise ValueError(f"unknown rotation {self.rotation}")
        if self.interpolation not in ("idw", "rbf"):
            raise ValueError(f"unknown interpolation {self.interpolation}")
        if self.how not in ("sum", "mean"):
            raise ValueError(f"unknown composition {self.how}")
        if self.zones is not None and self.zones < 1:
            raise ValueError("at least one zone is needed")
        if self.box:
            self.check_box(self.box)


def _box_of(points: DataFrame, extent: DataFrame | None) -> tuple[float, float, float, float]:
    """Bounds outwards from the stations and, where given, from the boxes (min_x, min_y, max_x, max_y) of a base map."""
    rows = points.select(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))
    rows = rows.unionByName(extent.select(rows.columns)) if extent is not None else rows
    b = spatial.outward_bounds(rows, "min_x", "min_y", "max_x", "max_y").first()
    return b["min_x"], b["min_y"], b["max_x"], b["max_y"]


class TooFewStations(ValueError):
    """Not enough stations or years for zones."""


def season_matrix(spec: ZoningSpec, monthly: DataFrame, points: DataFrame) -> tuple[DataFrame, list[datetime.date], DataFrame]:
    """The field of seasons of the stations with every year, its times, and the same as rows (loc_id, year, value)."""
    months, last = spec.params()
    seasons = season.rolling(monthly, months, spec.how, drop_empty=False).filter((F.month("time") == last) & F.col("value").isNotNull())
    if spec.years:
        seasons = seasons.filter(season.in_years(*spec.years))
    seasons = seasons.join(points.select("loc_id"), "loc_id", "left_semi")
    times = fields.shared_times(seasons, seasons)
    whole = fields.field(seasons, times)
    return whole, times, fields.dated(whole, times, {"value": F.col("features")}).select("loc_id", F.year("time").alias("year"), "value")


def zoning(spec: ZoningSpec, monthly: DataFrame, points: DataFrame, extent: DataFrame | None = None) -> dict[str, DataFrame]:
    """Zones of alike seasons from monthly series (loc_id, time, value) of stations (loc_id, lat, lon).

    data: (loc_id, year, value) of the stations with every year; variance: of the components; components and
    components_rotated: (loc_id, k, value); costs: of the numbers of zones that were tried; zones: the grid (row_idx,
    col_idx, lat, lon, zone)."""
    spec.validate()
    spark = monthly.sparkSession
    whole, times, data = season_matrix(spec, monthly, points)
    held = whole.count()
    if held < 2 or len(times) < 2:
        raise TooFewStations(f"{held} stations without gaps in {len(times)} years are not enough for zones")
    scaled, every = fields.scaled_field(whole), np.arange(len(times))
    u, _, s = fields.spectrum(fields.products(whole, [every], len(times))[0], every)
    ratio, k = fields.shares(s), fields.components_needed(s, spec.explained)
    load = {r: fields.factor_loadings(scaled, u, s, k, r) for r in dict.fromkeys(("none", spec.rotation))}
    flat = {r: d.select("loc_id", F.posexplode("loadings").alias("k", "value")).withColumn("k", F.col("k") + 1) for r, d in load.items()}
    box = spec.box or _box_of(points.join(whole.select("loc_id"), "loc_id", "left_semi"), extent)
    spec.check_box(box)
    west, south, east, north = box
    grid, cell = spatial.mesh(spark, west, east, south, north, spec.step), ["row_idx", "col_idx"]
    stations = load[spec.rotation].join(points, "loc_id")
    layer = spatial.idw if spec.interpolation == "idw" else models.rbf
    layers = [layer(grid, stations.select("lon", "lat", F.get("loadings", F.lit(i)).alias("value")), cell).withColumn("k", F.lit(i)) for i in range(k)]
    stacked = layers[0]
    for one in layers[1:]:
        stacked = stacked.unionByName(one)
    features = stacked.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("_f")).select(*cell, F.col("_f.value").alias("features"))
    features = lineage.cut(features)  # several passes read it
    costs = [] if spec.zones else models.kmeans_costs(features)
    zones = models.kmeans_zones(features, spec.zones or models.elbow(costs))
    return {
        "data": data,
        "variance": spark.createDataFrame([(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, ratio.cumsum(), strict=True))], "k int, variance_ratio double, cumulative double"),
        "components": flat["none"],
        "components_rotated": flat[spec.rotation],
        "costs": spark.createDataFrame([(a, b) for a, b in costs], "k int, inertia double"),
        "zones": grid.join(zones.select(*cell, "zone"), cell),
    }


ROWS_APART = 1 << 24  # of the copies of a raster, one a zone, while zones that overlap become polygons


def zone_map(cells: DataFrame, min_x: float = 0.0, min_y: float = 0.0, step: float = 1.0, base: DataFrame | None = None, smoothing: float = 0.0) -> DataFrame:
    """(zone, rings) of the map of a raster of zones (row_idx, col_idx, zone), whose first cell's centre is at min_x, min_y.

    Regions become polygons; those smaller than another of their zone that lie within one of any zone go, and holes are
    closed. With smoothing, zones grow and shrink by so many cells first, and may overlap. With a base map (zone_id, rings),
    what lies outside of it is cut off, and there is a row for each zone and base polygon: (zone, zone_id, rings)."""
    shapes = lineage.cut(regions.polygons(cells, min_x=min_x, min_y=min_y, step=step).select("region", "zone", F.slice("rings", 1, 1).alias("rings")))
    edges = spatial.edges_of_rings(shapes, "region")
    small = spatial.small_polygons(shapes.join(spatial.boxes(edges).withColumnRenamed("zone_id", "region"), "region").withColumnRenamed("region", "poly_id"), edges)
    kept = lineage.cut(shapes.join(small.withColumnRenamed("poly_id", "region"), "region", "left_anti"))
    if smoothing:
        held = regions.filled(kept, min_x, min_y, step)
        apart = regions.smooth(held, smoothing).withColumn("row_idx", F.col("row_idx") + F.col("zone") * ROWS_APART)
        moved = regions.polygons(apart, min_x=min_x, min_y=min_y, step=step)
        back = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), (p["y"] - F.col("zone") * (ROWS_APART * step)).alias("y"))))
        kept = moved.select("region", "zone", F.slice(back, 1, 1).alias("rings"))
    whole = kept.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("region", F.col("rings")[0].alias("ring")))).alias("_r")).select("zone", F.transform("_r", lambda r: r["ring"]).alias("rings"))
    if base is None:
        return whole
    return overlay.intersection(whole.withColumnRenamed("zone", "zone_id"), base).select(F.col("a_id").alias("zone"), F.col("b_id").alias("zone_id"), "rings")


def synthesis_features(decisions: DataFrame, id_name: str, year: int, period: str) -> DataFrame:
    """Properties of every zone; refused while a decision lacks a field."""
    if not synthesis.is_complete(decisions).isEmpty():
        raise ValueError("a zone's decision is not complete")
    return synthesis.properties(decisions, id_name, year, period)

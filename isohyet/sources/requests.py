"""Requests for remote grids, as filters and means over a local copy of the data.

The services' requests - a time range, months, a box, a level, members, leads - become predicates that Spark pushes to
the files, and means over the dimensions that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.calendar import MAX_LEAD
from isohyet.operators import season
from isohyet.operators.clean import in_box, without_sentinel


#: Products by code - the first year that they have, the pressure level, and whether they are forecasts
#: with members and leads. All mark missing values with -999.
PRODUCTS = {
    "PRCP_CHIRPSp25_IRIDL": (1981, None, False),
    "SST_ERSSTv5_IRIDL": (1854, None, False),
    "GPH500_NCEP-NCAR_IRIDL": (1949, 500.0, False),
    "MSL_NCEP-NCAR_IRIDL": (1949, None, False),
    "SST_GEOSS2S_IRIDL": (1981, None, True),
    "SST_CCSM4_IRIDL": (1981, None, True),
    "SST_CFSv2_IRIDL": (1981, None, True),
    "PRCP_GEOSS2S_IRIDL": (1981, None, True),
    "PRCP_CCSM4_IRIDL": (1981, None, True),
    "PRCP_CFSv2_IRIDL": (1981, None, True),
    "z500_GEOSS2S_IRIDL": (1981, None, True),
    "z200_CCSM4_IRIDL": (1981, None, True),
    "z200_CFSv2_IRIDL": (1981, None, True),
}
PRODUCT_MISSING = -999.0


@dataclass(frozen=True)
class GridRequest:
    """A query for a gridded variable (time, lat, lon, value; perhaps level, lead and member)."""

    first_year: int
    last_year: int
    months: tuple[int, ...] = ()
    box: tuple[float, float, float, float] | None = None  # south, north, west, east
    level: float | None = None
    lead: int | None = None
    seasonal: bool = False
    missing: float | None = None
    source_first_year: int | None = None

    @classmethod
    def of_product(cls, code: str, first_year: int, last_year: int, **options) -> GridRequest:
        """A request with a product's own settings; only forecasts have a lead."""
        if code not in PRODUCTS:
            raise ValueError(f"unknown product {code}")
        start, level, is_forecast = PRODUCTS[code]
        if (options.get("lead") is None) == is_forecast:
            raise ValueError(f"{code} {'needs' if is_forecast else 'has no'} lead")
        return cls(first_year, last_year, level=level, missing=PRODUCT_MISSING, source_first_year=start, **options)

    def validate(self) -> None:
        if self.last_year < self.first_year:
            raise ValueError("the last year lies before the first")
        if self.box and not (self.box[0] < self.box[1] and self.box[2] < self.box[3]):
            raise ValueError("the box needs south below north and west below east")
        if self.lead is not None and not 1 <= self.lead <= MAX_LEAD:
            raise ValueError(f"the lead must lie between 1 and {MAX_LEAD} months")

    def lead_range(self) -> tuple[float, float] | None:
        """Leads are centred on half months; a season takes two more."""
        return None if self.lead is None else (self.lead - 0.5, self.lead + (1.5 if self.seasonal else -0.5))

    def apply(self, grid: DataFrame) -> DataFrame:
        """(time, lat, lon, value): filters first, then the mean over levels, leads and members that are left."""
        self.validate()
        first = max(self.first_year, self.source_first_year or self.first_year)
        df = grid.filter(F.col("time").between(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(self.last_year), F.lit(12), F.lit(31))))
        if self.months:
            df = df.filter(F.month("time").isin(*self.months))
        if self.box:
            df = df.filter(in_box(F.col("lat"), F.col("lon"), *self.box))
        if self.level is not None:
            df = df.filter(F.col("level") == self.level)
        if leads := self.lead_range():
            df = df.filter(F.col("lead").between(*leads))
        value = F.col("value") if self.missing is None else without_sentinel(F.col("value"), self.missing)
        return df.withColumn("value", value).groupBy("time", "lat", "lon").agg(F.avg("value").alias("value"))


def seasonal_total(monthly: DataFrame, start_month: int) -> DataFrame:
    """Sums of a season from its monthly means, times three."""
    return season.resample(monthly, start_month, "mean").withColumn("value", F.col("value") * 3)


def relabelled(df: DataFrame, months: int = -1) -> DataFrame:
    """Forecasts dated by their start are labelled by the month before."""
    return df.withColumn("time", F.add_months("time", months))


def from_mid_season(df: DataFrame, seasonal: bool = True) -> DataFrame:
    """Remote seasons are labelled by their middle month: data of a season begin one month before its label and end one
    month after it. Labels become first months, and `last_time` the season's last month; monthly data keep theirs."""
    start = F.trunc("time", "MM")
    first, last = (F.add_months(start, -1), F.add_months(start, 1)) if seasonal else (start, start)
    return df.withColumn("last_time", last).withColumn("time", first)


def fetch(spark: SparkSession, path: str, request: GridRequest, out: str, overwrite: bool = False) -> DataFrame:
    """The answer to a request, kept at `out`; an answer that is there is not made again unless asked."""
    request.apply(spark.read.parquet(path)).write.mode("overwrite" if overwrite else "ignore").parquet(out)
    return spark.read.parquet(out)

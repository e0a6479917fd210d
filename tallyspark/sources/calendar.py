"""Business calendar: public holidays, travel expos, and day features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import days_to_month_end, is_weekend

# Public holidays without the weekly rest day, by year.
PUBLIC_HOLIDAYS = {
    2024: {
        "2024-01-01": "The first day of January",
        "2024-02-10": "Lunar New Year's Day",
        "2024-02-12": "The third day of Lunar New Year",
        "2024-02-13": "The fourth day of Lunar New Year",
        "2024-03-29": "Good Friday",
        "2024-03-30": "The day following Good Friday",
        "2024-04-01": "Easter Monday",
        "2024-04-04": "Ching Ming Festival",
        "2024-05-01": "Labour Day",
        "2024-05-15": "The Birthday of the Buddha",
        "2024-06-10": "Tuen Ng Festival",
        "2024-07-01": "Hong Kong Special Administrative Region Establishment Day",
        "2024-09-18": "The day following the Chinese Mid-Autumn Festival",
        "2024-10-01": "National Day",
        "2024-10-11": "Chung Yeung Festival",
        "2024-12-25": "Christmas Day",
        "2024-12-26": "The first weekday after Christmas Day",
    },
    2025: {
        "2025-01-01": "The first day of January",
        "2025-01-29": "Lunar New Year's Day",
        "2025-01-30": "The second day of Lunar New Year",
        "2025-01-31": "The third day of Lunar New Year",
        "2025-04-04": "Ching Ming Festival",
        "2025-04-18": "Good Friday",
        "2025-04-19": "The day following Good Friday",
        "2025-04-21": "Easter Monday",
        "2025-05-01": "Labour Day",
        "2025-05-05": "The Birthday of the Buddha",
        "2025-05-31": "Tuen Ng Festival",
        "2025-07-01": "Hong Kong Special Administrative Region Establishment Day",
        "2025-10-01": "National Day",
        "2025-10-07": "The day following the Chinese Mid-Autumn Festival",
        "2025-10-29": "Chung Yeung Festival",
        "2025-12-25": "Christmas Day",
        "2025-12-26": "The first weekday after Christmas Day",
    },
    2026: {
        "2026-01-01": "The first day of January",
        "2026-02-17": "Lunar New Year's Day",
        "2026-02-18": "The second day of Lunar New Year",
        "2026-02-19": "The third day of Lunar New Year",
        "2026-04-03": "Good Friday",
        "2026-04-04": "The day following Good Friday",
        "2026-04-06": "The day following Ching Ming Festival",
        "2026-04-07": "The day following Easter Monday",
        "2026-05-01": "Labour Day",
        "2026-05-25": "The day following the Birthday of the Buddha",
        "2026-06-19": "Tuen Ng Festival",
        "2026-07-01": "Hong Kong Special Administrative Region Establishment Day",
        "2026-09-26": "The day following the Chinese Mid-Autumn Festival",
        "2026-10-01": "National Day",
        "2026-10-19": "The day following Chung Yeung Festival",
        "2026-12-25": "Christmas Day",
        "2026-12-26": "The first weekday after Christmas Day",
    },
}
# Travel expos as (name, kind, first day, last day).
TRAVEL_EXPOS = (
    ("Hong Kong Holiday and Travel Expo 2024", "holiday_travel_expo", "2024-02-22", "2024-02-25"),
    ("ITE Hong Kong 2024", "ite_hong_kong", "2024-06-13", "2024-06-16"),
    ("Hong Kong Holiday & Travel Expo 2024 Autumn", "holiday_travel_expo_autumn", "2024-09-27", "2024-09-29"),
    ("Hong Kong Holiday and Travel Expo 2025", "holiday_travel_expo", "2025-02-20", "2025-02-23"),
    ("ITE Hong Kong 2025", "ite_hong_kong", "2025-06-12", "2025-06-15"),
    ("Hong Kong Holiday & Travel Expo 2025 Autumn", "holiday_travel_expo_autumn", "2025-09-25", "2025-09-28"),
    ("Hong Kong Holiday & Travel Expo 2026", "holiday_travel_expo", "2026-01-29", "2026-02-01"),
    ("ITE Hong Kong 2026", "ite_hong_kong", "2026-06-11", "2026-06-14"),
)
HOLIDAY_REACH = 3
EXPO_REACH = 7

FLAGS = ("is_public_holiday", "is_near_public_holiday", "is_travel_expo", "is_near_travel_expo")

_FILE_SCHEMA = (
    "public_holidays array<struct<year:int,source_name:string,source_url:string,"
    "events:array<struct<date:string,name:string>>>>,"
    "travel_expos array<struct<name:string,event_type:string,start_date:string,end_date:string,"
    "venue:string,source_name:string,source_url:string>>"
)


def load_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Holidays and expos of a nested calendar file, expos expanded to one row per day."""
    raw = spark.read.schema(_FILE_SCHEMA).json(path, multiLine=True)
    years = raw.select(F.explode("public_holidays").alias("y"))
    holidays = years.select("y.year", F.explode("y.events").alias("e")).select(
        F.to_date("e.date").alias("date"), "e.name", "year"
    )
    expos = raw.select(F.explode("travel_expos").alias("x")).select("x.*")
    return holidays, expand_expos(expos)


def expand_expos(expos: DataFrame) -> DataFrame:
    """One row per expo day; a range that ends before it starts is an error."""
    start, end = F.to_date("start_date"), F.to_date("end_date")
    checked = F.when(end < start, F.raise_error(F.concat(F.lit("expo ends before it starts: "), "name"))).otherwise(
        F.sequence(start, end)
    )
    return expos.select(F.explode(checked.cast("array<date>")).alias("date"), "name", "event_type")


def default_calendar(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(d, n, y) for y, block in PUBLIC_HOLIDAYS.items() for d, n in block.items()]
    holidays = spark.createDataFrame(rows, "date string, name string, year int").withColumn("date", F.to_date("date"))
    expos = spark.createDataFrame(list(TRAVEL_EXPOS), "name string, event_type string, start_date string, end_date string")
    return holidays, expand_expos(expos)


def recurring_calendar(days: DataFrame, day: str, holidays: list[str], expos: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The same ``MM-dd`` events in every year that ``days`` spans."""
    span = days.agg(F.min(F.year(day)).alias("a"), F.max(F.year(day)).alias("b"))
    years = span.select(F.explode(F.sequence("a", "b")).alias("year"))

    def on(text: Column) -> Column:
        return F.to_date(F.concat_ws("-", F.col("year").cast("string"), text))

    listed = F.explode(F.array(*[F.lit(h) for h in holidays]))
    holiday_rows = years.select("year", listed.alias("md")).select(on(F.col("md")).alias("date"), F.col("md").alias("name"), "year")
    ranges = F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in expos]))
    expo_rows = years.select("year", ranges.alias("r")).select(
        F.explode(F.sequence(on(F.col("r.s")), on(F.col("r.e")))).alias("date"),
        F.concat_ws(" ", F.col("r.s"), F.col("year").cast("string")).alias("name"),
        F.lit("expo").alias("event_type"),
    )
    return holiday_rows, expo_rows


def event_days(events: DataFrame, reach: int, on_day: str, near_day: str) -> DataFrame:
    """Event days and the days within ``reach`` of one that are not event days themselves."""
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = events.select("date").distinct().select("date", offset.alias("_o")).select(
        F.date_add("date", F.col("_o")).alias("date"), (F.col("_o") == 0).cast("int").alias("_hit")
    )
    return spread.groupBy("date").agg(F.max("_hit").alias(on_day), (1 - F.max("_hit")).alias(near_day))


def day_flags(calendar: tuple[DataFrame, DataFrame], holiday_reach: int = HOLIDAY_REACH, expo_reach: int = EXPO_REACH) -> DataFrame:
    """One row per day touched by an event, with the four flags. Bounded by the calendar."""
    holidays, expos = calendar
    a = event_days(holidays, holiday_reach, FLAGS[0], FLAGS[1])
    b = event_days(expos, expo_reach, FLAGS[2], FLAGS[3])
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("date").agg(*[F.coalesce(F.max(f), F.lit(0)).alias(f) for f in FLAGS])


def with_day_flags(df: DataFrame, day: str, flags: DataFrame) -> DataFrame:
    named = flags.withColumnRenamed("date", "_flag_day")
    joined = df.join(named, F.col(day) == F.col("_flag_day"), "left").drop("_flag_day")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in FLAGS})


def calendar_features(df: DataFrame, day: str, flags: DataFrame) -> DataFrame:
    """Fourteen day features next to the existing columns."""
    d = F.col(day)
    left = days_to_month_end(d)
    plain = df.withColumns(
        {
            "weekday": F.weekday(d),
            "is_weekend": is_weekend(d).cast("int"),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "day_of_month": F.dayofmonth(d),
            "days_to_month_end": left,
            "is_month_start_window": (F.dayofmonth(d) <= 3).cast("int"),
            "is_month_mid_window": F.dayofmonth(d).between(14, 16).cast("int"),
            "is_month_end_window": (left <= 3).cast("int"),
        }
    )
    flagged = with_day_flags(plain, day, flags)
    return flagged.withColumn(
        "is_business_day", ((F.col("is_weekend") == 0) & (F.col("is_public_holiday") == 0)).cast("int")
    )


FEATURES = (
    "weekday",
    "is_weekend",
    "month",
    "quarter",
    "day_of_month",
    "days_to_month_end",
    "is_month_start_window",
    "is_month_mid_window",
    "is_month_end_window",
    *FLAGS,
    "is_business_day",
)


def calendar_year_summary(calendar: tuple[DataFrame, DataFrame]) -> DataFrame:
    holidays, expos = calendar
    rows = holidays.select(F.year("date").alias("year"), F.col("date").alias("h")).unionByName(
        expos.select(F.year("date").alias("year"), F.col("date").alias("x"), F.col("name").alias("n")), allowMissingColumns=True
    )
    return rows.groupBy("year").agg(
        F.countDistinct("h").alias("public_holiday_days"),
        F.countDistinct("x").alias("travel_expo_days"),
        F.countDistinct("n").alias("travel_expo_events"),
    )

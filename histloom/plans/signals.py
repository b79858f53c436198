"""Daily news signals: extraction, seven-day means, and vectors joined to users by date.

Every table keyed by day has one row per calendar day, a few ten thousand for a century, so
Spark measures them as small and broadcasts them. Window means are taken once per distinct date, not once per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.times import days_around
from histloom.functions.vectors import flat_prior, signal_vector

SIGNALS = list(K.SIGNAL_CODES)


def needed_dates(users: DataFrame, date: str = "date", days: int = K.WINDOW_DAYS) -> DataFrame:
    """The distinct days within `days` of any user date."""
    dates = users.select(date).distinct()
    return dates.select(F.explode(days_around(F.col(date), days)).alias("day")).distinct()


def missing_dates(needed: DataFrame, held: DataFrame, day: str = "day") -> DataFrame:
    """Needed days that are not held yet."""
    return needed.select(day).distinct().join(held.select(day).distinct(), day, "left_anti")


def usable_news(news: DataFrame) -> DataFrame:
    """News rows of the wanted place that have signals."""
    return news.filter(F.col("V2Locations").contains(K.LOCATION_MARK) & F.col("GCAM").isNotNull())


def news_of_days(news: DataFrame, days: DataFrame) -> DataFrame:
    """Usable news rows of the given days. With `day` as partition column, Spark also prunes the
    files to read by the days."""
    return usable_news(news).join(days, "day", "left_semi")


def extracted(news: DataFrame) -> DataFrame:
    """One column per signal, read from the coded text; null where absent or no number."""

    def value(code: str):
        found = F.regexp_extract("GCAM", code.replace(".", r"\.") + ":([0-9.]+)", 1)
        return found.try_cast("double")

    return news.select("day", *[value(code).alias(name) for name, code in K.SIGNAL_CODES.items()])


def daily_signals(news: DataFrame) -> DataFrame:
    """The daily mean of every signal."""
    return extracted(news).groupBy("day").agg(*[F.avg(s).alias(s) for s in SIGNALS])


def window_sums(
    dates: DataFrame, per_day: DataFrame, columns: list[str], date: str = "date", days: int = K.WINDOW_DAYS
) -> DataFrame:
    """For every distinct date with a row of `per_day` within `days` of it: `date` and, by column,
    sum_<column> and n_<column>, over the values there that are not null.

    Running sums over the days are read at two places per date, after its window and before it,
    so the work does not depend on the width. `per_day` has one row per calendar day, so the
    sums run over a few ten thousand rows. Sums of windows with an infinite value are infinite.
    """
    at = F.col("day").alias("_at")
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)).alias(f"v_{c}") for c in columns]
    large = [(F.col(c) == float("inf")).cast("long").alias(f"x_{c}") for c in columns]
    rows = per_day.filter("day is not null").select(at, F.lit(0).alias("_end"), F.lit(None).alias(date), *finite, *large)
    ends = F.explode(F.array(F.struct(F.date_add(date, days).alias("at"), F.lit(2).alias("end")),
                             F.struct(F.date_sub(date, days + 1).alias("at"), F.lit(1).alias("end"))))
    marks = dates.select(date).distinct().filter(F.col(date).isNotNull()).select(F.col(date), ends.alias("_e"))
    marks = marks.select(F.col("_e.at").alias("_at"), F.col("_e.end").alias("_end"), date)
    so_far = Window.orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [F.sum((F.col("_end") == 0).cast("long")).over(so_far).alias("_days")]
    for c in columns:
        running += [
            F.sum(f"v_{c}").over(so_far).alias(f"s_{c}"), F.count(f"v_{c}").over(so_far).alias(f"n_{c}"),
            F.sum(f"x_{c}").over(so_far).alias(f"x_{c}"),
        ]
    found = rows.unionByName(marks, allowMissingColumns=True).select(date, "_end", *running).filter(F.col("_end") > 0)

    def inside(name: str):
        """The running value after the window minus that before it."""
        last, first = (F.max(F.when(F.col("_end") == end, F.col(name))) for end in (2, 1))
        return last - F.coalesce(first, F.lit(0))

    sums = []
    for c in columns:
        some, many = inside(f"n_{c}"), F.coalesce(inside(f"x_{c}"), F.lit(0))
        total = F.when(many > 0, float("inf")).when(some > 0, inside(f"s_{c}"))
        sums += [total.alias(f"sum_{c}"), (some + many).alias(f"n_{c}")]
    return found.groupBy(date).agg(inside("_days").alias("_days"), *sums).filter("_days > 0").drop("_days")


def window_rows(
    users: DataFrame, daily: DataFrame, date: str = "date", days: int = K.WINDOW_DAYS
) -> DataFrame:
    """Every user row with each daily row within `days` of its date; missing days give no row."""
    near = users.withColumn("day", F.explode(days_around(F.col(date), days)))
    return near.join(daily, "day")


def mean_of_daily_means(
    dates: DataFrame, daily: DataFrame, date: str = "date", days: int = K.WINDOW_DAYS
) -> DataFrame:
    """Per distinct date the mean of the daily means around it: every day has the same weight."""
    found = window_sums(dates, daily, SIGNALS, date, days)
    return found.select(date, *[F.try_divide(f"sum_{s}", f"n_{s}").alias(s) for s in SIGNALS])


def mean_of_rows(
    dates: DataFrame, news: DataFrame, date: str = "date", days: int = K.WINDOW_DAYS
) -> DataFrame:
    """Per distinct date the mean over the news rows around it: days weigh by their rows.

    Rows are summed and counted per day first, so that a news row is read once, not once for
    every date whose window it falls in.
    """
    sums = [F.sum(s).alias(f"rows_{s}") for s in SIGNALS]
    counts = [F.count(s).cast("double").alias(f"count_{s}") for s in SIGNALS]
    per_day = extracted(news).groupBy("day").agg(*sums, *counts)
    columns = [c for s in SIGNALS for c in (f"rows_{s}", f"count_{s}")]
    found = window_sums(dates, per_day, columns, date, days)
    return found.select(date, *[F.try_divide(f"sum_rows_{s}", f"sum_count_{s}").alias(s) for s in SIGNALS])


def date_vectors(signals: DataFrame, date: str = "day") -> DataFrame:
    """The value vector of every date that has news; null where all signals are 0."""
    return signals.select(F.col(date).alias("date"), signal_vector().alias("vector"))


def newest(rows: DataFrame, key: str = "date", version: str = "version") -> DataFrame:
    """One row per key with its vector: that of the highest version, if rows have one. Of equal
    versions the one whose entries sort last counts, so the choice does not depend on row order."""
    entries = F.array_sort(F.map_entries("vector")).alias("entries")
    order = [F.col(version)] if version in rows.columns else []
    top = rows.groupBy(key).agg(F.max(F.struct(*order, entries)).alias("_o"))
    return top.select(key, F.map_from_entries("_o.entries").alias("vector"))


def upsert_cache(cache: DataFrame, fresh: DataFrame, key: str = "date") -> DataFrame:
    """The cache with fresh rows in place of old ones, one row per key; fresh rows without a
    vector are left out."""
    new, cache = newest(fresh.filter(F.col("vector").isNotNull()), key), newest(cache, key)
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def attach_vectors(users: DataFrame, fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """Each user with the vector of the date: fresh, else cached, else the flat prior.

    A date that was computed but has no signal gets the prior, whatever the cache holds. Of
    several rows for a date the newest counts.
    """
    new = newest(fresh).select("date", F.col("vector").alias("_fresh"), F.lit(True).alias("_known"))
    old = newest(cache).select("date", F.col("vector").alias("_cached"))
    found = F.when(F.col("_known"), F.col("_fresh")).otherwise(F.col("_cached"))
    return (
        users.join(new, "date", "left")
        .join(old, "date", "left")
        .withColumn("psych_vector", F.coalesce(found, flat_prior()))
        .drop("_fresh", "_known", "_cached")
    )


def attach_window_vectors(users: DataFrame, daily: DataFrame, date: str = "date") -> DataFrame:
    """Each user with the vector of the mean over the days around the date.

    The flat prior where the first signal is missing on all of those days; null where all
    signals are 0.
    """
    means = mean_of_daily_means(users, daily, date).filter(F.col("val_power").isNotNull())
    vectors = means.select(date, signal_vector().alias("_v"), F.lit(True).alias("_known"))
    value = F.when(F.col("_known"), F.col("_v")).otherwise(flat_prior())
    return users.join(vectors, date, "left").withColumn("psych_vector", value).drop("_v", "_known")


def updated_daily(users: DataFrame, news: DataFrame, backup: DataFrame) -> DataFrame:
    """The daily signals of the backup, and of the user dates that it lacks: only the news of
    those days is read."""
    dates = users.select(F.col("date").alias("day"))
    return backup.unionByName(daily_signals(news_of_days(news, missing_dates(dates, backup))))


def enrich_users(users: DataFrame, news: DataFrame, cache: DataFrame) -> DataFrame:
    """Exact-day enrichment: only days that the cache lacks are read from the news table."""
    dates = users.select(F.col("date").alias("day"))
    todo = missing_dates(dates, cache.select(F.col("date").alias("day")))
    fresh = date_vectors(daily_signals(news_of_days(news, todo)))
    return attach_vectors(users, fresh, cache)

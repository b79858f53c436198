"""Queries on news signals and value vectors. Events stand in for news rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import vectors as V
from histloom.functions.times import epoch_millis, history_times, millis_to_date
from histloom.operators.lookups import each
from histloom.operators.ordering import leave_last_out
from histloom.operators.skew import nest
from histloom.plans import signals as P
from histloom.queries.registry import query, table, texts


def news(spark, sf):
    """News rows from events: coded text from value and number, a location, some gaps."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    s = lambda c: c.cast("string")
    social = F.when(
        k % 4 == 0,
        F.concat(
            F.lit(",c25.4:"), s(k % 7), F.lit(",c25.6:"), s(k % 9), F.lit(",c25.10:"), s(k % 5),
            F.lit(",c25.8:"), s(k % 3), F.lit(",c25.2:"), s(k % 11),
        ),
    ).otherwise("")
    gcam = F.concat(
        F.lit("wc:125,c2.156:"), s(F.col("value")), F.lit(",c5.7:"), s(k), F.lit(",c2.152:"),
        s(k * 3 % 17), F.lit("."), s(k % 10), F.lit(",c2.17:"),
        F.when(k % 11 == 0, "1.2.3").otherwise(s(k % 13)), social, F.lit(",c5.31:"), s(k % 8),
        F.lit(",c5.46:"), s(k % 6), F.lit(",c5.10:"), s(k % 4),
    )
    us = F.col("event_type").isin("click", "view", "error")
    return texts(spark, sf, "events", "event_id", "ts", "event_type", "value", "props").select(
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") != "error", gcam).alias("GCAM"),
        F.when(us, "1#United States#US#US#39.8").otherwise("1#France#FR#FR#46.0").alias("V2Locations"),
    )


def dated_users(spark, sf):
    """Customers with a date; some dates lie outside the days that have news."""
    start = F.lit("2023-12-25").cast("date")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.date_add(start, (F.col("c_custkey") % 45).cast("int")).alias("date"),
    )


def daily(spark, sf):
    return P.daily_signals(P.usable_news(news(spark, sf)))


_K = r"regexp_extract(props, '(\d+)', 1)::INT"
NEWS_SQL = f"""
ev as (select *, ts::DATE as day, {_K} k from events), news as (
  select day, case when event_type <> 'error' then
    'wc:125,c2.156:' || "value"::VARCHAR || ',c5.7:' || k || ',c2.152:' || (k * 3 % 17) || '.' || (k % 10) || ',c2.17:' ||
    case when k % 11 = 0 then '1.2.3' else (k % 13)::VARCHAR end ||
    case when k % 4 = 0 then ',c25.4:' || (k % 7) || ',c25.6:' || (k % 9) || ',c25.10:' || (k % 5) ||
      ',c25.8:' || (k % 3) || ',c25.2:' || (k % 11) else '' end ||
    ',c5.31:' || (k % 8) || ',c5.46:' || (k % 6) || ',c5.10:' || (k % 4) end gcam,
    case when event_type in ('click', 'view', 'error') then '#US#' else '#FR#' end loc
  from ev
), signals as (
  select day, {', '.join(
      f"try_cast(regexp_extract(gcam, '{c.replace('.', chr(92) + '.')}:([0-9.]+)', 1) as double) {n}"
      for n, c in K.SIGNAL_CODES.items())}
  from news where contains(loc, '#US#') and gcam is not null
), daily as (select day, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)} from signals group by day),
users as (select c_custkey user_id, date '2023-12-25' + (c_custkey % 45)::INT as date from customer),
dates as (select distinct date from users),
win as (select date, unnest(generate_series(date - 3, date + 3, interval 1 day))::DATE as day from dates)
"""


def _rounded(names, table_name, key, digits=6):
    return f"select {key}, {', '.join(f'round({n}, {digits}) {n}' for n in names)} from {table_name}"


def _vector_ctes(source, key):
    z = {n: f"coalesce({n}, 0)" for n in K.SIGNAL_CODES}
    here = f"({z['val_security']} + {z['val_universalism']} > 0.001)"

    def social(direct, proxy):
        return f"case when {here} then {z[direct]} else {proxy} end"

    raw = {
        "POWER": z["val_power"], "ACHIEVEMENT": z["val_achievement"],
        "HEDONISM": z["val_hedonism"], "STIMULATION": z["val_stimulation"],
        "UNIVERSALISM": social("val_universalism", f"{z['backup_social']} * 0.5"),
        "BENEVOLENCE": social("val_benevolence", f"{z['backup_social']} * 0.5"),
        "TRADITION": social("val_tradition", f"{z['backup_anger']} * 0.5"),
        "CONFORMITY": social("val_conformity", f"{z['backup_anger']} * 0.8"),
        "SECURITY": social("val_security", z["backup_risk"]),
    }
    total = " + ".join(raw)
    return f"""
raws as (select {key} as date, {', '.join(f'{e} {n}' for n, e in raw.items())} from {source}),
vec as (select date, {', '.join(f'round({n} / ({total}), 3) {n}' for n in raw)} from raws where {total} <> 0)"""


VECTOR_SQL = f"{NEWS_SQL}, {_vector_ctes('daily', 'day')}"
LONG = " union all ".join(
    f"select date, {i} pos, '{n}' trait, {n} score from vec" for i, n in enumerate(K.VALUE_NAMES)
)


def vectors(spark, sf):
    return P.date_vectors(daily(spark, sf)).filter("vector is not null")


def _long(df, vector, *keys):
    rows = each(df, F.map_entries(vector), keys, item="e")
    return rows.select(*keys, F.col("e")["key"].alias("trait"), F.col("e")["value"].alias("score"))


@query("ms_to_date", "select event_id, ts::DATE as day, epoch_us(ts) // 1000 ms from events")
def ms_to_date(spark, sf):
    rows = table(spark, sf, "events").select("event_id", epoch_millis(F.col("ts")).alias("ms"))
    return rows.select("event_id", "ms", millis_to_date(F.col("ms")).alias("day"))


@query(
    "date_window_filter",
    "select event_id, ts::DATE as day from events where ts::DATE between date '2024-01-12' and date '2024-01-18'",
)
def date_window_filter(spark, sf):
    target = F.lit("2024-01-15").cast("date")
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return rows.filter(F.col("day").between(F.date_sub(target, 3), F.date_add(target, 3)))


@query(
    "contains_filter",
    f"with {NEWS_SQL} select day, count(*) n from news where contains(loc, '#US#') and gcam is not null group by day",
)
def contains_filter(spark, sf):
    return P.usable_news(news(spark, sf)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("daily_signal_avg", f"with {NEWS_SQL} {_rounded(K.SIGNAL_CODES, 'daily', 'day')}")
def daily_signal_avg(spark, sf):
    return daily(spark, sf).select("day", *[F.round(s, 6).alias(s) for s in P.SIGNALS])


@query("needed_dates", f"with {NEWS_SQL} select distinct day from win")
def needed_dates(spark, sf):
    return P.needed_dates(dated_users(spark, sf))


@query(
    "missing_dates",
    f"with {NEWS_SQL} select distinct day from win where day not in (select day from daily)",
)
def missing_dates(spark, sf):
    return P.missing_dates(P.needed_dates(dated_users(spark, sf)), daily(spark, sf))


@query(
    "window7_join",
    f"""with {NEWS_SQL} select user_id, u.date, d.day, round(val_power, 6) val_power
from users u join daily d on d.day between u.date - 3 and u.date + 3""",
)
def window7_join(spark, sf):
    rows = P.window_rows(dated_users(spark, sf), daily(spark, sf))
    return rows.select("user_id", "date", "day", F.round("val_power", 6).alias("val_power"))


@query(
    "window7_mean_of_means",
    f"""with {NEWS_SQL}, means as (
  select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)} from win join daily using (day) group by date)
select user_id, m.* from users join ({_rounded(K.SIGNAL_CODES, 'means', 'date')}) m using (date)""",
)
def window7_mean_of_means(spark, sf):
    users = dated_users(spark, sf)
    means = P.mean_of_daily_means(users, daily(spark, sf))
    return users.join(means, "date").select(
        "user_id", "date", *[F.round(s, 6).alias(s) for s in P.SIGNALS]
    )


@query(
    "window7_row_mean",
    f"""with {NEWS_SQL}, means as (
  select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)} from win join signals using (day) group by date)
{_rounded(K.SIGNAL_CODES, 'means', 'date')}""",
)
def window7_row_mean(spark, sf):
    users, rows = dated_users(spark, sf), news(spark, sf)
    means = P.mean_of_rows(users, P.news_of_days(rows, P.needed_dates(users)))
    return means.select("date", *[F.round(s, 6).alias(s) for s in P.SIGNALS])


#: A window of a year on both sides of every date.
YEAR = 365


@query(
    "window_year_mean_of_means",
    f"""with {NEWS_SQL}, means as (select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)}
  from dates join daily on day between date - {YEAR} and date + {YEAR} group by date)
{_rounded(K.SIGNAL_CODES, 'means', 'date')}""",
)
def window_year_mean_of_means(spark, sf):
    means = P.mean_of_daily_means(dated_users(spark, sf), daily(spark, sf), days=YEAR)
    return means.select("date", *[F.round(s, 6).alias(s) for s in P.SIGNALS])


@query(
    "window_year_row_mean",
    f"""with {NEWS_SQL}, means as (select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)}
  from dates join signals on day between date - {YEAR} and date + {YEAR} group by date)
{_rounded(K.SIGNAL_CODES, 'means', 'date')}""",
)
def window_year_row_mean(spark, sf):
    means = P.mean_of_rows(dated_users(spark, sf), P.usable_news(news(spark, sf)), days=YEAR)
    return means.select("date", *[F.round(s, 6).alias(s) for s in P.SIGNALS])


@query("psych_vector", f"with {VECTOR_SQL} select date, trait, score from ({LONG})")
def psych_vector(spark, sf):
    return _long(vectors(spark, sf), "vector", "date")


@query(
    "window7_vector",
    f"""with {NEWS_SQL}, means as (
  select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)} from win join daily using (day) group by date),
{_vector_ctes('means', 'date')} select date, trait, score from ({LONG})""",
)
def window7_vector(spark, sf):
    means = P.mean_of_daily_means(dated_users(spark, sf), daily(spark, sf))
    return _long(P.date_vectors(means, "date"), "vector", "date")


def cached(spark, sf):
    """A cache that holds made-up vectors for the days around the start of the news, and an older
    version of each of them."""
    days = dated_users(spark, sf).select("date").distinct().filter("date < date'2024-01-04'")
    odd = {n: 0.05 for n in K.VALUE_NAMES} | {"POWER": 0.6}
    old = V.literal_map({n: 0.9 for n in K.VALUE_NAMES})
    versions = days.select("date", F.explode(F.array(F.lit(2), F.lit(1))).alias("version"))
    return versions.withColumn("vector", F.when(F.col("version") == 2, V.literal_map(odd)).otherwise(old))


_CASCADE = f"""
long as ({LONG}), names as (select unnest({K.VALUE_NAMES!r}) trait),
cache as (select date, trait, case when trait = 'POWER' then 0.6 else 0.05 end score
          from dates, names where date < date '2024-01-04')
select user_id, u.date, n.trait, coalesce({{pick}}, 0.11)::DOUBLE score
from users u cross join names n left join long l on l.date = u.date and l.trait = n.trait
left join cache c on c.date = u.date and c.trait = n.trait"""


@query("cascade_lookup", f"with {VECTOR_SQL}, " + _CASCADE.format(pick="l.score, c.score"))
def cascade_lookup(spark, sf):
    users = P.attach_vectors(dated_users(spark, sf), vectors(spark, sf), cached(spark, sf))
    return _long(users, "psych_vector", "user_id", "date")


@query("signal_enrichment", f"with {VECTOR_SQL}, " + _CASCADE.format(pick="c.score, l.score"))
def signal_enrichment(spark, sf):
    users = P.enrich_users(dated_users(spark, sf), news(spark, sf), cached(spark, sf))
    return _long(users, "psych_vector", "user_id", "date")


@query(
    "cache_upsert",
    f"""with {VECTOR_SQL}, long as ({LONG}), names as (select unnest({K.VALUE_NAMES!r}) trait)
select date, trait, score from long union all
select date, trait, case when trait = 'POWER' then 0.6 else 0.05 end::DOUBLE from dates, names
where date < date '2024-01-04' and date not in (select date from vec)""",
)
def cache_upsert(spark, sf):
    return _long(P.upsert_cache(cached(spark, sf), vectors(spark, sf)), "vector", "date")


@query(
    "window7_users",
    f"""with {NEWS_SQL}, means as (
  select date, {', '.join(f'avg({n}) {n}' for n in K.SIGNAL_CODES)} from win join daily using (day) group by date having avg(val_power) is not null),
{_vector_ctes('means', 'date')}, long as ({LONG}), names as (select unnest({K.VALUE_NAMES!r}) trait)
select user_id, n.trait, case when m.date is null then 0.11 else l.score end::DOUBLE score from users u cross join names n
left join means m on m.date = u.date left join long l on l.date = u.date and l.trait = n.trait""",
)
def window7_users(spark, sf):
    users = P.attach_window_vectors(dated_users(spark, sf), daily(spark, sf))
    return _long(users, "psych_vector", "user_id")


@query(
    "updated_daily",
    f"""with {NEWS_SQL} select day, round(val_power, 6) val_power from daily where day in (select date from dates) or day < date '2024-01-20'""",
)
def updated_daily(spark, sf):
    backup = daily(spark, sf).filter("day < date'2024-01-20'")
    rows = P.updated_daily(dated_users(spark, sf), news(spark, sf), backup)
    return rows.select("day", F.round("val_power", 6).alias("val_power"))


def _calibrated_sql(factors):
    scaled = {n: f"{n} * {factors[n]}" for n in K.VALUE_NAMES}
    if factors is K.VALUE_MEANS:
        scaled = {n: f"{n} / {factors[n]}" for n in K.VALUE_NAMES}
    total = " + ".join(f"({e})" for e in scaled.values())
    cols = ", ".join(f"round(({e}) / ({total}), 3) {n}" for n, e in scaled.items())
    long = LONG.replace("from vec", "from cal")
    return f"with {VECTOR_SQL}, cal as (select date, {cols} from vec) select date, trait, score from ({long})"


@query("calibrate_weights", _calibrated_sql(K.VALUE_WEIGHTS))
def calibrate_weights(spark, sf):
    return _long(vectors(spark, sf), V.calibrate_by_weights(F.col("vector")), "date")


@query("calibrate_means", _calibrated_sql(K.VALUE_MEANS))
def calibrate_means(spark, sf):
    return _long(vectors(spark, sf), V.calibrate_by_means(F.col("vector")), "date")


@query(
    "top_trait",
    f"""with {VECTOR_SQL} select date, trait, score from ({LONG})
qualify row_number() over (partition by date order by score desc, pos) = 1""",
)
def top_trait(spark, sf):
    best = V.top_trait(F.col("vector"))
    return vectors(spark, sf).select("date", best["key"].alias("trait"), best["value"].alias("score"))


@query(
    "max_gap_trait",
    f"""with {VECTOR_SQL} select date, trait, round(abs(score - 0.11), 6) gap, score target from ({LONG})
qualify row_number() over (partition by date order by abs(score - 0.11) desc, pos) = 1""",
)
def max_gap_trait(spark, sf):
    rows = vectors(spark, sf).withColumn("best", V.max_gap_trait(F.col("vector"), V.flat_prior()))
    return rows.select("date", "best.trait", F.round("best.gap", 6).alias("gap"), "best.target")


@query(
    "vector_text",
    f"""with {VECTOR_SQL} select date, {" || ', ' || ".join(
        f"'{n}: ' || printf('%.2f', floor({n} * 50) / 50)" for n in K.VALUE_NAMES)} as text from vec""",
)
def vector_texts(spark, sf):
    even = F.transform_values("vector", lambda k, v: F.floor(v * 50).cast("double") / 50)
    return vectors(spark, sf).select("date", V.vector_text(even).alias("text"))


_ANSWER = "(c_custkey * 7 + {i} * 3) % 7"


def answers(spark, sf):
    """Questionnaire answers from customer numbers: 0 is no answer, every ninth item is absent."""
    user = F.col("c_custkey")
    items = [i for i in range(1, 41) if i % 9]
    given = F.map_from_arrays(
        F.array(*[F.lit(str(i)) for i in items]),
        F.array(*[((user * 7 + i * 3) % 7).cast("int") for i in items]),
    )
    return texts(spark, sf, "customer", "c_custkey").select(user.alias("user_id"), given.alias("answers"))


def _trait_sql(trait):
    items = [i for i in K.TRAIT_ITEMS[trait] if i % 9]
    given = ", ".join(f"nullif({_ANSWER.format(i=i)}, 0)" for i in items)
    return f"select c_custkey user_id, '{trait}' trait, round(coalesce(list_avg([{given}]), 0), 6) score from customer"


TRAITS_SQL = " union all ".join(_trait_sql(t) for t in K.TRAIT_ITEMS)


@query("trait_scores", TRAITS_SQL)
def trait_scores(spark, sf):
    rows = _long(answers(spark, sf), V.trait_scores(F.col("answers")), "user_id")
    return rows.withColumn("score", F.round("score", 6))


@query(
    "alignment_grade",
    f"""with {VECTOR_SQL}, tops as (select date, trait from ({LONG})
  qualify row_number() over (partition by date order by score desc, pos) = 1),
measured as ({TRAITS_SQL})
select u.user_id, case when t.trait is null then 0.5 when m.score >= 4.5 then 1.0 when m.score >= 3.5 then 0.5
  else 0.0 end::DOUBLE grade
from users u left join tops t on t.date = u.date left join measured m on m.user_id = u.user_id and m.trait = t.trait""",
)
def alignment_grades(spark, sf):
    targets = dated_users(spark, sf).join(vectors(spark, sf), "date", "left")
    measured = answers(spark, sf).select("user_id", V.trait_scores(F.col("answers")).alias("scores"))
    rows = targets.join(measured, "user_id")
    return rows.select("user_id", V.alignment_grade(F.col("vector"), F.col("scores")).alias("grade"))


@query(
    "user_timestamps",
    """
select o_custkey, epoch_ms(o_orderdate) ms from orders
where o_custkey in (select o_custkey from orders group by all having count(*) >= 2)""",
)
def user_timestamps(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", epoch_millis(F.col("o_orderdate")).alias("timestamp_ms")
    )
    roles = leave_last_out(orders, "o_custkey", "timestamp_ms", "o_orderkey")
    past = nest(
        roles.filter("role = 'history'"), ["o_custkey"], ["timestamp_ms", "o_orderkey"], ["timestamp_ms"], "history"
    )
    last = roles.filter("role = 'heldout'").select(
        "o_custkey", F.struct("timestamp_ms").alias("heldout"), F.lit(0).alias("part")
    )
    both = past.join(last, ["o_custkey", "part"], "left")
    times = history_times(F.col("history"), F.col("heldout"))
    return both.select("o_custkey", F.explode(times).alias("ms")).filter("ms is not null")

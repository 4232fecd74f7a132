"""Queries on rules of publication and schedules: editions, seeds and logs, weekly recalibration, completeness, archives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwise.functions import calendar as C
from meterwise.functions import quantiles as Q
from meterwise.functions import timekit as K
from meterwise.operators import joins as J
from meterwise.operators.recalibration import trailing_levels
from meterwise.plans.catalog import DAYS, GRID, HOURS, LEVELS_SQL, NAIVE, PITS, T, WIDE, by_type, events, forecast_events, forecasts, naives, query, r6, table, wide
from meterwise.sources import payloads as P


@query(f"WITH {NAIVE}, x AS (SELECT avg(abs(a - p)) AS m, avg(abs(a - q)) AS e, avg(abs(q - p)) AS s, avg(abs(p)) AS l FROM k) SELECT round(e - m, 6) AS delta, round(100 * (e - m) / m, 6) AS pct, round(s, 6) AS substitute_mae, round(100 * s / l, 6) AS substitute_pct FROM x")
def A26_evening_cost(spark, sf_dir):
    a, p, q = F.col("a"), F.col("p"), F.col("q")
    x = naives(spark, sf_dir).agg(F.avg(F.abs(a - p)).alias("m"), F.avg(F.abs(a - q)).alias("e"), F.avg(F.abs(q - p)).alias("s"), F.avg(F.abs(p)).alias("l"))
    return x.select(r6(F.col("e") - F.col("m")).alias("delta"), r6(100 * (F.col("e") - F.col("m")) / F.col("m")).alias("pct"), r6("s").alias("substitute_mae"), r6(100 * F.col("s") / F.col("l")).alias("substitute_pct"))


@query("SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT CAST(ts AS DATE)) >= 28 AS enough FROM events GROUP BY 1")
def A31_distinct_days(spark, sf_dir):
    n = F.count_distinct(F.to_date("ts"))
    return events(spark, sf_dir).groupBy("event_type").agg(n.alias("days"), (n >= 28).alias("enough"))


@query(f"""WITH {HOURS}, seed AS (SELECT t, v FROM h WHERE event_type = 'view' AND t < TIMESTAMP '2024-01-20' AND t >= TIMESTAMP '2024-01-10'), log AS (SELECT t, v FROM h WHERE event_type = 'click' AND t >= TIMESTAMP '2024-01-15')
SELECT {T.format('t')} AS t, round(v, 6) AS v, src FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY src DESC) AS n FROM (SELECT t, v, 0 AS src FROM seed UNION ALL SELECT t, v, 1 FROM log)) WHERE n = 1""")
def J05_seed_and_log(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"])
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    seed = h.where((F.col("event_type") == "view") & (F.col("t") < at("2024-01-20")) & (F.col("t") >= at("2024-01-10"))).select("t", "v", F.lit(0).alias("src"))
    log = h.where((F.col("event_type") == "click") & (F.col("t") >= at("2024-01-15"))).select("t", "v", F.lit(1).alias("src"))
    return K.keep_last(seed.unionByName(log), ["t"], "src").select(K.stamp("t").alias("t"), r6("v").alias("v"), "src")


@query(f"WITH {HOURS} SELECT {T.format('a.t')} AS t, round(a.v - b.v, 6) AS d FROM h a JOIN h b ON a.t = b.t WHERE a.event_type = 'click' AND b.event_type = 'view'")
def J07_common_hours(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"])
    a, b = (h.where(F.col("event_type") == k).select("t", F.col("v").alias(k)) for k in ("click", "view"))
    return a.join(b, "t").select(K.stamp("t").alias("t"), r6(F.col("click") - F.col("view")).alias("d"))


@query(f"""WITH d AS ({DAYS}) SELECT x.event_type, strftime(x.day, '%Y-%m-%d') AS day, round(a.v, 6) AS d1, round(b.v, 6) AS d2, round(c.v, 6) AS d7 FROM d x LEFT JOIN d a ON a.event_type = x.event_type AND a.day = x.day - 1 LEFT JOIN d b ON b.event_type = x.event_type AND b.day = x.day - 2 LEFT JOIN d c ON c.event_type = x.event_type AND c.day = x.day - 7""")
def J19_lagged_days(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    # consecutive days are asked for by a range frame of one day, so a missing day gives null, not its neighbour
    number = F.datediff("day", F.lit("1970-01-01"))
    back = lambda k: r6(F.first("v").over(Window.partitionBy("event_type").orderBy(number).rangeBetween(-k, -k)))
    return d.select("event_type", F.col("day").cast("string").alias("day"), back(1).alias("d1"), back(2).alias("d2"), back(7).alias("d7"))


@query(f"WITH {LEVELS_SQL}, x AS (SELECT event_type, list_sort(list_transform(q, lambda v: (v - 50) * (v - 50))) AS s FROM f) SELECT event_type, round(s[1], 6) AS low, round(s[50], 6) AS mid, round(s[99], 6) AS high FROM x")
def F02_monotone_levels(spark, sf_dir):
    s = F.array_sort(F.transform("q", lambda v: (v - 50) * (v - 50)))
    return forecasts(spark, sf_dir).select("event_type", *[r6(F.element_at(s, i)).alias(n) for i, n in ((1, "low"), (50, "mid"), (99, "high"))])


@query("SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS keys_, CAST(count(DISTINCT (l_orderkey, l_linenumber, l_shipdate, l_partkey)) AS BIGINT) AS versions FROM lineitem")
def U05_distinct_keys(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.agg(F.count("*").alias("rows_"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys_"), F.count_distinct("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey").alias("versions"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) + o_custkey % 60 AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
f AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e), g AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS m FROM f) SELECT CAST(y AS BIGINT) AS year, strftime(make_date(CAST(y AS BIGINT), CAST(m // 31 AS BIGINT), CAST(m % 31 + 1 AS BIGINT)) + 1, '%Y-%m-%d') AS easter_monday FROM g""")
def H05_easter(spark, sf_dir):
    """Easter Mondays of the years up to sixty after the orders', against another computus."""
    mondays = [(y, (C.easter(y)).toordinal() + 1) for y in range(1900, 2200)]  # a calendar
    years = table(spark, sf_dir, "orders").select((F.year("o_orderdate") + F.col("o_custkey") % 60).cast("long").alias("year")).distinct()
    x = years.join(F.broadcast(spark.createDataFrame(mondays, "year long, ordinal int")), "year")
    return x.select("year", F.date_add(F.lit("0001-01-01").cast("date"), F.col("ordinal") - 1).cast("string").alias("easter_monday"))


@query("SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) + INTERVAL 7 DAY, '%Y-%m-%d') AS next_monday FROM orders")
def H07_week_anchors(spark, sf_dir):
    day = F.to_date("o_orderdate")
    x = table(spark, sf_dir, "orders").select(day.alias("d")).distinct()
    return x.select(F.col("d").cast("string").alias("day"), F.to_date(F.date_trunc("week", "d")).cast("string").alias("monday"), F.next_day("d", "MON").cast("string").alias("next_monday"))


@query(f"""WITH {PITS}, p AS (SELECT event_type, CAST(ts AS DATE) AS d, u FROM u), s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-30', INTERVAL 7 DAY)) AS DATE) AS start), j AS (SELECT event_type, start, d, u FROM s JOIN p ON d <= start - 2 AND d > start - 16)
SELECT event_type, strftime(start, '%Y-%m-%d') AS start, count(*) AS n, count(DISTINCT d) AS days, round(quantile_cont(u, [{GRID}])[50], 6) AS tau50, round(quantile_cont(u, [{GRID}])[95], 6) AS tau95 FROM j GROUP BY 1, 2""")
def Q04_weekly_recalibration(spark, sf_dir):
    """The levels to serve from each step's start on, fitted on the fortnight to the second day before it."""
    starts = spark.sql("SELECT explode(sequence(DATE'2024-01-08', DATE'2024-01-30', INTERVAL 7 DAYS)) AS start")
    pits = forecast_events(spark, sf_dir).select("event_type", F.to_date("ts").alias("day"), Q.pit(F.col("q"), F.col("value")).alias("u"))
    asked = pits.select("event_type").distinct().crossJoin(F.broadcast(starts)).withColumnRenamed("start", "day")  # a row for each type and step
    x = trailing_levels(pits, asked, ["event_type"], window=14)
    return x.select("event_type", F.col("day").cast("string").alias("start"), "n", F.col("n_days").alias("days"), r6(F.element_at("taus", 50)).alias("tau50"), r6(F.element_at("taus", 95)).alias("tau95"))


@query(f"WITH {WIDE} SELECT strftime(CAST(t AS DATE), '%Y-%m-%d') AS day, count(click) = 24 AND count(view) = 24 AS complete, CAST(48 - count(click) - count(view) AS BIGINT) AS lacking FROM w GROUP BY CAST(t AS DATE)")
def S16_complete_snapshots(spark, sf_dir):
    """Days on which both series have every hour: only they are archived."""
    x = wide(spark, sf_dir).groupBy(F.to_date("t").alias("d")).agg(F.count("click").alias("a"), F.count("view").alias("b"))
    return x.select(F.col("d").cast("string").alias("day"), ((F.col("a") == 24) & (F.col("b") == 24)).alias("complete"), (48 - F.col("a") - F.col("b")).alias("lacking"))


@query("WITH done AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' AND user_id = 5), x AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-28' GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, n FROM x WHERE day NOT IN (SELECT day FROM done)")
def S14_open_days(spark, sf_dir):
    """Complete past days that are not archived yet."""
    e = events(spark, sf_dir).withColumnRenamed("ts", "t")
    done = e.where("event_type = 'signup' and user_id = 5").select(F.to_date("t").alias("day")).distinct()
    return P.past_days(e, F.lit("2024-01-28").cast("date"), done).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1")
def S26_log_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"WITH {HOURS}, x AS (SELECT CAST(t AS DATE) AS day, event_type, count(v) AS n, avg(v) AS v FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_type) AS k FROM x WHERE n = 24) SELECT strftime(day, '%Y-%m-%d') AS day, event_type AS run, round(v, 6) AS v FROM r WHERE k = 1 ORDER BY day DESC LIMIT 60")
def S32_history_backfill(spark, sf_dir):
    """The last sixty days with the first run that covers each."""
    x = by_type(spark, sf_dir).groupBy(F.to_date("t").alias("day"), "event_type").agg(F.count("v").alias("n"), F.avg("v").alias("v")).where("n = 24")
    kept = K.keep_first(x, ["day"], "event_type").orderBy(F.desc("day")).limit(60)
    return kept.select(F.col("day").cast("string").alias("day"), F.col("event_type").alias("run"), r6("v").alias("v"))


@query(f"WITH {WIDE}, x AS (SELECT date_trunc('hour', t) AS h, t, click AS v FROM w), q AS (SELECT t + to_minutes(15 * k) AS t, v FROM x, (SELECT unnest(range(4)) AS k)) SELECT {T.format('q.t')} AS t, round(q.v, 6) AS v FROM q WHERE v IS NOT NULL")
def J15_hour_to_quarters(spark, sf_dir):
    """Every quarter takes its hour's value."""
    h = wide(spark, sf_dir).where("click is not null").select("t", F.col("click").alias("v"))
    quarters = h.select(F.explode(F.sequence("t", F.col("t") + F.expr("INTERVAL 45 MINUTES"), F.expr("INTERVAL 15 MINUTES"))).alias("q"))
    out = quarters.withColumn("t", K.trunc("hour", "q")).join(h, "t")
    return out.select(K.stamp("q").alias("t"), r6("v").alias("v"))


@query(f"WITH {HOURS}, o AS (SELECT t, v FROM h WHERE event_type = 'error'), p AS (SELECT t, v FROM h WHERE event_type = 'purchase') SELECT {T.format('coalesce(o.t, p.t)')} AS t, round(coalesce(o.v, p.v), 6) AS v, CAST(CASE WHEN o.v IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS rung FROM o FULL JOIN p ON o.t = p.t")
def J04_priority_union(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"])
    a, b = (h.where(F.col("event_type") == k).select("t", "v") for k in ("error", "purchase"))
    return J.ladder([a, b], ["t"], "v").select(K.stamp("t").alias("t"), r6("v").alias("v"), "rung")

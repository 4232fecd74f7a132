"""Further queries: weather, provenance, decisions, group transforms, schedules, documents, streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwise.functions import calendar as C
from meterwise.functions import timekit as K
from meterwise.operators import joins as J
from meterwise.operators import metrics as M
from meterwise.operators import weather as Wx
from meterwise.plans import feature_table, site
from meterwise.plans.catalog import ALL, HOLIDAYS, HOURS, LEVELS_SQL, NAIVE, QUARTERS, T, WIDE, by_type, events, forecasts, holidays_sql, naives, quarters, query, r6, table, total, wide
from meterwise.sources.tables import scratch

MEMBERS = """m AS (SELECT date_trunc('day', ts) AS run_time, date_trunc('hour', ts) AS valid_time, CAST(user_id % 5 AS BIGINT) AS member, CAST(user_id % 3 AS DOUBLE) AS cell_lat, CAST(user_id % 2 AS DOUBLE) AS cell_lon, event_type AS variable, avg(value) AS value FROM events GROUP BY 1, 2, 3, 4, 5, 6)"""


def ensemble(spark, sf_dir):
    """Events as an ensemble: users stand for members and cells, types for variables."""
    e = events(spark, sf_dir)
    return e.groupBy(
        K.trunc("day", "ts").alias("run_time"), K.trunc("hour", "ts").alias("valid_time"), (F.col("user_id") % 5).alias("member"), (F.col("user_id") % 3).cast("double").alias("cell_lat"),
        (F.col("user_id") % 2).cast("double").alias("cell_lon"), F.col("event_type").alias("variable"),
    ).agg(F.avg("value").alias("value"))


@query(f"""WITH {MEMBERS}, s AS (SELECT run_time, valid_time, cell_lat, cell_lon, member, max(value) FILTER (WHERE variable = 'click') AS u, max(value) FILTER (WHERE variable = 'view') AS v FROM m GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT run_time, valid_time, CASE WHEN cell_lat >= 1 THEN 'north' END AS a, CASE WHEN cell_lon < 1 THEN 'west' END AS b, member, sqrt(u * u + v * v) AS value FROM s WHERE u IS NOT NULL AND v IS NOT NULL),
g AS (SELECT run_time, valid_time, a AS g, member, value FROM x WHERE a IS NOT NULL UNION ALL SELECT run_time, valid_time, b, member, value FROM x WHERE b IS NOT NULL), p AS (SELECT run_time, valid_time, g, member, avg(value) AS v FROM g GROUP BY 1, 2, 3, 4)
SELECT {T.format('valid_time')} AS t, g AS grp, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.9), 6) AS q90 FROM p GROUP BY run_time, valid_time, g""")
def P06_wind_groups(spark, sf_dir):
    speed = Wx.wind_speed(ensemble(spark, sf_dir), "click", "view", "speed")
    x = Wx.group_stats(speed, {"north": F.col("cell_lat") >= 1, "west": F.col("cell_lon") < 1})
    return x.select(K.stamp("valid_time").alias("t"), F.col("group").alias("grp"), *[r6(c).alias(c) for c in ("mean", "q10", "q90")])


@query("SELECT CAST(floor(c_acctbal / 1000) AS DOUBLE) AS cell_lat, CAST(floor(c_nationkey / 5.0) AS DOUBLE) AS cell_lon, count(*) AS n, round(avg(c_acctbal), 4) AS value FROM customer WHERE c_acctbal / 1000 >= 0 AND c_acctbal / 1000 < 8 AND c_nationkey / 5.0 >= 1 AND c_nationkey / 5.0 < 4 GROUP BY 1, 2")
def P07_cells(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("lat"), (F.col("c_nationkey") / 5.0).alias("lon"), "c_acctbal")
    return Wx.in_cells(x, "lat", "lon", (0.0, 8.0, 1.0, 4.0)).groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("value"))


@query(f"WITH {MEMBERS}, h AS (SELECT run_time, list_sort(list(DISTINCT variable)) AS have FROM m WHERE hour(valid_time) = 3 GROUP BY 1) SELECT {T.format('run_time')} AS run_time, CAST(5 - len(have) AS BIGINT) AS n_missing FROM h")
def P09_required_variables(spark, sf_dir):
    x = Wx.missing_variables(ensemble(spark, sf_dir).where(F.hour("valid_time") == 3), ["click", "error", "purchase", "signup", "view"])
    return x.select(K.stamp("run_time").alias("run_time"), F.size("missing").cast("long").alias("n_missing"))


@query(f"WITH {WIDE} SELECT {T.format('t')} AS t, round(CASE WHEN view > 0 THEN click / view END, 6) AS cf FROM w")
def P12_capacity_factor(spark, sf_dir):
    from meterwise.models.trees import capacity_factor

    return capacity_factor(wide(spark, sf_dir), "click", "view").select(K.stamp("t").alias("t"), r6("cf").alias("cf"))


@query("SELECT CAST(count(DISTINCT l_returnflag) > 1 AS BOOLEAN) AS keep_flag, CAST(count(DISTINCT CASE WHEN l_quantity > 0 THEN 1 END) > 1 AS BOOLEAN) AS keep_const FROM lineitem")
def P18_zero_variance(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg((F.count_distinct("l_returnflag") > 1).alias("keep_flag"), (F.count_distinct(F.when(F.col("l_quantity") > 0, 1)) > 1).alias("keep_const"))


@query(f"WITH {HOURS} SELECT {T.format('coalesce(a.t, b.t, c.t)')} AS t, round(a.v, 6) AS click, round(b.v, 6) AS view, round(c.v, 6) AS signup FROM (SELECT * FROM h WHERE event_type = 'click') a FULL JOIN (SELECT * FROM h WHERE event_type = 'view') b ON a.t = b.t FULL JOIN (SELECT * FROM h WHERE event_type = 'signup') c ON c.t = coalesce(a.t, b.t)")
def J06_multi_outer(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"])
    parts = [h.where(F.col("event_type") == k).select("t", F.col("v").alias(k)) for k in ("click", "view", "signup")]
    return J.full_outer(parts, ["t"]).select(K.stamp("t").alias("t"), *[r6(k).alias(k) for k in ("click", "view", "signup")])


@query("""WITH nets AS (SELECT l_orderkey AS day, max(l_linenumber) AS g FROM lineitem GROUP BY 1), mix AS (SELECT l_orderkey AS day, l_linenumber AS g, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) SELECT mix.day, CAST(mix.g AS BIGINT) AS g, n FROM mix JOIN nets ON mix.day = nets.day AND mix.g = nets.g WHERE n = 1""")
def J20_provenance(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("day"), F.col("l_linenumber").cast("long").alias("g"), "l_returnflag")
    nets = x.groupBy("day").agg(F.max("g").alias("g"))
    mix = x.where("l_returnflag <> 'N'").groupBy("day", "g").agg(F.count("*").alias("n"))
    return mix.join(nets, ["day", "g"]).where("n = 1").select("day", "g", "n")


@query(f"WITH {HOURS}, x AS (SELECT event_type, CAST(t AS DATE) AS day, count(v) AS n FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_type) AS k FROM x WHERE n = 24) SELECT strftime(day, '%Y-%m-%d') AS day, event_type FROM r WHERE k = 1")
def J21_first_covering_run(spark, sf_dir):
    x = by_type(spark, sf_dir).groupBy("event_type", F.to_date("t").alias("day")).agg(F.count("v").alias("n")).where("n = 24")
    return K.keep_first(x, ["day"], "event_type").select(F.col("day").cast("string").alias("day"), "event_type")


@query(f"WITH {NAIVE} SELECT count(*) AS n, round(avg(abs(a - p)), 6) AS mae_p, round(avg(abs(a - q)), 6) AS mae_q, round(avg(abs(a - q)) - avg(abs(a - p)), 6) AS delta FROM k WHERE CAST(t AS DATE) IN (SELECT CAST(t AS DATE) FROM k GROUP BY 1 HAVING count(*) = 24)")
def A19_compare(spark, sf_dir):
    x = K.whole_days(naives(spark, sf_dir), [], ["a", "p", "q"])
    p, q = (F.avg(F.abs(F.col("a") - F.col(c))) for c in ("p", "q"))
    return x.agg(F.count("*").alias("n"), r6(p).alias("mae_p"), r6(q).alias("mae_q"), r6(q - p).alias("delta"))


@query(f"""WITH {LEVELS_SQL}, {HOURS}, x AS (SELECT d.event_type, CAST(t AS DATE) AS day, v, q FROM d JOIN f ON f.event_type = d.event_type) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(v) AS n, round(avg(abs(v - q[50])), 6) AS mae, round(avg(CASE WHEN v IS NOT NULL THEN CASE WHEN v BETWEEN q[10] AND q[90] THEN 1.0 ELSE 0.0 END END), 6) AS cov80 FROM x GROUP BY 1, 2""")
def A23_day_scores(spark, sf_dir):
    x = by_type(spark, sf_dir).join(F.broadcast(forecasts(spark, sf_dir)), "event_type").withColumnRenamed("event_type", "kind")
    got = M.day_scores(x, "q", "v")
    return got.select(F.col("kind").alias("event_type"), F.col("day").cast("string").alias("day"), "n", r6("mae_median").alias("mae"), r6("cov80").alias("cov80"))


@query(f"WITH {QUARTERS}, m AS (SELECT *, avg(v) OVER (PARTITION BY date_trunc('hour', t)) AS m, count(*) OVER (PARTITION BY date_trunc('hour', t)) AS n, CAST(minute(t) // 15 AS BIGINT) AS qidx FROM q), s AS (SELECT qidx, avg(v - m) AS shape FROM m WHERE n = 4 GROUP BY 1) SELECT count(*) AS n, round(avg(abs(v - m)), 6) AS flat, round(avg(abs(v - m - (shape - (SELECT avg(shape) FROM s)))), 6) AS shaped FROM m JOIN s USING (qidx) WHERE n = 4")
def A25_replay_quarters(spark, sf_dir):
    w = Window.partitionBy(K.trunc("hour", "t"))
    x = quarters(spark, sf_dir).withColumn("m", F.avg("v").over(w)).withColumn("n", F.count("*").over(w)).where("n = 4").withColumn("qidx", F.floor(F.minute("t") / 15))
    shape = x.groupBy("qidx").agg(F.avg(F.col("v") - F.col("m")).alias("shape"))  # four rows
    centred = shape.join(F.broadcast(shape.agg(F.avg("shape").alias("mid")))).select("qidx", (F.col("shape") - F.col("mid")).alias("shape"))
    x = x.join(F.broadcast(centred), "qidx")
    dev = F.col("v") - F.col("m")
    return x.agg(F.count("*").alias("n"), r6(F.avg(F.abs(dev))).alias("flat"), r6(F.avg(F.abs(dev - F.col("shape")))).alias("shaped"))


@query("SELECT user_id, CAST(bool_or(coalesce(CASE WHEN event_type = 'error' THEN value > 90 END, FALSE)) AS BOOLEAN) AS bad, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def A32_flags_and_first(spark, sf_dir):
    late = F.coalesce(F.when(F.col("event_type") == "error", F.col("value") > 90), F.lit(False))
    return events(spark, sf_dir).groupBy("user_id").agg(F.bool_or(late).alias("bad"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query(f"WITH {HOURS} SELECT x.event_type, {T.format('x.t')} AS t, round(y.v, 6) AS lag24, round(z.v, 6) AS lag168 FROM h x LEFT JOIN h y ON y.event_type = x.event_type AND y.t = x.t - INTERVAL 24 HOUR LEFT JOIN h z ON z.event_type = x.event_type AND z.t = x.t - INTERVAL 168 HOUR")
def W02_time_lags(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"])
    x = K.time_lag(h, {"v": "lag24"}, "24 HOURS", ["event_type"]).drop("v")
    y = K.time_lag(h, {"v": "lag168"}, "168 HOURS", ["event_type"]).drop("v")
    return x.join(y, ["event_type", "t"]).select("event_type", K.stamp("t").alias("t"), r6("lag24").alias("lag24"), r6("lag168").alias("lag168"))


@query(f"WITH {HOURS}, x AS (SELECT event_type, CAST(t AS DATE) AS day, count(v) AS n FROM d GROUP BY 1, 2), y AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM x) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, before, n FROM y WHERE n <> before")
def W14_change_points(spark, sf_dir):
    x = by_type(spark, sf_dir).groupBy("event_type", F.to_date("t").alias("day")).agg(F.count("v").alias("n"))
    x = x.withColumn("before", F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).where("n <> before")
    return x.select("event_type", F.col("day").cast("string").alias("day"), "before", "n")


@query(f"""WITH z(day, share) AS (VALUES {holidays_sql(1990, 2030)}), d AS (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP), CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM orders), o AS (SELECT d.day, isodow(d.day) >= 6 AS weekend, z.day IS NOT NULL AS holiday FROM d LEFT JOIN z ON z.day = d.day AND z.share = 1),
f AS (SELECT *, weekend OR holiday AS off_, coalesce(lag(weekend OR holiday) OVER (ORDER BY day), FALSE) AS off_before, coalesce(lead(weekend OR holiday) OVER (ORDER BY day), FALSE) AS off_after FROM o) SELECT strftime(day, '%Y-%m-%d') AS day, weekend, holiday, off_before, off_after, NOT off_ AND off_before AND off_after AS bridge FROM f""")
def W17_bridge_days(spark, sf_dir):
    """Every day of the years of orders."""
    span = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))  # one row
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    x = C.bridge_flags(days, C.holiday_table(spark, 1990, 2030))
    return x.select(F.col("day").cast("string").alias("day"), "weekend", "holiday", "off_before", "off_after", "bridge")


@query("SELECT l_orderkey, l_linenumber, strftime(min(l_shipdate) OVER (PARTITION BY l_orderkey), '%Y-%m-%d') AS begins FROM lineitem")
def W19_document_start(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.to_date(F.min("l_shipdate").over(Window.partitionBy("l_orderkey"))).cast("string").alias("begins"))


@query("""WITH r AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-30', INTERVAL 7 DAY)) AS DATE) AS refit), d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, strftime(refit, '%Y-%m-%d') AS refit, count(*) AS n_days, round(avg(v), 6) AS level FROM d JOIN r ON day <= refit - 2 AND day > refit - 16 GROUP BY 1, 2""")
def W21_refit_schedule(spark, sf_dir):
    refits = spark.sql("SELECT explode(sequence(DATE'2024-01-10', DATE'2024-01-30', INTERVAL 7 DAYS)) AS refit")
    asked = refits.select("refit", F.explode(F.sequence(F.lit(2), F.lit(15))).alias("k")).select("refit", F.date_sub("refit", F.col("k")).alias("day"))
    d = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return d.join(F.broadcast(asked), "day").groupBy("event_type", F.col("refit").cast("string").alias("refit")).agg(F.count("*").alias("n_days"), r6(F.avg("v")).alias("level"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'publish' WHEN coalesce(CASE WHEN user_id % 4 = 1 THEN TRUE WHEN user_id % 4 = 2 THEN FALSE END, FALSE) AND event_type <> 'view' THEN CASE WHEN hour(ts) < 12 THEN 'replace' ELSE 'keep-late' END ELSE 'keep' END AS action FROM events""")
def H10_edition_action(spark, sf_dir):
    k = F.col("user_id") % 4
    standing = F.when(k == 1, True).when(k == 2, False)
    return events(spark, sf_dir).select("event_id", site.edition_action(k != 0, standing, F.when(F.col("event_type") == "view", True), F.hour("ts") < 12).alias("action"))


@query(f"WITH {WIDE} SELECT {T.format('t')} AS t, concat_ws('+', CASE WHEN click IS NULL THEN 'click' END, CASE WHEN view IS NULL THEN 'view' END, CASE WHEN signup IS NULL THEN 'signup' END) AS missing, round(1 / (1 + exp(-coalesce(click, 0) / 100)), 6) AS w, round(asinh(click / 10), 6) AS scaled, CAST(isodow(t) = 1 AS INT) AS monday FROM w")
def H11_labels_and_scales(spark, sf_dir):
    x = wide(spark, sf_dir)
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("click", "view", "signup")])), "+")
    dummies = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == F.weekday("t")).cast("int"))
    return x.select(K.stamp("t").alias("t"), gone.alias("missing"), r6(1 / (1 + F.exp(-F.coalesce("click", F.lit(0.0)) / 100))).alias("w"), r6(F.asinh(F.col("click") / 10)).alias("scaled"), F.element_at(dummies, 1).alias("monday"))


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, strftime(timezone('UTC', timezone('Europe/Berlin', CAST(day AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S') AS origin, CAST(datediff('hour', timezone('UTC', timezone('Europe/Berlin', CAST(day AS TIMESTAMP))), timezone('UTC', timezone('Europe/Berlin', CAST(day + 1 AS TIMESTAMP)))) AS BIGINT) AS hours FROM d")
def H08_local_midnight(spark, sf_dir):
    """Of each day of orders the local midnight and how many hours follow it."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select(F.col("day").cast("string").alias("day"), K.stamp(C.to_utc(F.col("day").cast("timestamp_ntz"))).alias("origin"), C.day_length(F.col("day")).cast("long").alias("hours"))


@query(f"""WITH {WIDE}, p AS (SELECT t, coalesce(purchase, signup) AS price, CAST(CASE WHEN purchase IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS price_rung FROM w WHERE coalesce(purchase, signup) IS NOT NULL),
u AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 2 DAY AS t, avg(value) AS gas FROM events WHERE event_type = 'error' GROUP BY 1), x AS (SELECT p.t, price, price_rung, coalesce(view, click) AS load, error AS wind, view - NULL AS nothing FROM p JOIN w USING (t))
SELECT {T.format('x.t')} AS t, round(price, 6) AS price, price_rung, round(load, 6) AS load, round(load - wind, 6) AS residual_load, round(gas, 6) AS gas FROM x ASOF LEFT JOIN u ON x.t >= u.t""")
def M22_feature_table(spark, sf_dir):
    w = wide(spark, sf_dir)
    one = lambda c: w.select("t", F.col(c).alias("v"))
    fuels = events(spark, sf_dir).where("event_type = 'error'").groupBy(K.trunc("day", "ts").alias("t")).agg(F.avg("value").alias("gas"))
    x, _ = feature_table.build([one("purchase"), one("signup")], {"load": [one("view"), one("click")], "wind": [one("error")]}, ["wind"], "load", fuels, ["gas"])
    return x.select(K.stamp("t").alias("t"), r6("price").alias("price"), "price_rung", *[r6(c).alias(c) for c in ("load", "residual_load", "gas")])


@query(f"WITH {HOURS} SELECT strftime(CAST(t AS DATE), '%Y-%m-%d') AS day, count(*) AS hours FROM h WHERE event_type = 'click' GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def S31_day_documents(spark, sf_dir):
    h = K.mean_by(events(spark, sf_dir), "hour", "value", ["event_type"]).where("event_type = 'click'").join(F.broadcast(forecasts(spark, sf_dir)), "event_type")
    docs = site.day_documents(h.withColumn("actual", F.col("v")).withColumn("evening", F.lit(None).cast("boolean")))
    kept = site.merged_history(docs, docs.limit(0), keep=20)
    hours = F.size(F.from_json("json", "hours array<struct<t:string>>")["hours"])
    return kept.select(F.col("day").cast("string").alias("day"), hours.cast("long").alias("hours"))


@query(f"WITH {LEVELS_SQL}, c AS (SELECT event_type, q[1] AS a, q[50] AS b, q[99] AS c FROM f) SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM c")
def Q06_regrid(spark, sf_dir):
    from meterwise.models import mix

    coarse = F.array(*[F.element_at("q", int(round(x * 100))) for x in mix.COARSE])
    x = mix.on_grid(forecasts(spark, sf_dir).select("event_type", coarse.alias("q")), "q", ["event_type"])
    # the grid meets the coarse levels exactly
    return x.select("event_type", *[r6(F.element_at("q", i)).alias(n) for i, n in ((1, "a"), (50, "b"), (99, "c"))])


@query(f"WITH q AS (SELECT event_type, {T.format("date_trunc('hour', ts)")} AS t, count(value) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2) SELECT * FROM q")
def STREAM_hourly_means(spark, sf_dir):
    """A stream over the landed file, run to its end in update mode: windows are upserted as batches change them."""
    from meterwise.streaming import hourly

    schema = table(spark, sf_dir, "events").schema
    stream = hourly.hourly_means(hourly.read(spark, f"{sf_dir}/events.parquet*", schema, 1000), ["event_type"], "value", late="60 days")
    out = scratch(spark)
    hourly.start_upserts(stream, out, scratch(spark), ["event_type", "t"], "update").awaitTermination()
    return spark.read.parquet(out).select("event_type", K.stamp("t").alias("t"), "n", r6("v").alias("v"))


@query(f"WITH {ALL} SELECT count(*) AS hours, count(v) AS present, {T.format('min(t)')} AS first, {T.format('max(t)')} AS last FROM a")
def A29_build_summary(spark, sf_dir):
    return total(spark, sf_dir).agg(F.count("*").alias("hours"), F.count("v").alias("present"), K.stamp(F.min("t")).alias("first"), K.stamp(F.max("t")).alias("last"))

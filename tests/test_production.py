"""A delivery day: what the gate must not see, errors instead of stale inputs, learned mixes, quarters, runs, archives."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.models import boosted, mix
from meterwise.plans import catalog, catalog_day
from meterwise.production import archive, day, learned, run, shape, surrogates, weather_table
from meterwise.sources import tables
from meterwise.sources.store import Conflict, Store

T0 = datetime(2024, 1, 1)
N = 24 * 26


def hours(rng, late=0.0):
    """series, t, price, load, res, neighbours, gas, carbon of 26 days; `late` is added to hours that no gate knows."""
    out = []
    for i in range(N):
        t = T0 + timedelta(hours=i)
        load = 50 + 10 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 1)
        hidden = late if t >= T0 + timedelta(days=24, hours=22) else 0.0
        out.append(("s", t, *map(float, (load - 20 + rng.normal(0, 1) + hidden, load, 10 + rng.normal(0, 1), 30 + rng.normal(0, 1), 25 + i // 24, 60))))
    return out


SCHEMA = "series string, t timestamp_ntz, price double, load double, res double, neighbours double, gas double, carbon double"
DELIVERY = date(2024, 1, 26)


def inputs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    ask = spark.createDataFrame([("s", DELIVERY)], "series string, delivery date")
    one = lambda c: df.select("series", "t", F.col(c).alias("load"))
    days = day.model_days(df.where(F.to_date("t") < F.lit(DELIVERY)))
    fuels = ask.withColumns({"gas": F.lit(50.0), "carbon": F.lit(60.0)})
    return day.gate_rows(days, ask, day.at_gate(one("load"), ask), day.at_gate(one("neighbours"), ask), one("res"), fuels), df


def test_gate_row_does_not_see_the_late_hours(spark):
    a = inputs(spark, hours(np.random.default_rng(1)))[0].collect()
    b = inputs(spark, hours(np.random.default_rng(1), late=1e6))[0].collect()
    assert len(a) == 1 and a == b and a[0].day == DELIVERY and a[0].scale == 2 * 50 + 0.37 * 60 and len(a[0].x) == 22 + 72 + 3 * 70 + 2 + 7


def test_network_day_and_its_errors(spark):
    gate, df = inputs(spark, hours(np.random.default_rng(2)))
    rows = day.network_rows(day.model_days(df))
    friday = spark.createDataFrame([(DELIVERY,)], "monday date")
    fitted = day.train_ensemble(rows, friday, ("jsu", "quantile"), 1, 40, window_days=30, least=10)
    got = day.network_day(gate, fitted).collect()
    assert len(got) == 24 and all(len(r.raw) == 99 and r.raw == sorted(r.raw) for r in got)
    late = fitted.withColumn("trained_through", F.lit(DELIVERY - timedelta(days=1)))
    with pytest.raises(ValueError, match="too late"):
        day.network_day(gate, late)
    with pytest.raises(ValueError, match="complete training days"):
        day.train_ensemble(rows, friday, least=1000)


def test_training_rows_end_two_days_before_and_skip_the_hole(spark):
    rows = [r for r in hours(np.random.default_rng(3)) if r[1] != T0 + timedelta(days=9, hours=3)]
    table = day.network_rows(day.model_days(spark.createDataFrame(rows, SCHEMA)))
    mondays = spark.createDataFrame([(date(2024, 1, 22),)], "monday date")
    got = sorted(r.day.day for r in day.training_set(table, mondays, 1460).collect())
    # day 10 has a hole: it goes, and so do the days that look back to it by 1, 2, 3 and 7 days
    assert got == [8, 9, 14, 15, 16, 18, 19, 20]


def test_lear_day_heals_the_end_and_refuses_stale_days(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(hours(rng), SCHEMA).select("series", "t", "price", "load", "res")
    ask = df.where(F.to_date("t") == F.lit(DELIVERY)).select("series", "t", "load", "res")
    past = df.where(F.to_date("t") < F.lit(DELIVERY))
    late = F.col("t") >= F.lit(datetime(2024, 1, 25, 22))
    cut = past.select("series", "t", *[F.when(~late, F.col(c)).alias(c) for c in ("price", "load", "res")])
    got = {r.t: r.pred for r in day.lear_day(cut, ask, window=12).collect()}
    absent = {r.t: r.pred for r in day.lear_day(cut.where(~late), ask, window=12).collect()}
    truth = {r.t: r.price for r in df.where(F.to_date("t") == F.lit(DELIVERY)).collect()}
    assert set(got) == set(truth) and got == absent and np.mean([abs(got[t] - truth[t]) for t in truth]) < 6
    with pytest.raises(ValueError, match="complete days end"):
        day.lear_day(past.where(F.to_date("t") < F.lit(DELIVERY - timedelta(days=1))), ask, window=12)
    with pytest.raises(ValueError, match="not complete"):
        day.lear_day(past, ask.limit(23), window=12)


def test_at_gate_fills_two_hours_and_then_takes_the_substitute(spark):
    rows = [("s", T0 + timedelta(hours=i), float(i)) for i in range(96)]
    gone = {24 + 3, 24 + 4, 48 + 3, 48 + 4, 48 + 5}
    loads = spark.createDataFrame([r for i, r in enumerate(rows) if i not in gone], "series string, t timestamp_ntz, load double")
    ask = spark.createDataFrame([("s", date(2024, 1, 2 + k)) for k in range(3)], "series string, delivery date")
    got = {(r.delivery.day, r.t.hour): r for r in day.at_gate(loads, ask).collect()}
    assert {d for d, _ in got} == {2, 4} and got[2, 3].load == 3.0 and got[2, 3].filled and got[2, 22].load == 22.0 and not got[2, 5].filled
    other = loads.withColumn("load", F.lit(7.0)).unionByName(spark.createDataFrame([rows[i] for i in gone], loads.schema))
    both = day.at_gate(loads, ask, other).where("delivery = date'2024-01-03'").collect()
    assert len(both) == 24 and all(r.surrogate for r in both)
    assert day.at_gate(loads, ask, other, evening=True).where("not surrogate").count() == 0 and day.at_gate(loads, ask, evening=True).count() == 0


def test_backtest_sees_no_day_after_its_cut(spark):
    rng = np.random.default_rng(5)
    plan = lambda: day.refits("2024-01-20", "2024-01-25", 6, spark)

    def served(shift):
        rows = [(*r[:2], r[2] + (shift if r[1] >= datetime(2024, 1, 25) else 0.0), *r[3:]) for r in hours(np.random.default_rng(6))]
        table = day.network_rows(day.model_days(spark.createDataFrame(rows, SCHEMA)))
        return {r.t: r.q for r in day.backtest(table, plan(), seeds=1, rounds=10).collect()}

    a, b = served(0.0), served(500.0)
    assert len(a) == 6 * 24 and all(a[t] == b[t] for t in a if t < datetime(2024, 1, 26)) and rng is not None


def test_shapes_add_up_to_nothing(spark, sf):
    got = catalog.QUERIES["Q16_fitted_shape"](spark, sf).groupBy(F.substring("t", 1, 13).alias("h")).agg(F.sum("dev").alias("d"), F.count("*").alias("n")).collect()
    assert got and all(abs(r.d) < 1e-4 and r.n == 4 for r in got)
    q = [float(x) for x in range(99)]
    hour = spark.createDataFrame([("s", T0, q)], "series string, t timestamp_ntz, q array<double>")
    dev = spark.createDataFrame([("s", T0 + timedelta(minutes=15 * k), v) for k, v in enumerate((-1.5, 0.5, 0.5, 0.5))], "series string, t timestamp_ntz, dev double")
    out = {r.t.minute: r.q for r in shape.percentiles(hour, dev).collect()}
    assert out[0] == [x - 1.5 for x in q] and out[45] == [x + 0.5 for x in q]


def test_whole_queries_of_models_run(spark, sf):
    names = {"M10_ensemble": 8, "M12_network_day": 120, "M13_lear_day": 24, "M16_backtest": 192}
    assert {n: catalog.QUERIES[n](spark, sf).count() for n in names} == names
    w = [r.w for r in catalog.QUERIES["Q13_logistic_weights"](spark, sf).collect()]
    assert len(w) >= 48 and all(0 <= x <= 1 for x in w)


def history(spark, rng, days, swap):
    """Model a is right in hours 0 to 11 (or, with swap, on days of high load), b in the others."""
    q = lambda m: [float(m + z / 50) for z in range(-49, 50)]
    rows = []
    for d in range(days):
        for h in range(24):
            load = float(rng.choice([10.0, 90.0]))
            a_right = load > 50 if swap else h < 12
            y = float(rng.normal(0, 0.3))
            rows.append(("s", date(2024, 1, 1) + timedelta(days=d), T0 + timedelta(days=d, hours=h), q(0 if a_right else 9), q(9 if a_right else 0), y, load, 5.0, 0.0, 1.0, False, False))
    return spark.createDataFrame(rows, "series string, day date, t timestamp_ntz, a array<double>, b array<double>, y double, load double, res double, holiday double, price_before double, seed boolean, proxy boolean")


@pytest.mark.parametrize(("variant", "swap"), [("m1", False), ("m3", True)])
def test_learned_weights_find_the_better_model(spark, variant, swap):
    hist = history(spark, np.random.default_rng(7), 26, swap)
    asked = hist.where("day = date'2024-01-26'")
    got = learned.weights(hist.where("day < date'2024-01-26'"), asked, variant, days=30, least=20).join(asked.select("t", "load"), "t").collect()
    assert len(got) == 24 and all(r.fit_days == 24 and not r.fallback for r in got)
    right = [r.w for r in got if (r.load > 50 if swap else r.t.hour < 11)]
    wrong = [r.w for r in got if (r.load < 50 if swap else r.t.hour > 12)]
    assert np.mean(right) > np.mean(wrong) + 0.2
    few = learned.weights(hist.where("day < date'2024-01-10'"), asked, variant, days=30, least=20).collect()
    assert all(r.w == 0.5 and r.fallback for r in few)
    # days D-1 and D are never read
    moved = hist.withColumn("y", F.when(F.col("day") >= F.lit(date(2024, 1, 25)), F.lit(1e6)).otherwise(F.col("y")))
    again = learned.weights(moved, asked, variant, days=30, least=20).collect()
    assert {r.t: r.w for r in again} == pytest.approx({r.t: r.w for r in got})


def test_incomplete_features_log_no_m3_rows(spark):
    hist = history(spark, np.random.default_rng(8), 12, True)
    asked = hist.where("day = date'2024-01-12'").withColumn("res", F.when(F.hour("t") != 3, F.col("res")))
    assert learned.weights(hist, asked, "m3", days=30, least=5).count() == 0
    with pytest.raises(ValueError, match="variant"):
        learned.weights(hist, asked, "m2")


def test_smoothest_path_is_exact():
    import itertools

    rng = np.random.default_rng(9)
    costs, pair = rng.normal(0, 1, (5, 3)), rng.normal(0, 1, (3, 3))
    total = lambda p: sum(costs[i, s] for i, s in enumerate(p)) + sum(pair[a, b] for a, b in itertools.pairwise(p))
    assert total(mix.smoothest(costs, pair)) == pytest.approx(min(map(total, itertools.product(range(3), repeat=5))))


def test_run_keeps_replaces_and_picks_up(spark, tmp_path):
    path, calls = str(tmp_path / "log"), []

    def once(name, fails=()):
        def work(_):
            calls.append(name)
            if name in fails:
                raise RuntimeError("down")

        return work

    steps = lambda fails=(): [run.Step("lear", once("lear", fails), required=True), run.Step("nets", once("nets", fails), ("lear",)), run.Step("mix", once("mix", fails), ("nets",))]
    states = lambda df: [r.state for r in df.orderBy("seq", "step").collect()]
    assert states(run.run_day(spark, path, "2024-01-02", steps(), evening=True)) == ["done"] * 3
    assert sorted(states(run.run_day(spark, path, "2024-01-02", steps(), before_gate=False))) == ["keep-late"] * 3
    assert sorted(r.state for r in run.run_day(spark, path, "2024-01-02", steps(("nets",))).collect()) == ["done", "done", "failed"]
    assert sorted(r.state for r in run.run_day(spark, path, "2024-01-02", steps()).collect()) == ["done", "keep", "keep"]
    assert calls == ["lear", "nets", "mix", "lear", "nets", "mix", "nets"]
    with pytest.raises(RuntimeError):
        run.run_day(spark, path, "2024-01-03", steps(("lear",)))
    assert run.log_of(spark, path).where("state = 'failed' and step = 'lear'").count() == 1


def test_backfill_asks_again_for_what_failed(spark, sf):
    root, counts = catalog_day.backfilled(spark, sf)
    assert counts[0]["failed"] > 0 and counts[1]["failed"] == 0 and counts[1]["asked"] >= counts[0]["failed"]
    store = Store(spark, root)
    assert store.read("pending", archive.PENDING).count() == 0
    rows = store.read("revisions", "mrid string, revision long, start timestamp_ntz")
    assert rows.count() == rows.select("mrid", "revision", "start").distinct().count()


def test_upserts_do_not_collide_and_are_total(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("k", T0, 1.0, "a"), ("k", T0, 2.0, "b"), ("k", T0 + timedelta(days=400), 3.0, "c")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double, z string")
    tables.upsert(spark, path, df, ["k", "t"])
    tables.upsert(spark, path, df.where("v < 3").withColumn("v", F.lit(None).cast("double")), ["k", "t"])
    assert sorted((r.t.year, r.v, r.z) for r in spark.read.parquet(path).collect()) == [(2024, None, "b"), (2025, 3.0, "c")]
    assert not [p for p in tmp_path.iterdir() if p.name != "t"]
    with pytest.raises(FileExistsError):
        for _ in range(2):
            archive.write_run(str(tmp_path / "runs"), "x", {}, df.select("v"), "1")


@pytest.mark.parametrize(("tiles", "n"), [(4, 10), (4, 3), (3, 9), (4, 1)])
def test_ranks_and_tiles_are_the_window_s(spark, tiles, n):
    from pyspark.sql import Window

    from meterwise.functions import timekit as K

    df = spark.createDataFrame([(i, float((i * 7) % 5)) for i in range(n)], "i int, v double")
    got, total = K.ranked(df, "v", "i", cuts=4)
    got = got.withColumn("q", K.tile_of(F.col("n"), total, tiles))
    w = Window.orderBy("v", "i")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("q", F.ntile(tiles).over(w).cast("long"))
    assert sorted(map(tuple, got.select("i", "n", "q").collect())) == sorted(map(tuple, want.select("i", "n", "q").collect()))


# ---- boosted trees and what they stand in for

def test_a_tree_takes_the_best_split_and_the_better_side_for_missing_values():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.normal(0, 1, 80)
    y += 3 * (x[:, 1] > 2)
    x[rng.random((80, 3)) < 0.15] = np.nan
    got = boosted.Trees(rounds=1, rate=1.0, depth=1, least=5).fit(x, y)
    gains = []
    for f in range(3):
        have = np.unique(x[~np.isnan(x[:, f]), f])
        for cut in (have[1:] + have[:-1]) / 2:
            for missing in (True, False):
                left = np.where(np.isnan(x[:, f]), missing, x[:, f] <= cut)
                if 5 <= left.sum() <= 75:
                    gains.append(-sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left)))
    assert -((y - got.predict(x)) ** 2).sum() == pytest.approx(max(gains))
    again = boosted.Trees.from_bytes(got.to_bytes())
    assert again.depth == 1 and (again.predict(x) == got.predict(x)).all()


def test_more_rounds_fit_better_and_constants_stay():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, 500)
    errors = [((boosted.Trees(rounds=r, depth=4).fit(x[:400], y[:400]).predict(x[400:]) - y[400:]) ** 2).mean() for r in (1, 20, 150)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.25 * y.var()
    assert (boosted.Trees(rounds=3).fit(x, np.full(500, 7.0)).predict(x) == 7.0).all()
    assert boosted.Trees(rounds=3).fit(np.full((60, 2), np.nan), np.arange(60.0)).predict(np.full((1, 2), np.nan)) == pytest.approx(29.5)


@pytest.fixture(scope="module")
def year(spark):
    """Hours of two quarters: weather that says much, a weekly load, and capacities that grow."""
    rng = np.random.default_rng(9)
    first = datetime(2023, 1, 1)
    rows = []
    for i in range(24 * 150):
        t = first + timedelta(hours=i)
        wind, sun, warm = float(rng.random()), max(0.0, math.sin((t.hour - 6) / 12 * math.pi)) * float(rng.random()), float(rng.normal(10, 5))
        load = 50 + 8 * math.sin(2 * math.pi * t.hour / 24) - 6 * (t.weekday() > 4) - 0.5 * warm + float(rng.normal(0, 0.5))
        cap = 20 + i / 500
        rows.append((t, wind, sun, warm, load, cap, cap * min(1.0, wind**2 * 1.5), 2 * cap * sun))
    return spark.createDataFrame(rows, "t timestamp_ntz, wind double, sun double, warm double, load double, cap double, onshore double, solar double")


def test_own_renewables_by_rolling_months_do_not_read_what_is_hidden(spark, year):
    targets = {"onshore": "cap", "solar": "cap2"}
    run = lambda df: surrogates.own_renewables(df.select("t", "wind", "sun"), df.select("t", *targets), df.select("t", "cap", (2 * F.col("cap")).alias("cap2")), targets, "2023-04-01", reach=4, rounds=40, depth=4)
    parts = {(r.t, r.target): r.mw for r in run(year).collect()}
    truth = {(r.t, c): r[c] for r in year.where("t >= '2023-04-01'").collect() for c in targets}
    assert set(parts) == set(truth) and all(v >= 0 for v in parts.values())
    past = {(r.t + timedelta(days=7), c): r[c] for r in year.collect() for c in targets}
    error = lambda of: np.mean([abs(of[k] - truth[k]) for k in truth])
    assert error(parts) < 0.5 * error(past)
    # April's forecasts don't depend on April's values, nor May's on May's; May's do on April's
    hide = lambda since: year.withColumns({c: F.when(F.col("t") >= F.lit(since).cast("timestamp_ntz"), F.lit(999.0)).otherwise(F.col(c)) for c in targets})
    april = {(r.t, r.target): r.mw for r in run(hide("2023-04-01")).collect()}
    assert all(april[k] == parts[k] for k in parts if k[0] < datetime(2023, 5, 1)) and any(april[k] != parts[k] for k in parts if k[0] >= datetime(2023, 5, 1))
    may = {(r.t, r.target): r.mw for r in run(hide("2023-05-01")).collect()}
    assert may == parts
    total = {r.t: r.mw for r in surrogates.total_of(run(year), 2).collect()}
    assert total[datetime(2023, 4, 3, 12)] == pytest.approx(sum(parts[datetime(2023, 4, 3, 12), c] for c in targets))


def test_load_surrogate_reads_no_hour_that_is_not_out(spark, year):
    days = spark.createDataFrame([(date(2023, 4, 10), 1.0), (date(2023, 1, 6), 0.4)], "day date, share double")
    run = lambda df: {r.t: r.mw for r in surrogates.load_surrogate(year.select("t", "warm"), df, days, "2023-04-01", day_before=True, reach=4, rounds=40, depth=4).collect()}
    load = year.select("t", F.col("load").alias("v"))
    got = run(load)
    truth = {r.t: r.v for r in load.where("t >= '2023-04-01'").collect()}
    plain = {r.t: r.mw for r in surrogates.week_before(load).collect()}
    assert set(got) == set(truth)
    error = lambda of: np.mean([abs(of[t] - truth[t]) for t in truth])
    assert error(got) < 0.7 * error(plain)
    # for the 20th of April nothing from its own day on counts, nor the last two hours of the day before
    day = datetime(2023, 4, 20)
    hidden = load.withColumn("v", F.when(F.col("t") >= F.lit(day - timedelta(hours=2)), F.lit(1e6)).otherwise(F.col("v")))
    changed = run(hidden)
    assert all(changed[t] == got[t] for t in got if t < day + timedelta(days=1))
    assert any(changed[t] != got[t] for t in got if t >= day + timedelta(days=1))
    gone = surrogates.missing_weather(year.select("t"), spark.createDataFrame([(day,), (datetime(2024, 1, 1),)], "t timestamp_ntz")).collect()
    assert [r.t for r in gone] == [datetime(2024, 1, 1)]


# ---- tables that change as one

def contents(store):
    return tuple(sorted(map(tuple, store.read(t, "k string, v long").collect()), key=str) for t in "ab")


@pytest.mark.parametrize("step", ["_put", "_rename", "_write", "second"])
def test_a_stop_between_any_two_steps_of_a_commit_loses_nothing(spark, tmp_path, monkeypatch, step):
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    store = Store(spark, str(tmp_path / "s"))
    assert contents(store) == ([], []) and store.version() == 0
    with store.commit() as c:
        c.append("a", df(("x", 1), ("y", 2), (None, 3)), "k")
        c.replace("b", df(("q", 9)))
    first = contents(store)
    assert first == ([("x", 1), ("y", 2), (None, 3)], [("q", 9)])

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    with monkeypatch.context() as m, pytest.raises(Stop):
        if step == "_write":
            from meterwise.sources import store as module

            m.setattr(module.Batch, step, stop)
        elif step != "second":
            m.setattr(Store, step, stop)
        with store.commit() as c:
            c.replace("a", df(("x", 10)), "k")
            if step == "second":
                raise Stop
            c.replace("b", df(("q", 90)))
    assert contents(store) == first and contents(Store(spark, str(tmp_path / "s"))) == first
    # the next commit goes through, what was left over is swept, and no partition but x is written again
    with store.commit() as c:
        c.replace("a", df(("x", 10)), "k")
        c.append("b", df(("z", 8)))
    assert sorted(r.v for r in store.read("a", "k string, v long").collect()) == [2, 3, 10] and contents(store)[1] == [("q", 9), ("z", 8)]
    assert store.manifest(2)["a"]["y"] == store.manifest(1)["a"]["y"] and store.parts("a") == ["null", "x", "y"]
    store.sweep(keep=1)
    named = {f.split("/")[1] for t in store.manifest().values() for own in t.values() for f in own}
    assert {p.name for p in (tmp_path / "s" / "data").iterdir() if not p.name.startswith(".")} == named and len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 1
    assert sorted(r.v for r in store.read("a", "k string, v long").collect()) == [2, 3, 10]


def test_of_two_commits_on_one_version_one_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "k string, v long")
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    with pytest.raises(Conflict):
        with one.commit() as a:
            a.append("a", df)
            with two.commit() as b:
                b.append("a", df.withColumn("v", F.lit(2).cast("long")))
    assert contents(one)[0] == [("x", 2)]
    assert one.read("a", "k string, v long", version=0).count() == 0 and one.read("a", "k string, v long", parts=["none"]).count() == 0


def test_a_stored_day_yields_only_to_a_better_vintage(spark, tmp_path):
    day = date(2024, 3, 5)
    at = lambda d, h: datetime(d.year, d.month, d.day, h)
    runs = lambda *rows: spark.createDataFrame(list(rows), "run_time timestamp_ntz, t timestamp_ntz, v double")
    row = lambda d, back, hour, v: (at(d - timedelta(days=back), hour), at(d, 7), v)
    store = Store(spark, str(tmp_path))
    other, late = day + timedelta(days=1), day + timedelta(days=2)
    assert weather_table.update(store, runs(row(day, 2, 12, 1.0), row(other, 1, 0, 5.0), row(other, 2, 12, 6.0)), False) == [str(other)]
    assert weather_table.update(store, runs(row(day, 2, 12, 1.0), row(day, 1, 6, 99.0), row(late, 2, 12, 7.0)), True, through=str(other)) == [str(day)]
    # a fallback never takes the place of anything, a primary run that of a fallback alone, once
    assert weather_table.update(store, runs(row(day, 2, 12, 2.0), row(other, 2, 12, 2.0)), True) == []
    assert weather_table.update(store, runs(row(day, 1, 0, 3.0), row(day, 1, 0, 3.0), row(other, 1, 0, 9.0)), True) == [str(day)]
    assert weather_table.update(store, runs(row(day, 1, 0, 4.0)), True) == []
    like = runs(row(day, 1, 0, 0.0))
    assert sorted((r.day, r.vintage, r.v) for r in weather_table.read(store, like).collect()) == [(day, 2, 3.0), (other, 2, 5.0)]
    days = spark.createDataFrame([(day,), (late,)], "day date")
    assert [r.day for r in weather_table.gaps(store, like, days).collect()] == [late]

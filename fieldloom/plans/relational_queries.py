"""Queries for the relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.scalar import clamp, fixed, fixed_sql, is_finite, normal_name, p_value_text, round_to_level
from fieldloom.operators import expect, relational as R
from fieldloom.operators.selection import exact_quantiles
from fieldloom.plans import fixtures as X
from fieldloom.session import stored

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _mode(spark: SparkSession, d: str) -> DataFrame:
    return R.mode_first(X.records(spark, d), ["site", "day"], "level", "source_order")


MODE = X.RECORDS + """, counted AS (SELECT site, day, level, count(*) AS n, min(source_order) AS first FROM records GROUP BY ALL),
mode AS (SELECT site, day, arg_min(level, struct_pack(a := -n, b := first)) AS level, CAST(sum(n) AS BIGINT) AS n_records FROM counted GROUP BY site, day)"""


@query(f"WITH {MODE} SELECT * FROM mode")
def site_year_mode(spark, d):
    return _mode(spark, d)


@query("SELECT CAST(day(ts) AS INT) AS day, count(*) AS n, count(DISTINCT user_id) AS sites FROM events GROUP BY 1")
def annual_counts(spark, d):
    return X.records(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))


@query(f"WITH {X.RECORDS} SELECT level, count(*) AS n FROM records GROUP BY level")
def level_counts(spark, d):
    return X.records(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN day(ts) < 7 THEN 'a' WHEN day(ts) > 7 AND day(ts) < 14 THEN 'b' WHEN day(ts) > 14 AND day(ts) < 21 THEN 'c' WHEN day(ts) > 21 AND day(ts) <= 30 THEN 'd' END AS period, count(*) AS n FROM events GROUP BY 1")
def period_slices(spark, d):
    day = F.col("day")
    period = F.when(day < 7, "a").when((day > 7) & (day < 14), "b").when((day > 14) & (day < 21), "c").when((day > 21) & (day <= 30), "d")
    return X.records(spark, d).groupBy(period.alias("period")).agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE event_type IN ('view', 'click') AND value >= 50 AND value < 150 AND isfinite(value)")
def range_membership_filter(spark, d):
    e = X.read(spark, d, "events")
    return e.filter(F.col("event_type").isin("view", "click") & (F.col("value") >= 50) & (F.col("value") < 150) & is_finite(F.col("value"))).select("event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) c ON o_custkey = c_custkey")
def membership_semi(spark, d):
    c = X.read(spark, d, "customer").filter("c_acctbal < 0")
    return X.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def training_anti(spark, d):
    return X.read(spark, d, "customer").join(X.read(spark, d, "orders").filter("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join_chain(spark, d):
    c, n, r = (X.read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("SELECT n_nationkey, n_name, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def left_join_chain(spark, d):
    s = X.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = X.read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    n = X.read(spark, d, "nation")
    j = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    return j.select("n_nationkey", "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query(f"WITH {X.CUBE} SELECT location, member, year, {fixed_sql('avg(value)', 2)} AS mean_value FROM cube GROUP BY location, member, year")
def monthly_to_annual(spark, d):
    return X.cube(spark, d).groupBy("location", "member", "year").agg(fixed(F.avg("value"), 2).alias("mean_value"))


@query(f"WITH {X.ANNUAL} SELECT location, member, year, {fixed_sql('temp')} AS temp FROM annual")
def complete_month_mean(spark, d):
    return X.annual(spark, d).withColumn("temp", fixed(F.col("temp")))


@query(f"WITH {X.ANNUAL} SELECT location, year, {fixed_sql('avg(temp)')} AS ensemble_mean, count(*) AS members FROM annual GROUP BY location, year")
def ensemble_mean(spark, d):
    return X.annual(spark, d).groupBy("location", "year").agg(fixed(F.avg("temp")).alias("ensemble_mean"), F.count("*").alias("members"))


@query(f"WITH {X.ANNUAL} SELECT location, member, year, {fixed_sql('temp - avg(temp) OVER (PARTITION BY location, member)')} AS anomaly FROM annual")
def member_anomaly(spark, d):
    return R.centred(X.annual(spark, d), ["location", "member"], "temp").select("location", "member", "year", fixed(F.col("anomaly")).alias("anomaly"))


ANOMALY = X.ANNUAL + ", an AS (SELECT *, temp - avg(temp) OVER (PARTITION BY location, member) AS a FROM annual), q AS (SELECT quantile_cont(a, 0.1) AS lo, quantile_cont(a, 0.9) AS hi FROM an)"


@query(f"WITH {ANOMALY} SELECT location, {fixed_sql('avg(temp)')} AS mean, {fixed_sql('stddev_samp(temp)')} AS sd, {fixed_sql('avg(CASE WHEN a <= lo THEN 1.0 ELSE 0.0 END)')} AS p_cold, {fixed_sql('avg(CASE WHEN a >= hi THEN 1.0 ELSE 0.0 END)')} AS p_warm FROM an, q GROUP BY location")
def climate_summary(spark, d):
    a = stored(R.centred(X.annual(spark, d), ["location", "member"], "temp"))
    lo, hi = exact_quantiles(a, "anomaly", [0.1, 0.9])
    return a.groupBy("location").agg(
        fixed(F.avg("temp")).alias("mean"), fixed(F.stddev_samp("temp")).alias("sd"), fixed(R.share(F.col("anomaly") <= lo)).alias("p_cold"), fixed(R.share(F.col("anomaly") >= hi)).alias("p_warm")
    )


NEAR = X.RECORDS + ", " + X.GRID + """, near AS (SELECT site, lon, lat, arg_min(cell_id, struct_pack(d := (lon - glon) * (lon - glon) + (lat - glat) * (lat - glat), c := cell_id)) AS cell_id,
min((lon - glon) * (lon - glon) + (lat - glat) * (lat - glat)) AS d2 FROM (SELECT DISTINCT site, lon, lat FROM records), grid GROUP BY site, lon, lat)"""


@query(f"WITH {NEAR} SELECT site, cell_id, {fixed_sql('d2')} AS d2 FROM near")
def nearest_cell(spark, d):
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    return R.nearest_cell(sites, X.grid(spark, d)).select("site", "cell_id", fixed(F.col("d2")).alias("d2"))


@query(f"WITH {NEAR}, hits AS (SELECT cell_id, day, count(DISTINCT records.site) AS n FROM records JOIN near USING (site) GROUP BY ALL) SELECT g.cell_id, CAST(x.day AS INT) AS day, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS covered FROM grid g CROSS JOIN (SELECT unnest(range(1, 31)) AS day) x LEFT JOIN hits h ON h.cell_id = g.cell_id AND h.day = x.day")
def coverage_panel(spark, d):
    rec = X.records(spark, d)
    near = R.nearest_cell(rec.select("site", "lon", "lat").distinct(), X.grid(spark, d)).select("site", "cell_id")
    hits = rec.join(near, "site").groupBy("cell_id", "day").agg(F.count_distinct("site").alias("n"))
    days = spark.range(1, 31).select(F.col("id").cast("int").alias("day"))
    return R.dense_panel(X.grid(spark, d).select("cell_id"), days, hits, ["cell_id", "day"], "n").withColumn("covered", F.col("n") > 0)


@query("SELECT DISTINCT CAST(day(ts) AS INT) AS day, CAST(list_min(list_transform([2, 9, 16, 23, 30], lambda v: struct_pack(d := abs(v - day(ts)), v := v))).v AS INT) AS reference FROM events")
def nearest_reference_year(spark, d):
    return X.records(spark, d).select("day").distinct().withColumn("reference", R.nearest_value(F.col("day"), [2, 9, 16, 23, 30]))


HOLD = MODE + """, big AS (SELECT day FROM mode GROUP BY day HAVING count(DISTINCT site) >= 5),
drawn AS (SELECT m.site, m.day, m.level, row_number() OVER (PARTITION BY m.day ORDER BY md5('7|' || m.site || '|' || m.day), m.site) AS k FROM mode m JOIN big USING (day)), held AS (SELECT site, day, level FROM drawn WHERE k = 1)"""


def _hold(spark, d):
    m = _mode(spark, d)
    big = m.groupBy("day").agg(F.count_distinct("site").alias("n")).filter("n >= 5").select("day")
    return R.pick_one(m.join(big, "day", "left_semi").select("day", "site", "level"), ["day"], ["site", "day"], "7")


@query(f"WITH {HOLD} SELECT site, day, level FROM held")
def holdout_split(spark, d):
    return _hold(spark, d)


@query(f"WITH {HOLD}, train AS (SELECT * FROM records r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.site = r.site AND h.day = r.day)) SELECT (SELECT count(*) FROM train) AS training, (SELECT count(*) FROM records) AS total, (SELECT count(*) FROM train JOIN held USING (site, day)) AS leaked")
def leakage_check(spark, d):
    rec, held = X.records(spark, d), _hold(spark, d).select("site", "day")
    train = rec.join(held, ["site", "day"], "left_anti")
    counts = train.agg(F.count("*").alias("training")).crossJoin(rec.agg(F.count("*").alias("total")))
    return counts.crossJoin(train.join(held, ["site", "day"]).agg(F.count("*").alias("leaked")))


@query(f"WITH {MODE} SELECT day, count(DISTINCT site) AS n FROM mode GROUP BY day HAVING count(DISTINCT site) >= 5")
def eligible_groups(spark, d):
    return _mode(spark, d).groupBy("day").agg(F.count_distinct("site").alias("n")).filter("n >= 5")


@query("SELECT c_custkey, name, value FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x1900, c_acctbal AS x1901 FROM customer) UNPIVOT (value FOR name IN (x1900, x1901))")
def wide_to_long(spark, d):
    wide = X.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x1900"), F.col("c_acctbal").alias("x1901"))
    return R.wide_to_long(wide, ["c_custkey"], r"x[0-9]{4}")


@query(f"SELECT user_id, {', '.join(f'count(*) FILTER (day(ts) = {k}) AS x{k}' for k in range(1, 32))} FROM events GROUP BY user_id")
def long_to_wide(spark, d):
    counts = X.records(spark, d).groupBy("site", "day").agg(F.count("*").alias("n"))
    return R.long_to_wide(counts, ["site"], "day", list(range(1, 32)), "n", "x").fillna(0).withColumnRenamed("site", "user_id")


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def common_years(spark, d):
    e = X.read(spark, d, "events")
    return R.in_all([e.filter(F.col("event_type") == t) for t in ("view", "click", "error")], "user_id")


@query("SELECT r_regionkey AS key, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bind_union(spark, d):
    r = X.read(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return R.bind_rows(r, X.read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, d):
    a = X.read(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return a.subtract(X.read(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT DISTINCT n_regionkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct_pairs(spark, d):
    c, n = X.read(spark, d, "customer"), X.read(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_regionkey", "c_mktsegment").distinct()


DAILY = """daily AS (SELECT day(ts) AS day, avg(value) FILTER (event_type = 'purchase') AS a, avg(value) FILTER (event_type = 'view') AS b, avg(value) AS e FROM events GROUP BY 1)"""


def _daily(spark, d):
    e = X.read(spark, d, "events")
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return e.groupBy(F.dayofmonth("ts").alias("day")).agg(of("purchase").alias("a"), of("view").alias("b"), F.avg("value").alias("e"))


@query(f"WITH {DAILY} SELECT count(*) AS n, {fixed_sql('corr(a, e)', 9)} AS correlation, {fixed_sql('avg(e - a)')} AS bias, {fixed_sql('sqrt(avg((e - a) * (e - a)))')} AS rmse, {fixed_sql('corr(a, e)', 9)} AS anomaly_correlation, {fixed_sql('stddev_pop(e - a)')} AS anomaly_rmse FROM daily WHERE a IS NOT NULL AND e IS NOT NULL")
def method_metrics(spark, d):
    m = R.pair_metrics(_daily(spark, d), [], "a", "e")
    return m.select("n", *[fixed(F.col(c), 9 if "corr" in c else 6).alias(c) for c in m.columns if c != "n"])


@query(f"WITH {DAILY} SELECT {fixed_sql('avg(CASE WHEN e < least(a, b) THEN 1.0 ELSE 0.0 END)')} AS below, {fixed_sql('avg(CASE WHEN e > greatest(a, b) THEN 1.0 ELSE 0.0 END)')} AS above FROM daily")
def displacement(spark, d):
    below, above = R.displacement(F.col("e"), F.col("a"), F.col("b"))
    return _daily(spark, d).agg(fixed(below).alias("below"), fixed(above).alias("above"))


@query("SELECT user_id, CAST(day(ts) AS INT) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return R.duplicate_keys(X.records(spark, d), ["site", "day"]).withColumnRenamed("site", "user_id")


@query(f"WITH {X.ANNUAL} SELECT location, year, count(DISTINCT member) AS n FROM annual GROUP BY ALL HAVING count(DISTINCT member) <> 7")
def member_cardinality(spark, d):
    return expect.wrong_cardinality(X.annual(spark, d), ["location", "year"], "member", 7)


@query("WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT user_id, CAST(day(ts) AS INT) AS day FROM events) SELECT u.user_id, CAST(x.day AS INT) AS day FROM u CROSS JOIN (SELECT unnest(range(1, 31)) AS day) x LEFT JOIN h ON h.user_id = u.user_id AND h.day = x.day WHERE h.day IS NULL")
def missing_days(spark, d):
    return expect.missing_steps(X.records(spark, d), ["site"], "day", 1, 30).select(F.col("site").alias("user_id"), "day")


@query("SELECT site, n AS id FROM (SELECT user_id AS site, row_number() OVER (ORDER BY min(event_id)) AS n FROM events GROUP BY user_id)")
def first_appearance(spark, d):
    return R.first_appearance_ids(X.records(spark, d), ["site"], "source_order").withColumn("id", F.col("id").cast("long"))


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS k FROM customer QUALIFY k <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return X.read(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("k")).filter("k <= 3")


@query(f"WITH {X.RECORDS} SELECT site, source_order, max(value) OVER (PARTITION BY site ORDER BY source_order) AS value FROM records")
def running_max_cdf(spark, d):
    return R.running_max(X.records(spark, d), ["site"], "source_order", "value").select("site", "source_order", "value")


@query(f"WITH {X.RECORDS}, m AS (SELECT site, source_order, max(value) OVER (PARTITION BY site ORDER BY source_order) AS p FROM records) SELECT site, p, min(source_order) AS first FROM m GROUP BY site, p")
def monotone_levels(spark, d):
    r = X.records(spark, d).withColumn("p", F.col("value"))
    return R.first_of_levels(r, ["site"], "source_order", "p").select("site", "p", F.col("source_order").alias("first"))


@query(f"WITH {X.RECORDS}, c AS (SELECT day, level, count(*) AS n FROM records GROUP BY ALL) SELECT day, level, {fixed_sql('CAST(sum(n) OVER (PARTITION BY day ORDER BY level) AS DOUBLE) / sum(n) OVER (PARTITION BY day)')} AS p FROM c")
def cumulative_probability(spark, d):
    c = X.records(spark, d).groupBy("day", "level").agg(F.count("*").alias("n"))
    w = Window.partitionBy("day")
    return c.select("day", "level", fixed(F.sum("n").over(w.orderBy("level")) / F.sum("n").over(w)).alias("p"))


@query(f"SELECT CAST(least(floor((value - 0) / 50), 8) AS INT) AS bin, count(*) AS n, {fixed_sql('count(*) / (sum(count(*)) OVER () * 50.0)', 9)} AS density FROM events WHERE value >= 0 AND value <= 450 GROUP BY 1")
def level_histogram(spark, d):
    return R.histogram(X.read(spark, d, "events"), "value", 0.0, 50.0, 9).withColumn("density", fixed(F.col("density"), 9))


@query(f"SELECT event_type, x, {fixed_sql('avg(exp(-((x - value) / 20.0) * ((x - value) / 20.0) / 2)) / (20.0 * 2.5066282746310002e0)', 9)} AS density FROM events, (SELECT unnest([0.0, 50.0, 100.0, 150.0, 200.0])::DOUBLE AS x) GROUP BY event_type, x")
def kernel_density(spark, d):
    return R.kernel_density(X.read(spark, d, "events"), "value", [0.0, 50.0, 100.0, 150.0, 200.0], 20.0, ["event_type"]).withColumn("density", fixed(F.col("density"), 9))


@query(f"SELECT c_nationkey, {', '.join(f'{fixed_sql(s + chr(40) + c + chr(41), 4)} AS {c}_{n}' for c in ('c_acctbal',) for n, s in (('mean', 'avg'), ('sd', 'stddev_samp'), ('min', 'min'), ('max', 'max')))} FROM customer GROUP BY 1")
def across_statistics(spark, d):
    s = X.read(spark, d, "customer").groupBy("c_nationkey").agg(*R.stats(["c_acctbal"]))
    return s.select("c_nationkey", *[fixed(F.col(c), 4).alias(c) for c in s.columns[1:]])


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS nations, len(list(DISTINCT c_nationkey)) = 25 AS complete FROM customer GROUP BY 1")
def set_of_years(spark, d):
    s = F.sort_array(F.collect_set("c_nationkey"))  # at most as many as nations
    return X.read(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_join(s.cast("array<string>"), ",").alias("nations"), (s == F.array(*[F.lit(i) for i in range(25)])).alias("complete"))


@query("SELECT l AS level, coalesce(n, 0) AS n FROM (SELECT unnest([-2, -1, 0, 1, 2])::INTEGER AS l) LEFT JOIN (SELECT CASE event_type WHEN 'error' THEN -2 WHEN 'view' THEN -1 WHEN 'click' THEN 0 ELSE 1 END AS x, count(*) AS n FROM events GROUP BY 1) ON l = x")
def zero_filled_counts(spark, d):
    return R.zero_filled_counts(X.records(spark, d), "level", [-2, -1, 0, 1, 2])


@query("SELECT quantity, CAST(value AS VARCHAR) AS value FROM (SELECT count(*) AS records, count(DISTINCT user_id) AS sites, min(event_id) AS first, max(event_id) AS last FROM events) UNPIVOT (value FOR quantity IN (records, sites, first, last))")
def diagnostics_table(spark, d):
    one = X.records(spark, d).agg(F.count("*").alias("records"), F.count_distinct("site").alias("sites"), F.min("source_order").alias("first"), F.max("source_order").alias("last"))
    return R.long_diagnostics(one)


@query(f"WITH {X.GRID} SELECT a.cell_id AS a, b.cell_id AS b, {fixed_sql(geo.ellipsoid_km_sql('a.glon', 'a.glat', 'b.glon', 'b.glat'), 4)} AS km FROM grid a, grid b WHERE a.cell_id < b.cell_id")
def great_circle_pairs(spark, d):
    a, b = (X.grid(spark, d).select(F.col("cell_id").alias(k), F.col("glon").alias(f"x{k}"), F.col("glat").alias(f"y{k}")) for k in "ab")
    return a.crossJoin(F.broadcast(b)).filter("a < b").select("a", "b", fixed(geo.ellipsoid_km(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")), 4).alias("km"))


@query("SELECT n_nationkey, lower(regexp_replace(n_name, '[ _-]', '', 'g')) AS key, CASE lower(regexp_replace(n_name, '[ _-]', '', 'g')) WHEN 'nation1' THEN 'One' WHEN 'nation2' THEN 'Two' ELSE 'other' END AS known FROM nation")
def normalised_names(spark, d):
    n = X.read(spark, d, "nation")
    return n.select("n_nationkey", normal_name(F.col("n_name")).alias("key"), normal_name(F.col("n_name"), {"nation1": "One", "nation2": "Two"}, "other").alias("known"))


@query("SELECT event_id, CAST(greatest(least(round_even(value / 50 - 3, 0), 1), -2) AS DOUBLE) AS level, greatest(least(value, 200.0), 10.0) AS clamped FROM events")
def rounded_levels(spark, d):
    return X.read(spark, d, "events").select("event_id", round_to_level(F.col("value") / 50 - 3).alias("level"), clamp(F.col("value"), 10.0, 200.0).alias("clamped"))


_P_VALUES = "SELECT event_id, (103 + 10 * (event_id % 89)) / 100.0::DOUBLE * pow(10.0::DOUBLE, -1 - event_id % 19) AS p, (103 + 10 * (event_id % 89)) / 100.0::DOUBLE AS m, -1 - event_id % 19 AS e FROM events"


@query(f"SELECT event_id, CASE WHEN p < 2e-16 THEN '< 2 × 10^-16' WHEN p < 1e-4 THEN printf('%.2f', m) || ' × 10^' || e ELSE printf('%.4f', p) END AS text FROM ({_P_VALUES})")
def p_value_labels(spark, d):
    """Labels of probabilities from 1 down to 1e-19, three digits and a power for each event."""
    p = (103 + 10 * (F.col("event_id") % 89)) / F.lit(100.0) * F.pow(F.lit(10.0), (-1 - F.col("event_id") % 19).cast("double"))
    return X.read(spark, d, "events").select("event_id", p_value_text(p).alias("text"))


@query(f"""WITH {X.GRID}, b AS (SELECT floor(min(glon) * 2) / 2 - 0.25 AS x0, floor(min(glat) * 2) / 2 - 0.25 AS y0, CAST(ceil(max(glon) * 2) - floor(min(glon) * 2) AS INT) + 1 AS nx, CAST(ceil(max(glat) * 2) - floor(min(glat) * 2) AS INT) + 1 AS ny FROM grid)
SELECT x0 + 0.5 * i AS lon, y0 + 0.5 * j AS lat FROM (SELECT x0, y0, ny, unnest(range(0, nx)) AS i FROM b), unnest(range(0, ny)) AS t(j)""")
def grid_generator(spark, d):
    """Half-degree cells over the extent of the given cells."""
    from fieldloom.sources.grids import half_degree_grid

    lo, hi = (lambda c: F.floor(F.min(c) * 2)), (lambda c: F.ceil(F.max(c) * 2))
    b = X.grid(spark, d).agg(lo("glon").alias("x"), lo("glat").alias("y"), (hi("glon") - lo("glon") + 1).alias("nx"), (hi("glat") - lo("glat") + 1).alias("ny")).first()
    return half_degree_grid(spark, b["x"] / 2 - 0.25, b["y"] / 2 - 0.25, b["nx"], b["ny"]).select("lon", "lat")


@query(f"SELECT {fixed_sql('min(s)')} AS step FROM (SELECT c - lag(c) OVER (ORDER BY c) AS s FROM (SELECT DISTINCT 98.0 + CAST(n_nationkey * 37 % 265 AS DOUBLE) / 10.0 AS c FROM nation)) WHERE s > 0")
def grid_spacing(spark, d):
    return R.spacing(X.grid(spark, d), "glon").select(fixed(F.col("step")).alias("step"))


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)000(01|12)')")
def pattern_filter(spark, d):
    return X.read(spark, d, "customer").filter(F.col("c_name").rlike("(?i)000(01|12)")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, coalesce(a, b) AS kept FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS a, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS b FROM orders) WHERE a IS NOT NULL OR b IS NOT NULL")
def any_present(spark, d):
    o = X.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("b"))
    return o.select("o_orderkey", F.coalesce("a", "b").alias("kept")).filter("kept is not null")


@query(f"WITH {X.RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY source_order) AS k FROM records) SELECT site, source_order FROM r WHERE k NOT IN (2, 3)")
def position_removal(spark, d):
    return R.without_positions(X.records(spark, d), ["site"], "source_order", [2, 3]).select("site", "source_order")


@query("SELECT event_id FROM events WHERE (event_type = 'view' AND day(ts) > 3 AND day(ts) <= 9) OR (event_type = 'click' AND day(ts) > 10 AND day(ts) <= 11)")
def configured_windows(spark, d):
    e = X.read(spark, d, "events").select("event_id", "event_type", F.dayofmonth("ts").alias("day"))
    return R.within_windows(e, [("view", 3, 9), ("click", 10, 11)], "event_type", "day").select("event_id")


@query(f"WITH {X.GRID}, s AS (SELECT DISTINCT user_id AS site, 98.0 + CAST(user_id * 37 % 265 AS DOUBLE) / 10.0 AS lon, 18.0 + CAST(user_id * 53 % 245 AS DOUBLE) / 10.0 AS lat FROM events), p AS (SELECT site, cell_id, 2 * {geo.SPHERE!r} * asin(sqrt(least(1.0, pow(sin((radians(glat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon) / 2), 2)))) AS km FROM s, grid) SELECT site, arg_min(cell_id, struct_pack(k := km, c := cell_id)) AS cell_id, {fixed_sql('min(km)', 4)} AS km FROM p GROUP BY site")
def nearest_geodesic(spark, d):
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    return R.nearest_on_sphere(sites, X.grid(spark, d)).select("site", "cell_id", fixed(F.col("km"), 4).alias("km"))


@query(f"WITH {X.GRID} SELECT cell_id, printf('%.8f_%.8f', glon, glat) AS key, printf('%.2f_%.2f', glon, glat) AS short FROM grid")
def coordinate_keys(spark, d):
    return X.grid(spark, d).select("cell_id", geo.coordinate_key(F.col("glon"), F.col("glat")).alias("key"), geo.coordinate_key(F.col("glon"), F.col("glat"), 2).alias("short"))


@query("SELECT f AS l_returnflag, s AS l_linestatus, r_name FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT DISTINCT l_linestatus AS s FROM lineitem), region")
def parameter_grid(spark, d):
    """Every combination of the distinct values of three columns, each of a few values."""
    l = X.read(spark, d, "lineitem")
    return l.select("l_returnflag").distinct().crossJoin(l.select("l_linestatus").distinct()).crossJoin(X.read(spark, d, "region").select("r_name"))


@query(f"SELECT event_type, {fixed_sql('median(value)')} AS middle, {fixed_sql('var_pop(value)', 3)} AS spread, {fixed_sql('quantile_cont(value, 0.9)')} AS q90 FROM events GROUP BY event_type")
def medians(spark, d):
    return X.read(spark, d, "events").groupBy("event_type").agg(fixed(F.median("value")).alias("middle"), fixed(F.var_pop("value"), 3).alias("spread"), fixed(F.percentile("value", 0.9)).alias("q90"))


@query(f"WITH {X.ANNUAL} SELECT location, member, year, {fixed_sql('temp - lag(temp) OVER (PARTITION BY location, member ORDER BY year)')} AS step FROM annual")
def first_differences(spark, d):
    w = Window.partitionBy("location", "member").orderBy("year")
    return X.annual(spark, d).select("location", "member", "year", fixed(F.col("temp") - F.lag("temp").over(w)).alias("step"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END NULLS LAST, c_custkey) AS place FROM customer")
def nulls_last_order(spark, d):
    c = X.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"))
    return c.select("c_custkey", F.row_number().over(Window.orderBy(F.col("x").asc_nulls_last(), "c_custkey")).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= greatest(l_discount, l_tax, 0.05) THEN 1 WHEN l_tax >= greatest(l_discount, l_tax, 0.05) THEN 2 ELSE 3 END AS best FROM lineitem")
def first_argmax(spark, d):
    l = X.read(spark, d, "lineitem").withColumn("c", F.lit(0.05))
    return l.select("l_orderkey", "l_linenumber", R.first_argmax("l_discount", "l_tax", "c").alias("best"))


@query(f"SELECT {fixed_sql('a - 0.05 * (b - a)')} AS lo, {fixed_sql('b + 0.05 * (b - a)')} AS hi FROM (SELECT least(min(l_discount), min(l_tax)) AS a, greatest(max(l_discount), max(l_tax)) AS b FROM lineitem)")
def square_limits(spark, d):
    return R.square_limits(X.read(spark, d, "lineitem"), ["l_discount", "l_tax"]).select(fixed(F.col("lo")).alias("lo"), fixed(F.col("hi")).alias("hi"))


@query(f"WITH {X.GRID} SELECT cell_id, {fixed_sql('ln(1 + coalesce(a, 0))')} AS population FROM grid LEFT JOIN (SELECT c_nationkey, avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS a FROM customer GROUP BY 1) ON cell_id = c_nationkey")
def population_covariate(spark, d):
    c = X.read(spark, d, "customer").groupBy("c_nationkey").agg(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("a"))
    return X.grid(spark, d).join(c, F.col("cell_id") == F.col("c_nationkey"), "left").select("cell_id", fixed(F.log1p(F.coalesce("a", F.lit(0.0)))).alias("population"))


@query("SELECT n_nationkey, i, CAST(n_nationkey + 0.25 * i AS DOUBLE) AS x FROM nation, (SELECT unnest(range(0, 9))::INTEGER AS i)")
def table_function_grid(spark, d):
    """A row of steps for every nation, by the table function."""
    from fieldloom.sources.grids import register

    register(spark)
    nations = X.read(spark, d, "nation").select("n_nationkey")
    return spark.sql("SELECT n_nationkey, i, x FROM {nations}, LATERAL event_grid(CAST(n_nationkey AS DOUBLE), n_nationkey + 2.0D, 0.25D)", nations=nations)


@query("SELECT CAST(substr(c, 2) AS INT) AS year, v FROM (SELECT CAST(c_custkey AS DOUBLE) AS x1850, c_custkey * 2.0::DOUBLE AS x1851 FROM customer) UNPIVOT (v FOR c IN (x1850, x1851))")
def year_column_discovery(spark, d):
    from fieldloom.functions.scalar import year_of_column

    w = X.read(spark, d, "customer").select((F.col("c_custkey") * F.lit(1.0)).alias("x1850"), (F.col("c_custkey") * F.lit(2.0)).alias("x1851"))
    return w.unpivot([], list(R.year_columns(w.columns)), "c", "v").select(year_of_column(F.col("c")).alias("year"), "v")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def one_to_one_join(spark, d):
    n = X.read(spark, d, "nation")
    r = n.join(X.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return R.joined_one_to_one(n.select("n_nationkey", "n_name"), r, ["n_nationkey"])

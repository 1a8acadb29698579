"""Sources, sinks, runner, expectations and streams on small inputs."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import expect, functional, glm, prior, relational as R, statespace
from fieldloom.plans.runner import Runner, Step, StepError
from fieldloom.sources import files, grids, netcdf, xlsx


def test_workbook_source(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{r}"><v>{v}</v></c>'
    strings = ["level", "year", "kept"]
    rows = [[cell("A1", 0), cell("B1", 1), cell("D1", 2)], [cell("A2", "-1"), cell("B2", "1500"), cell("D2", "7.5")], [cell("A3", "0"), cell("D3", "8")]]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    spark.dataSource.register(xlsx.WorkbookSource)
    got = spark.read.format("fieldloom_xlsx").option("keep", "1,2,4").option("names", "level,year,kept").load(str(tmp_path / "a.xlsx")).collect()
    assert [tuple(r) for r in got] == [(1, "-1", "1500", "7.5"), (2, "0", None, "8")]
    assert xlsx.column_number("AA") == 27


def test_netcdf_source(spark, tmp_path):
    data = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    netcdf.write_classic(str(tmp_path / "a.nc"), "temperature", data, ["time", "lat", "lon"], "degC")
    spark.dataSource.register(netcdf.NetcdfSource)
    got = spark.read.format("fieldloom_netcdf").option("variable", "temperature").option("slices", ":,1:3,0:2").option("to_kelvin", "true").load(str(tmp_path / "a.nc")).collect()
    assert len(got) == 8 and {(r.i0, r.i1, r.i2): r.value for r in got}[(1, 2, 1)] == pytest.approx(data[1, 2, 1] + 273.15)


def test_wide_months_and_sinks(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("lon,lat,T_1850_01,T_1850_02\n98.25,18.25,1.5,2.5\n98.75,18.25,3.5,NA\n")
    long = files.read_wide_months(spark, path, 3)
    assert sorted((r.lon, r.year, r.month, r.value) for r in long.filter("value is not null").collect()) == [(98.25, 1850, 1, 1.5), (98.25, 1850, 2, 2.5), (98.75, 1850, 1, 3.5)]
    wide = files.wide_years(long.withColumn("year", F.col("month") + 1900), ["lon"], [1901, 1902], "value")
    assert wide.columns == ["lon", "x1901", "x1902"]
    files.write_csv(wide, str(tmp_path / "out"), gzip=True, bom=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    files.write_archive({"a": wide, "b": long}, str(tmp_path / "arch"))
    assert files.read_archive(spark, str(tmp_path / "arch"), ["a", "b"])["b"].count() == 4
    (tmp_path / "w.csv").write_text("city,x1901,X1902,note\na,1.5,NA,dry\n")
    back = files.read_wide_years(spark, str(tmp_path / "w.csv"), spark.createDataFrame([], "city string").schema)
    assert sorted((r.city, r.year, r.value) for r in back.collect()) == [("a", 1901, 1.5), ("a", 1902, None)]
    early = spark.createDataFrame([(0, 1.0), (13, 2.0)], "step int, value double")
    assert [(r.year, r.month) for r in files.assemble_members(early, early, 1350, 1850).orderBy("year", "month").collect()] == [(1350, 1), (1351, 2), (1850, 1), (1851, 2)]
    bands = {1776: spark.createDataFrame([(0.0, 0.0, 5.0), (1.0, 0.0, None)], "x double, y double, value double"), 1820: spark.createDataFrame([(0.0, 0.0, 6.0), (1.0, 0.0, None)], "x double, y double, value double")}
    assert files.cells_of_rasters(bands).count() == 1


def test_resolver_checkpoint_runner(spark, tmp_path):
    made = tmp_path / "p"
    made.mkdir()
    (made / "x").write_text("1")
    assert files.resolve_set(spark, {"generated": [str(tmp_path / "g/x")], "precomputed": [str(made / "x")]})[0] == "precomputed"
    with pytest.raises(FileNotFoundError):
        files.resolve_set(spark, {"generated": [str(tmp_path / "g/x")]}, "generated")
    assert files.first_folder_with(spark, [str(tmp_path), str(made)], ["x"]) == str(made)
    work = spark.range(4).select(F.col("id").alias("year"))
    calls = []
    c = files.Checkpoint(spark, str(tmp_path / "ck"), {"a": 1}, ["year"])
    compute = lambda w: (calls.append(w.count()), w.withColumn("v", F.col("year") * 2))[1]
    assert c.run(work.filter("year < 2"), compute).count() == 2 and c.run(work, compute).count() == 4 and calls == [2, 2]
    assert files.Checkpoint(spark, str(tmp_path / "ck"), {"a": 2}, ["year"]).done() is None
    out = lambda name: lambda s, p: s.range(3).write.mode("overwrite").parquet(p[name])
    r = Runner(spark, str(tmp_path / "run"), [Step("b", lambda s, p: s.read.parquet(p["one"]).write.parquet(p["two"]), ("one",), ("two",)), Step("a", out("one"), (), ("one",))])
    assert [s.id for s in r.order()] == ["a", "b"] and r.run().filter("success").count() == 2
    assert r.run(resume=True).count() == 2 and sorted(r.clean()) == ["one", "two"]
    with pytest.raises(StepError):
        Runner(spark, str(tmp_path / "bad"), [Step("x", lambda s, p: None, (), ("never",))]).run()
    assert files.exists(spark, str(tmp_path / "bad/run_manifest")) and r.environment().count() > 3
    with pytest.raises(ValueError):
        files.delete_outputs(spark, str(tmp_path), ["../x"])


def test_mode_nearest_and_lattice(spark):
    rows = spark.createDataFrame([(1, 0, -1), (2, 0, 0), (3, 0, 0), (4, 0, -1), (5, 1, 1)], "o int, k int, v int")
    got = {r.k: (r.v, r.n_records) for r in R.mode_first(rows, ["k"], "v", "o").collect()}
    assert got == {0: (-1, 4), 1: (1, 1)}
    near = spark.createDataFrame([(1798,), (1895,), (None,)], "y int").select("y", R.nearest_value(F.col("y"), [1776, 1820, 1851, 1880, 1910]).alias("n"))
    assert {r.y: r.n for r in near.collect()} == {1798: 1776, 1895: 1880, None: None}
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(0, 10, (40, 2))], "lon double, lat double")
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 10, (60, 2)))], "cell_id int, glon double, glat double")
    from fieldloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    small = {(r.lon, r.lat): r.cell_id for r in R.nearest_cell(pts, grid).collect()}
    assert small == {(r.lon, r.lat): r.cell_id for r in R.nearest_cell(pts, grid, small=10).collect()}
    far = spark.createDataFrame([(200.0, 5.0), (-1e6, 3.0), (5.0, 9e4), (4.0, None), (float("nan"), 1.0)], "lon double, lat double")
    near = {(str(r.lon), r.lat): (r.cell_id, r.d2) for r in R.nearest_cell(far, grid).collect()}
    assert near == {(str(r.lon), r.lat): (r.cell_id, r.d2) for r in R.nearest_cell(far, grid, small=10).collect()}
    assert near[("200.0", 5.0)][0] is not None and near[("4.0", None)] == near[("nan", 1.0)] == (None, None)


def test_expectations(spark):
    f = spark.createDataFrame([(1, 1.0, 1900), (1, float("nan"), 1902), (2, None, 1901)], "k int, v double, year int")
    assert expect.missing_columns(f, ["k", "z"]) == ["z"]
    with pytest.raises(expect.ExpectationError):
        expect.require_exact_columns(f, ["v", "k", "year"])
    assert {r.column: r.n for r in expect.not_finite(f, ["k", "v"]).collect()} == {"v": 2}
    assert {(r.k, r.year) for r in expect.missing_steps(f, ["k"], "year", 1900, 1902).collect()} == {(1, 1901), (2, 1900), (2, 1902)}
    assert {(r.k, r.problem) for r in expect.unexpected_entities(f, "k", [2, 3]).collect()} == {(1, "unexpected"), (3, "missing")}
    with pytest.warns(UserWarning):
        expect.headline(f, "rows", 4)
    with pytest.raises(expect.ExpectationError):
        expect.require_none(R.duplicate_keys(f, ["k"]), "keys")
    a = spark.createDataFrame([(1, 1.0, 2.0)], "location_id int, lon double, lat double")
    assert expect.aligned(a, a.withColumn("z", F.lit(1)), "location_id").count() == 1


def test_filter_matches_arrays(spark):
    rng = np.random.default_rng(7)
    n = 25
    obs = [None if i % 4 == 0 else float(v) for i, v in enumerate(rng.normal(size=n))]
    rows = [("s", t, 0.3, 0.5, 0.4, obs[t], 0.1, -0.02 if t == 3 else 0.9, 0.2) for t in range(n)]
    got = statespace.filter_series(spark.createDataFrame(rows, "site string, t int, mu double, slope double, r2 double, obs double, alpha double, beta double, vdelta double"), ["site"]).orderBy("t").collect()
    beta = np.array([r[7] for r in rows])
    want = statespace.np_filter_smooth(np.full(n, 0.3), np.full(n, 0.5), np.full(n, 0.4), np.array([np.nan if v is None else v for v in obs]), np.full(n, 0.1), beta, np.full(n, 0.2))
    for a, b in (("m", "m"), ("p", "p"), ("m_smooth", "m_smooth"), ("p_smooth", "p_smooth")):
        assert np.allclose([r[a] for r in got], want[b], atol=1e-10)


def test_depth_and_boxplot(spark):
    curves = spark.createDataFrame([(c, x, float(c + (10 if c == 4 else 0))) for c in range(5) for x in range(6)], "c int, x int, v double")
    depth = {r.c: r.depth for r in functional.modified_band_depth(curves, "c", "x", "v").collect()}
    assert max(depth, key=depth.get) == 2
    _, members = functional.functional_boxplot(curves, "c", "x", "v")
    assert {r.c for r in members.filter("outlier").collect()} == {4}


def test_prior_on_frames(spark):
    rng = np.random.default_rng(3)
    rows = [("a", m, y, float(rng.normal())) for m in range(4) for y in range(1368, 1388)]
    sites = prior.matrices(spark.createDataFrame(rows, "site string, member int, year int, value double"))
    best = prior.best_weights(prior.cross_validate(sites, weights=(1.0, 100.0), parts=2, rounds=5))
    fits = prior.fit_sites(sites, best)
    assert fits.count() == 2 * (20 + 19 + 20) and fits.filter("parameter = 'r2' and value <= 0").count() == 0


def test_logistic_recovers_slope(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    data = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, rng.uniform(0, 1, 3000))], "x double, y double, t double")
    small, large = glm.fit_logistic(data, "y", [glm.linear("x")]), glm.fit_logistic(data, "y", [glm.linear("x"), glm.smooth("t", 0, 1, 6)])
    assert small.beta[1] == pytest.approx(1.2, abs=0.15)
    p = glm.nested_tests(spark, {"s": small, "l": large}, [("s", "l")]).first().p
    assert p > 0.001 and glm.model_table(spark, {"s": small}).first().explained > 0.1


def test_prior_weights_and_windows(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2)], "k string, t int")
    assert sorted((r.k, r.t) for r in R.within_windows(f, [("a", 1, 3), ("b", 2, 9)], "k", "t").collect()) == [("a", 2), ("a", 3)]
    assert sorted((r.k, r.t) for r in R.without_positions(f, ["k"], "t", [2]).collect()) == [("a", 1), ("a", 3), ("b", 2)]
    with pytest.raises(ValueError):
        R.report(f, "Rows", most=1)
    assert "k = a" in R.report(f, "Rows") and R.joined_one_to_one(f, f.withColumn("z", F.lit(1)), ["k", "t"]).count() == 4
    with pytest.raises(ValueError):
        R.joined_one_to_one(f, f.filter("t = 1"), ["k", "t"])
    assert R.with_alias(f, "year", "t").columns == ["k", "year"]


def test_grid(spark):
    assert grids.half_degree_grid(spark, 98.25, 18.25, 53, 49).select("lon", "lat").distinct().count() == 2597


def test_quoted_paths_and_quantiles(spark, tmp_path):
    from statistics import NormalDist

    from fieldloom.functions.normal import norm_quantile
    from fieldloom.sources import files

    odd = str(tmp_path / "it's [a] {b}*")
    spark.range(3).write.parquet(odd)
    assert spark.read.parquet(files.literal_glob(odd)).count() == 3
    assert spark.sql(f"SELECT {files.quoted(odd)} AS p").first().p == odd
    ps = [1e-300, 1e-20, 1e-6, 0.02, 0.02425, 0.3, 0.5, 0.7, 0.98, 1 - 1e-9]
    got = [r.x for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").coalesce(1).select(norm_quantile(F.col("p")).alias("x")).collect()]
    assert got[len(ps) :] == [None] * 3 and all(x == pytest.approx(NormalDist().inv_cdf(p), rel=1e-7, abs=1e-12) for x, p in zip(got, ps))

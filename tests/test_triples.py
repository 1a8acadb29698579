from fieldloom.sources import files, xlsx


def test_triples_keep_values_alone(spark, tmp_path):
    row = lambda year, values: ["x", year, "y", *[c for v in values for c in (v, "a & b", 9)]]
    xlsx.write_rows(str(tmp_path / "a.xlsx"), [row(1900, [1.5, None, "missing"]), row(1901, [-2, 0.0, 3])], ["id", "year", "kind"] + ["v", "f", "g"] * 3)
    got = sorted(map(tuple, xlsx.read_triples(spark, str(tmp_path / "a.xlsx"), {"year": 2}, groups=3).collect()), key=lambda r: r[:2])
    assert got == [(1900, 1, 1.5), (1900, 2, None), (1900, 3, None), (1901, 1, -2.0), (1901, 2, 0.0), (1901, 3, 3.0)]


def test_inferred_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,t\n1,NA,a\n2,1.5,NA\n")
    frame = files.read_csv_inferred(spark, str(tmp_path))
    assert frame.dtypes == [("n", "int"), ("x", "double"), ("t", "string")] and sorted(map(tuple, frame.collect())) == [(1, None, "a"), (2, 1.5, None)]

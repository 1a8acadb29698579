"""Additive models of a response that does not vary."""

import pytest

from fieldloom.operators import glm


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_a_constant_response_has_no_explained_share(spark, value):
    rows = spark.range(60).selectExpr(f"{value}D AS r", "id % 7 / 3.0D AS x", "CAST(id AS double) AS year")
    fits = {"one": glm.fit_logistic(rows, "r", [glm.smooth("year", 0.0, 59.0, 6), glm.linear("x")])}
    (row,) = glm.model_table(spark, fits).collect()
    assert row.explained is None and row.n == 60 and 0 <= row.deviance < 1e-3

"""Distributed ranks, running sums and quantiles against numpy, with a value holding a third of all rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ordering as O


def skewed(n=5000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n).round(2) * 10)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x})


@pytest.mark.parametrize("buckets", [4, 256])
def test_quantiles_match_numpy(spark, buckets):
    pdf = skewed()
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    whole = O.exact_quantiles(df, ["x"], probs, buckets=buckets).first()
    for name, p in probs.items():
        assert whole[name] == pytest.approx(np.nanquantile(pdf["x"], p))
    for row in O.exact_quantiles(df, ["x"], probs, ["g"], buckets=buckets).collect():
        part = pdf[pdf["g"] == row["g"]]["x"]
        assert row["n"] == part.notna().sum()
        assert row["q3"] == pytest.approx(np.nanquantile(part, 0.9))


def test_average_ranks(spark):
    pdf = skewed(2000)
    got = O.average_ranks(spark.createDataFrame(pdf), "x", ["g"]).toPandas()
    pdf["avg_rank"] = pdf.groupby("g")["x"].rank()
    want = pdf.groupby(["g", "x"])["avg_rank"].first()
    merged = got.set_index(["g", "x"])["avg_rank"]
    pd.testing.assert_series_equal(merged.sort_index(), want.sort_index())


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(3000).withColumn("key", (F.col("id") * 7919) % 100003).withColumn("g", F.col("id") % 2)
    got = O.row_numbers(df, ["key"], "n", ["g"], size="total").toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("key")
        assert list(part["n"]) == list(range(1, len(part) + 1))
        assert (part["total"] == len(part)).all()


def test_digest_buckets_follow_the_digest_and_spread(spark):
    digest, bucket = O.digest_order("id", seed=3)
    got = spark.range(2000).select("id", digest.alias("h"), bucket.alias("b")).sort("h").toPandas()
    assert got["b"].is_monotonic_increasing and got["b"].between(0, (1 << O.HASH_BITS) - 1).all()
    assert got["b"].nunique() > 1900
    want = [int(hashlib.md5(f"{i}:3".encode()).hexdigest()[:15], 16) for i in got["id"]]
    assert list(got["h"]) == want


def test_modes_break_ties_to_the_smallest(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    row = O.modes(df, ["x", "y"]).first()
    assert row["x"] == "a" and row["y"] is None


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert O.exact_quantiles(empty, ["x"], {"m": 0.5}).count() == 0
    assert O.medians(empty, ["x"]).first()["x"] is None
    assert O.modes(empty, ["s"]).first()["s"] is None


@pytest.mark.parametrize("rows", [10_000, 3])
def test_lookups_by_map_and_by_salted_join_agree(spark, monkeypatch, rows):
    from panelwright.operators import ordering

    monkeypatch.setattr(ordering, "LOOKUP_ROWS", rows)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id long, key string")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 60, 6)], (None, 7)], "name string, code int")
    got = {r.id: r.code for r in ordering.looked_up(df, "key", table, "name", "code", "code").collect()}
    assert got == {**{i: 1 if i % 3 else (i if i % 6 == 0 else None) for i in range(60)}, 99: None}

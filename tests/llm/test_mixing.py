import math
from collections import Counter

from pyspark.sql import functions as F

from quadrille.llm import mixing

from . import cases


def test_poisson_counts(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 9) as text", "if(id % 4 = 0, 'b', 'a') as source")
    found = mixing.mixed(docs, {"b": 3.0}, seed=1).collect()
    share = Counter(r.source for r in found)
    assert abs(share["b"] / len(found) - 0.75) < 0.04 and abs(len(found) - 4000) < 250
    times = Counter(Counter(r.doc_id for r in found if r.source == "b").values())
    for k in range(1, 6):  # mean 3
        assert abs(times[k] / 1000 - math.exp(-3) * 3**k / math.factorial(k)) < 0.05
    again = mixing.mixed(docs.repartition(9), {"b": 3.0}, seed=1).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) and found != sorted(found)


def test_places_are_global(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'some text' as text", "'a' as source", "1 as copy", "2 as place")
    found = mixing.mixed(docs, epochs=3.0)
    assert found.columns == ["doc_id", "text", "source", "copy", "place", "copy_", "place_"]
    places = [r.place_ for r in found.collect()]
    assert places == sorted(places) and len(set(places)) == len(places)


def test_large_rates_and_zero_weights(spark):
    docs = spark.createDataFrame([(1, "x" * 4, "small"), (2, "y" * 100_000, "large"), (3, "z", "none")], "doc_id long, text string, source string")
    n = Counter(r.doc_id for r in mixing.mixed(docs, {"none": 0.0}, epochs=1.0).collect())
    assert n[3] == 0 and abs(n[1] - 10_000) < 500


def test_rates_beyond_any_table(spark):
    """A rate of 1e10 is a sum of parts whose table stays small; 5e4 copies are drawn through parts."""
    table = spark.createDataFrame([("a", 1e10), ("b", 5e4), ("c", 2.5), (None, 0.0)], "source string, rate double")
    got = {r.source: r for r in mixing.distributions(table).collect()}
    assert all(len(r.cdf) < mixing.STRIDE and r.parts * mixing.LARGEST >= r.rate for r in got.values())
    assert got["c"].parts == 1 and got["a"].parts == 2_441_407 and all(abs(r.cdf[-1] - 1) < 1e-9 for r in got.values())
    docs = spark.createDataFrame([(1, "", "small"), (2, "y" * 99_999, "large")], "doc_id long, text string, source string")
    found = mixing.mixed(docs).where("doc_id = 1")
    assert abs(found.count() - 50_000) < 1500 and found.select("copy").distinct().count() == found.count()


def test_columns_of_any_name(spark):
    names = ["_cdf", "_times", "_source", "_own", "_salt", "own", "salt", "of", "parts", "part", "cdf", "u", "times", "id", "row", "a.b"]
    docs = cases.table(spark).drop("copy")
    plain = mixing.mixed(docs, {"a": 2.0}, epochs=4.0)
    more = docs
    for i, name in enumerate(names):
        more = more.withColumn(name, F.lit(f"own {i}"))
    found = mixing.mixed(more, {"a": 2.0}, epochs=4.0)
    assert found.columns == [*more.columns, "copy", "place"]
    assert all(r[name] == f"own {i}" for r in found.collect() for i, name in enumerate(names))
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_cases_and_salted_join(spark, monkeypatch):
    docs = cases.table(spark)
    plain = sorted(map(str, mixing.mixed(docs, {"a": 2.0}, epochs=4.0).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_VALUES", 0)
    assert plain == sorted(map(str, mixing.mixed(docs, {"a": 2.0}, epochs=4.0).collect())) and plain
    assert mixing.mixed(cases.empty(spark)).count() == 0

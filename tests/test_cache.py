from quadrille.plans import cache


def test_features_by_key(spark, tmp_path):
    path = str(tmp_path / "f")
    cache.write_features(spark.createDataFrame([(f"k{i % 5}", i) for i in range(20)], "key string, x int"), path)
    cache.write_features(spark.createDataFrame([("new", 99)], "key string, x int"), path)
    got = cache.read_features(spark, path, spark.createDataFrame([("k1",), ("new",), ("none",), ("k1",)], "key string"))
    assert sorted((r.key, r.x) for r in got.collect()) == [("k1", i) for i in (1, 6, 11, 16)] + [("new", 99)]


def test_mappings_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (2, 0, 7)], "sheet_id long, ci int, oi int")
    columns = spark.createDataFrame([(1, 0, 2), (2, 0, 0)], "sheet_id long, ci int, oi int")
    sizes = spark.createDataFrame([(1, 9, 4), (2, 8, 1)], "sheet_id long, n_rows int, n_cols int")
    records = cache.mapping_records(rows, columns, sizes)
    assert {r.sheet_id: r.record for r in records.collect()}[1] == '{"original_shape":[9,4],"row_mapping":{"0":0,"1":5},"col_mapping":{"0":2}}'
    back = cache.read_mappings(records)
    for a, b in zip(back, (rows, columns, sizes)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

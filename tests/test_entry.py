import __spark_entry__ as entry


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_flagship(spark):
    assert entry.queries()["equalized_statistics"](spark, "/root/testdata/sf0.001").columns == ["image_id", "frame_no", "mean_l", "min_l", "max_l", "n"]

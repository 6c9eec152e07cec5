from pixelquarry.llm import decontaminate, ngram_join

NEAR = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"v{i}" for i in range(40))


def test_one_row_of_each_component_on_repeated_and_null_ids(spark):
    rows = [(1, NEAR), (1, NEAR), (2, NEAR), (2, OTHER), (None, NEAR), (None, "p q r s t u"), (None, "p q r s t u"), (None, ""), (4, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, NEAR), (2, OTHER), (None, "p q r s t u"), (None, ""), (4, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_a_leak_takes_its_own_row_only(spark):
    rows = [(None, OTHER), (1, OTHER), (1, NEAR), (None, NEAR)]
    items = spark.createDataFrame([(9, OTHER)], "item_id long, text string")
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, NEAR), (None, NEAR)]))

import datetime

import __spark_entry__ as entry
import duckdb
from pixelquarry.plans import rasters


def _events(spark, folder, ids):
    """A table of events of these ids; the k-th row has user k."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, k, k / 100, start + datetime.timedelta(seconds=k)) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return rows


def _pixels(rows):
    return {(r["image_id"], r["frame_no"], r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in rows}


def test_no_event_is_left_out(spark, tmp_path):
    ids = [i for i in range(-1024, 2048) if i != 7] + [5, 5, 2047, None, *range(3072, 3172)]  # a gap, repeats, an image of 100 events, an id without events before it
    rows = _events(spark, tmp_path, ids)
    got = rasters.events_px(spark, str(tmp_path)).collect()
    seen, want = {}, {}
    for i, user, _, _ in rows:
        if i is None:
            continue
        again = seen[i] = seen.get(i, -1) + 1
        want[(i // 1024 + 5 * again, 0, i % 1024 // 32, i % 32)] = user % 256
    pixels = _pixels(got)
    assert len(got) == len(pixels) == 1024 * len({k[0] for k in want})
    assert {k: pixels[k][0] for k in want} == want
    assert all(v == (0, 0, 0, 0) for k, v in pixels.items() if k not in want)
    assert {k[0] for k in want} == {-1, 0, 1, 3, 5, 6, 10}
    twin = duckdb.sql(f"SELECT * FROM {rasters.events_sql(f'read_parquet({str(tmp_path / "events.parquet") + "/*.parquet"!r})')}").fetchall()
    assert sorted(map(tuple, got)) == sorted(twin)


def test_every_event_of_the_given_tables(spark):
    for sf, events, images in (("sf0.001", 1000, 1), ("sf0.01", 10000, 10)):
        got = rasters.events_px(spark, f"/root/testdata/{sf}").selectExpr("count(*) AS n", "count_if(a > 0) AS there").first()
        assert (got["n"], got["there"]) == (images * 1024, events)


def test_flagship_has_rows(spark):
    got = entry.entry(spark).collect()
    assert [(r["image_id"], r["n"]) for r in got] == [(0, 1024)]

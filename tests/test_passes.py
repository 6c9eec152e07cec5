"""Steps over frames share a Python worker and take parts of a batch: neither their number nor the table's size is in the memory of a task."""

import numpy as np
import pytest
from pixelquarry import frames
from pixelquarry.kernels import convolve
from pixelquarry.plans import registry
from pixelquarry.sources import files

KERNELS = "diffuse_burks oil_paint edges_laplacian_3x3 edges_kirsch edges_laplacian_5x5 gaussian_sharpen resize_min resize_crop_top resize_robidoux resize_spline resize_bicubic quantize_tree chain_blur_edges adaptive_threshold".split()
CLONES = [name for name in registry.queries() if name.startswith("clone_as_")]
FILES = [name for name in registry.queries() if name.startswith("round_trip_")] + ["first_frames_target_size"]


def side_by_side(node, above=0):
    """The most nodes of a plan that run Python within one stage."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return side_by_side(node.executedPlan(), above)
    above = 0 if "Exchange" in name else above + ("Python" in name or "InArrow" in name)
    below = node.children()
    return max([above, *(side_by_side(below.apply(k), above) for k in range(below.size()))])


def workers(df):
    return side_by_side(df._jdf.queryExecution().executedPlan())


def made(spark, *shapes):
    r = np.random.default_rng(3)
    rows = [(i, 0, r.integers(0, 256, (*s, 4)).astype(np.uint8)) for i, s in enumerate(shapes)]
    return rows, spark.createDataFrame(frames.batch_of(rows).to_pandas(), frames.DDL)


@pytest.mark.parametrize("group", [CLONES, KERNELS, FILES], ids=["clones", "kernels", "files"])
def test_a_task_of_a_query_has_one_worker(spark, group):
    queries = registry.queries()
    assert {name: workers(queries[name](spark, "/root/testdata/sf0.001")) for name in group} == dict.fromkeys(group, 1)


def test_steps_that_share_a_pass_give_what_they_give_alone(spark):
    _, table = made(spark, (4, 6), (5, 5), (1, 1))
    px = frames.explode(table).cache()
    steps = [frames.assemble, lambda d: frames.process(d, convolve.box_blur, 1), lambda d: files.encode(d, "png"), files.decode, lambda d: frames.clone_as(d, "Bgra4444"), lambda d: frames.clone_as(d, "Rgba32"), frames.explode]
    shared = alone = px
    for step in steps:
        shared = step(shared)
    assert workers(shared) == 1
    got = sorted(shared.collect())
    for step in steps:
        alone = step(alone).cache()
        alone.count()
    assert len(got) == 24 + 25 + 1 and got == sorted(alone.collect())


def test_what_is_cached_or_filtered_is_not_run_again_by_the_next_step(spark):
    _, table = made(spark, (4, 6), (5, 5))
    kept = frames.process(table, convolve.box_blur, 1).cache()
    assert kept.count() == 2
    plan = frames.explode(kept)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    one = frames.process(table, convolve.box_blur, 1).filter("image_id = 1")
    assert frames.explode(one).count() == 25
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        frames.explode(files.encode(table, "png"))


def test_a_kernel_gets_parts_of_a_batch(spark):
    def sizes(v):
        raise AssertionError

    sizes.many = lambda v: np.full(v.shape, len(v) / 1000)
    def given(n, side):
        many = spark.range(n, numPartitions=1).selectExpr("id AS image_id", "0 AS frame_no", f"{side} AS width", f"{side} AS height", f"CAST(repeat('abcd', {side * side}) AS BINARY) AS pixels")
        got = frames.process(many, sizes).selectExpr("image_id", "conv(hex(substring(pixels, 1, 1)), 16, 10) / 255 * 1000 AS n").collect()
        assert sorted(r["image_id"] for r in got) == list(range(n))
        return max(r["n"] for r in got)

    assert given(800, 32) < 260
    assert 24 < given(60, 200) < 30  # larger frames still come together


def test_pixels_of_a_large_frame_leave_in_parts(spark):
    rows, table = made(spark, (301, 299), (2, 3))
    at = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in frames.explode(table).collect()}
    assert len(at) == 301 * 299 + 6
    assert all(at[i, y, x] == tuple(a[y, x].tolist()) for i, _, a in rows for y in range(a.shape[0]) for x in range(a.shape[1]))
    parts = frames.one_pass(frames.explode(table), ("image_id",), lambda bs: (b.select(["image_id"]).slice(0, 1) for b in bs), "image_id long")
    assert parts.count() > 2

"""Drawn pixels and frames are never taken for small enough to broadcast."""

from laminar.operators import gaps as A
from laminar.operators import runs as R
from laminar.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_estimated_by_their_number(spark):
    px = fx.leaf_px(spark, SF)
    guess = int(str(px._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert guess >= 200 * fx.SIDE * fx.SIDE * 8


def test_class_clip_does_not_broadcast_pixels(spark):
    px = fx.leaf_px(spark, SF)
    out = R.clip_classes(px.select("leaf_id", "y", "x", "cls"), R.to_runs(px.where("sil = 1")))
    assert "BroadcastHashJoin" not in _plan(out)


def test_frames_are_not_broadcast(spark):
    px = fx.leaf_px(spark, SF)
    assert "BroadcastHashJoin" not in _plan(px.join(fx.leaf_frames(spark, SF), "leaf_id"))


def test_arcs_are_not_broadcast(spark):
    gaps = spark.range(50).selectExpr("id leaf_id", "0 gap_id", "cast(id % 6 as int) start_idx", "5 n_pts")
    points = spark.range(300).selectExpr("id div 6 leaf_id", "cast(id % 6 as int) i", "cast(id as int) px", "1 py")
    out = A.arc_points(gaps, points, n=6)
    assert "BroadcastHashJoin" not in _plan(out)
    assert out.count() == 250


def test_pixels_stay_spread_by_leaf(spark):
    px = fx.leaf_px(spark, SF)
    assert _plan(R.to_runs(px.where("tissue = 1"))).count("Exchange hashpartitioning") == 1


def test_adaptive_closing_reads_its_runs_a_fixed_number_of_times(spark):
    from laminar.plans.q_masks import tissue

    t, fr = tissue(spark, SF)
    closed = R.close_adaptive(t, fr)
    # runs and their areas, for the closed and the small leaves, and the areas again for the frames of both steps
    assert closed._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("LogicalRDD") <= 6


def test_lines_of_large_leaves_are_estimated_by_their_number(spark):
    from laminar.plans.q_bites import large_leaves

    runs, frames = large_leaves(spark, SF)
    guess = int(str(runs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert guess >= runs.count() * 8
    assert "BroadcastHashJoin" not in _plan(runs.join(frames, "leaf_id"))


def test_whitened_pixels_are_not_exchanged(spark):
    from laminar.operators import raster as P

    px = fx.leaf_px(spark, SF)
    out, _ = P.normalise_bg(px, fx.leaf_frames(spark, SF))
    # only leaves travel: no exchange by scan line or pixel
    moved = [line for line in _plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if " y#" in line or " x#" in line]
    assert out.columns == px.columns
    assert out.count() == px.count()


def test_contrast_does_not_exchange_pixels(spark):
    from laminar.operators import detectors as D

    px = fx.leaf_px(spark, SF)
    dropped = D._contrast(px, fx.leaf_frames(spark, SF), 11)
    moved = [line for line in _plan(dropped).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if " y#" in line or " x#" in line]
    assert dropped.count() == px.count()


def test_mask_queries_draw_no_colours(spark):
    masks, px = fx.leaf_masks(spark, SF), fx.leaf_px(spark, SF)
    assert px.select(*masks.columns).exceptAll(masks).isEmpty() and masks.count() == px.count()
    only = R.to_runs(masks.where("tissue = 1"))
    assert "inline" not in _plan(only) and _plan(only).count("Exchange hashpartitioning") == 1

"""Queries over the run algebra, components and shape operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import runs as R
from ..session import cut_lineage
from . import fixtures as fx
from .oracle import Steps
from .registry import query


def digest(runs: DataFrame) -> DataFrame:
    """Pixel count and coordinate sums per key: equal digests, equal masks."""
    keys = R.keys_of(runs)
    n = (F.col("x1") - F.col("x0")).cast("long")
    sx = n * (F.col("x0") + F.col("x1") - 1) / 2
    return runs.groupBy(*keys).agg(
        F.sum(n).cast("long").alias("px"),
        F.sum(sx).cast("long").alias("sum_x"),
        F.sum(n * F.col("y")).cast("long").alias("sum_y"),
        F.sum(sx * F.col("y")).cast("long").alias("sum_xy"),
    )


def leaves(spark, sf, **layers):
    """Leaf rasters as named run layers plus their frames."""
    px = fx.leaf_masks(spark, sf)
    named = cut_lineage(R.to_runs(px, {k: F.expr(v) for k, v in layers.items()}))
    return named, fx.leaf_frames(spark, sf)


def tissue(spark, sf):
    return cut_lineage(R.to_runs(fx.leaf_masks(spark, sf).where("tissue = 1"))), fx.leaf_frames(spark, sf)


# --- pixels and runs -------------------------------------------------------

_s = Steps()


@query(_s.select(f"select leaf_id, y, x0, x1 from {_s.add('select * from ' + _s.runs(_s.layer('tissue=1')))}"))
def pixels_to_runs(spark, sf):
    return tissue(spark, sf)[0]


@query(Steps().select("select leaf_id, y, x from leaf_px where tissue=1"))
def runs_to_pixels(spark, sf):
    return R.to_pixels(tissue(spark, sf)[0])


def _two(s):
    return s.layer("tissue=1"), s.layer("dmg=1 or frass=1")


def _op(fn):
    s = Steps()
    return s.digest(fn(s))


@query(_op(lambda s: s.either(*_two(s))))
def mask_union(spark, sf):
    m, _ = leaves(spark, sf, a="tissue=1", b="dmg=1 or frass=1")
    return digest(R.mask_or(R.pick(m, "a"), R.pick(m, "b")))


@query(_op(lambda s: s.both(*_two(s))))
def mask_intersection(spark, sf):
    m, _ = leaves(spark, sf, a="tissue=1", b="dmg=1 or frass=1")
    return digest(R.mask_and(R.pick(m, "a"), R.pick(m, "b")))


@query(_op(lambda s: s.minus(*_two(s))))
def mask_difference(spark, sf):
    m, _ = leaves(spark, sf, a="tissue=1", b="dmg=1 or frass=1")
    return digest(R.mask_diff(R.pick(m, "a"), R.pick(m, "b")))


@query(_op(lambda s: s.invert(s.layer("tissue=1"))))
def mask_complement(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.mask_not(t, fr))


@query(
    Steps().select(
        "select leaf_id, case when bite=1 or sil=0 then 0 else cls end cls, count(*)::bigint n, sum(x*y)::bigint sum_xy from leaf_px group by all"
    )
)
def class_map_clip(spark, sf):
    px = fx.leaf_masks(spark, sf)
    roi = R.to_runs(px.where("sil = 1 and bite = 0"))
    out = R.clip_classes(px.select("leaf_id", "y", "x", "cls"), roi)
    return out.groupBy("leaf_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).cast("long").alias("sum_xy")
    )


@query(_op(lambda s: s.dilate(s.layer("tissue=1"), R.square_kernel(5))))
def dilation_square(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.dilate_square(t, 5, fr))


@query(_op(lambda s: s.dilate(s.layer("tissue=1"), R.ellipse_kernel(5))))
def dilation_ellipse(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.dilate_ellipse(t, 5, fr))


@query(_op(lambda s: s.erode(s.layer("tissue=1"), R.ellipse_kernel(3))))
def erosion_ellipse(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.erode_ellipse(t, 3, fr))


@query(_op(lambda s: s.open(s.layer("tissue=1"), R.ellipse_kernel(5))))
def opening(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.morph_open(t, R.ellipse_kernel(5), fr))


@query(_op(lambda s: s.close(s.layer("tissue=1"), R.ellipse_kernel(5), 2)))
def closing_twice(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.morph_close(t, R.ellipse_kernel(5), fr, 2))


def _adaptive_sql():
    s = Steps()
    m = s.layer("tissue=1")
    big = s.add(f"select leaf_id from {m} group by leaf_id having count(*) >= 50")
    mb = s.add(f"select m.* from {m} m join {big} using (leaf_id)")
    closed = s.close(mb, R.ellipse_kernel(17))
    # a 32-pixel leaf never reaches an area that asks for more than radius 8
    small = s.add(f"select m.* from {m} m anti join {big} using (leaf_id)")
    return s.digest(s.either(s.both(closed, s.add(f"select fr.* from fr join {big} using (leaf_id)")), small))


@query(_adaptive_sql())
def closing_adaptive(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(R.close_adaptive(t, fr))


@query(_op(lambda s: s.fill(s.layer("tissue=1"))))
def hole_filling(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(C.fill_holes(t, fr))


@query(_op(lambda s: s.both(s.holes(s.layer("tissue=1")), s.layer("sil=1"))))
def internal_holes(spark, sf):
    m, fr = leaves(spark, sf, tissue="tissue=1", sil="sil=1")
    return digest(C.internal_holes(R.pick(m, "tissue"), R.pick(m, "sil"), fr))


# second mask used as "the other model's answer": the silhouette shifted by 2
_SHIFT = "select leaf_id, y, x+2 x from leaf_px where sil=1 and x+2 < 32"


def _shifted(spark, sf):
    px = fx.leaf_masks(spark, sf)
    a = R.to_runs(px.where("tissue = 1"))
    b = R.to_runs(px.where("sil = 1 and x + 2 < 32").withColumn("x", F.col("x") + 2))
    return a, b, fx.leaf_frames(spark, sf)


def _merge_sql(mode):
    s = Steps()
    a, b = s.layer("tissue=1"), s.add(_SHIFT)
    if mode == "union":
        return s.digest(s.either(a, b))
    if mode == "intersection":
        return s.digest(s.both(a, b))
    if mode == "mobilesam_primary":
        inner = s.erode(b, R.square_kernel(20))
        return s.digest(s.either(inner, s.both(a, b)))
    return s.digest(s.both(a, s.dilate(b, R.square_kernel(15))))


@query(_merge_sql("union"))
def merge_mode_union(spark, sf):
    a, b, fr = _shifted(spark, sf)
    return digest(R.merge_masks(a, b, "union", fr))


@query(_merge_sql("intersection"))
def merge_mode_intersection(spark, sf):
    a, b, fr = _shifted(spark, sf)
    return digest(R.merge_masks(a, b, "intersection", fr))


@query(_merge_sql("mobilesam_primary"))
def merge_mode_second_primary(spark, sf):
    a, b, fr = _shifted(spark, sf)
    return digest(R.merge_masks(a, b, "mobilesam_primary", fr))


@query(_merge_sql("birefnet_primary"))
def merge_mode_first_primary(spark, sf):
    a, b, fr = _shifted(spark, sf)
    return digest(R.merge_masks(a, b, "birefnet_primary", fr))


def _refine_sql():
    s = Steps()
    a, b = s.layer("tissue=1"), s.add(_SHIFT)
    return s.digest(s.either(s.erode(a, R.square_kernel(5)), s.both(a, b)))


@query(_refine_sql())
def boundary_refinement(spark, sf):
    a, b, fr = _shifted(spark, sf)
    return digest(R.refine_boundary(a, b, fr, 5))


_BOX = """box as (select leaf_id, min(x) bx0, min(y) by0, max(x)+1 bx1, max(y)+1 by1 from leaf_px where sil=1 group by leaf_id),
ebox as (select leaf_id, greatest(0,bx0-m) ex0, greatest(0,by0-m) ey0, least(32,bx1+m) ex1, least(32,by1+m) ey1
 from (select *, cast(floor(greatest(bx1-bx0,by1-by0)*0.25) as int) m from box))"""


def _box_sql():
    s = Steps()
    s.parts.append(_BOX)
    return s.select(
        "select e.*, count(*)::bigint px from ebox e join fr on fr.leaf_id=e.leaf_id and y>=ey0 and y<ey1 and x>=ex0 and x<ex1 group by all"
    )


@query(_box_sql())
def box_with_margin(spark, sf):
    px = fx.leaf_masks(spark, sf)
    st = C.component_stats(R.to_runs(px.where("sil = 1")))
    boxes = st.join(fx.leaf_frames(spark, sf), "leaf_id").select("leaf_id", "bx0", "by0", "bx1", "by1", "h", "w")
    region = R.box_region(boxes, 0.25)
    return region.join(R.area(R.box_runs(region), "px"), "leaf_id")


def _rembox_sql():
    s = Steps()
    s.parts.append("box as (select leaf_id, min(x) bx0, min(y) by0, max(x)+1 bx1, max(y)+1 by1 from leaf_px where frass=1 group by leaf_id)")
    m = s.add(
        "select p.leaf_id,y,x from leaf_px p join box b using (leaf_id) where tissue=1 and not (x>=bx0-3 and x<bx1+3 and y>=by0-3 and y<by1+3)"
    )
    return s.digest(m)


@query(_rembox_sql())
def box_removal(spark, sf):
    m, _ = leaves(spark, sf, tissue="tissue=1", frass="frass=1")
    boxes = C.component_stats(R.pick(m, "frass")).select("leaf_id", "bx0", "by0", "bx1", "by1")
    return digest(R.remove_box(R.pick(m, "tissue"), boxes, 3))


def _cliproi_sql():
    s = Steps()
    return s.digest(s.both(s.layer("sil=1"), s.dilate(s.layer("dmg=1"), R.ellipse_kernel(7))))


@query(_cliproi_sql())
def clip_to_segmentation(spark, sf):
    m, fr = leaves(spark, sf, sil="sil=1", seg="dmg=1")
    return digest(R.clip_to_segmentation(R.pick(m, "sil"), R.pick(m, "seg"), fr, 7))


@query(
    Steps().select(
        f"""select a.leaf_id, inter_px, union_px, case when union_px>0 then inter_px/union_px else 0 end iou from
 (select leaf_id, count(*) filter (t=1 and s=1)::bigint inter_px, count(*) filter (t=1 or s=1)::bigint union_px from
   (select leaf_id,y,x,max(t) t,max(s) s from (select leaf_id,y,x,tissue t,0 s from leaf_px union all select leaf_id,y,x,0,1 from ({_SHIFT})) group by all) group by leaf_id) a"""
    )
)
def iou_of_masks(spark, sf):
    a, b, _ = _shifted(spark, sf)
    return R.mask_iou(a, b)


@query(
    Steps().select(
        """select leaf_id, count(*) filter (tissue=1)::bigint area, min(x) filter (tissue=1) bx0, min(y) filter (tissue=1) by0,
 max(x) filter (tissue=1)+1 bx1, max(y) filter (tissue=1)+1 by1, sum(2*x) filter (tissue=1)::bigint sum_2x,
 sum(y) filter (tissue=1)::bigint sum_y, (select max(n) from (select q.y, count(*) n from leaf_px q where q.leaf_id=p.leaf_id and tissue=1 group by q.y))::bigint max_width
 from leaf_px p group by leaf_id"""
    )
)
def row_profile_shape(spark, sf):
    return R.shape_sums(tissue(spark, sf)[0])


# --- components ------------------------------------------------------------


def _stats_sql():
    s = Steps()
    c = s.comp_px(s.layer("tissue=1"))
    return s.select(
        f"""select leaf_id, comp, count(*)::bigint area, min(x) bx0, min(y) by0, max(x)+1 bx1, max(y)+1 by1,
 avg(x) cx, avg(y) cy, (min(x)=0 or min(y)=0 or max(x)=31 or max(y)=31) touches_border from {c} group by leaf_id, comp"""
    )


@query(_stats_sql())
def component_statistics(spark, sf):
    t, fr = tissue(spark, sf)
    return C.component_stats(C.components(t, 8), fr)


def _labels4_sql():
    s = Steps()
    c = s.comps(s.layer("tissue=0"), 4)
    return s.select(f"select leaf_id, y, x0, x1, comp from {c}")


@query(_labels4_sql())
def components_4_connected(spark, sf):
    px = fx.leaf_masks(spark, sf)
    return C.components(R.to_runs(px.where("tissue = 0")), 4)


@query(_op(lambda s: s.largest(s.layer("tissue=1"))))
def largest_component(spark, sf):
    return digest(C.largest(tissue(spark, sf)[0]))


def _at_sql(fallback):
    s = Steps()
    c = s.comp_px(s.layer("cls in (1,2) or bite=1"))
    near = s.add(
        f"select leaf_id, comp, min((x-16)*(x-16)+(y-20)*(y-20)) d, min(y*64+x) filter (true) f, count(*) n,"
        f" min(((x-16)*(x-16)+(y-20)*(y-20))*100000 + y*100 + x) dk from {c} group by leaf_id, comp"
    )
    order = "dk" if fallback == "nearest" else "case when d=0 then 0 else 1 end, n desc, comp"
    cond = "and d=0" if fallback == "empty" else ""
    best = s.add(
        f"select leaf_id, comp from (select *, row_number() over (partition by leaf_id order by {order}) r from {near}) where r=1 {cond}"
    )
    return s.digest(s.add(f"select c.leaf_id,c.y,c.x from {c} c join {best} using (leaf_id, comp)"))


def _at(spark, sf, fallback):
    px = fx.leaf_masks(spark, sf)
    m = R.to_runs(px.where("cls in (1, 2) or bite = 1"))
    pts = fx.leaf_frames(spark, sf).select("leaf_id", F.lit(16).alias("px"), F.lit(20).alias("py"))
    return digest(C.component_at(m, pts, fallback))


@query(_at_sql("largest"))
def component_at_point_largest(spark, sf):
    return _at(spark, sf, "largest")


@query(_at_sql("nearest"))
def component_at_point_nearest(spark, sf):
    return _at(spark, sf, "nearest")


@query(_at_sql("empty"))
def component_at_point_empty(spark, sf):
    return _at(spark, sf, "empty")


@query(_op(lambda s: s.sized(s.layer("hole=1 or bite=1 or frass=1"), 4, 25)))
def component_area_range(spark, sf):
    px = fx.leaf_masks(spark, sf)
    return digest(C.filter_components(R.to_runs(px.where("hole=1 or bite=1 or frass=1")), 4, 25))


def _small_sql():
    s = Steps()
    m = s.layer("tissue=1")
    return s.digest(s.add(f"select * from {s.sized(m, 80)} union select * from {s.largest(m)}"))


def _rs_sql():
    s = Steps()
    c = s.comp_px(s.layer("tissue=1"))
    n = s.add(f"select leaf_id, comp, count(*) n from {c} group by all")
    ok = s.add(
        f"select leaf_id, comp from (select *, max(n) over (partition by leaf_id) mx, row_number() over (partition by leaf_id order by n desc, comp) r from {n}) where n>=80 or (mx<80 and r=1)"
    )
    return s.digest(s.add(f"select c.leaf_id,c.y,c.x from {c} c join {ok} using (leaf_id, comp)"))


@query(_rs_sql())
def small_component_removal(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(C.remove_small(t, fr))


def _inst_sql():
    s = Steps()
    c = s.comp_px(s.layer("hole=1 or frass=1 or (dmg=1 and sil=1)"))
    return s.select(
        f"""select leaf_id, comp, area, rx, ry, row_number() over (partition by leaf_id order by rx, ry, comp)::int leaf_index from (
 select *, row_number() over (partition by leaf_id order by area desc, comp) r from (
  select leaf_id, comp, count(*)::bigint area, cast(round_even(avg(x),0) as int) rx, cast(round_even(avg(y),0) as int) ry from {c} group by leaf_id, comp having count(*)>=3)) where r<=2"""
    )


@query(_inst_sql())
def leaf_instance_numbering(spark, sf):
    px = fx.leaf_masks(spark, sf)
    m = R.to_runs(px.where("hole=1 or frass=1 or (dmg=1 and sil=1)"))
    return C.leaf_instances(m, 3, 2).select("leaf_id", "comp", "area", "rx", "ry", "leaf_index")


def _frag_sql():
    s = Steps()
    c = s.comp_px(s.layer("tissue=1 and y % 11 <> 5"))
    n = s.add(f"select leaf_id, comp, row_number() over (partition by leaf_id order by count(*) desc, comp)::int frag from {c} group by leaf_id, comp having count(*)>=80")
    m = s.add(
        f"select c.leaf_id, frag, y, x from {c} c join {n} using (leaf_id, comp) union all"
        f" select c.leaf_id, 1, y, x from {c} c anti join {n} using (leaf_id)"
    )
    return s.digest(m, "leaf_id, frag")


@query(_frag_sql())
def tissue_fragments(spark, sf):
    m = R.to_runs(fx.leaf_masks(spark, sf).where("tissue = 1 and y % 11 <> 5"))
    return digest(C.split_fragments(m, fx.leaf_frames(spark, sf)))


def _island_sql():
    s = Steps()
    part = s.layer("sil=1 and hole=0 and x < 20")
    added = s.layer("(sil=1 or frass=1 or (x>28 and y>28)) and not (sil=1 and hole=0 and x < 20)")
    touch = s.dilate(part, R.square_kernel(3))
    c = s.comp_px(added)
    ok = s.add(f"select distinct leaf_id, comp from {c} join {touch} using (leaf_id,y,x)")
    return s.digest(s.either(part, s.add(f"select c.leaf_id,c.y,c.x from {c} c join {ok} using (leaf_id, comp)")))


@query(_island_sql())
def untouched_islands(spark, sf):
    m, fr = leaves(spark, sf, full="sil=1 or frass=1 or (x>28 and y>28)", part="sil=1 and hole=0 and x < 20")
    return digest(C.drop_islands(R.pick(m, "full"), R.pick(m, "part"), fr))


# One row per scan line in closed form: a ribbon of 2 400 lines and more, cut every 400 lines.
_RIBBON = "select s_suppkey leaf_id, cast(2400+s_suppkey%500 as int) h from supplier"


@query(
    f"""select leaf_id, (y//400)*400 as y0, count(*)::bigint n_lines, sum(3+y%2)::bigint area from ({_RIBBON}) r, range(0,3000) q(y)
 where y<h and y%400<>399 group by 1,2"""
)
def components_of_tall_pictures(spark, sf):
    from .q_tables import sql

    lines = sql(spark, sf, _RIBBON, "supplier").withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).where("y % 400 <> 399")
    x0 = F.expr("cast(10 + (y div 7) % 2 as int)")
    runs = lines.select("leaf_id", "y", x0.alias("x0"), (x0 + 3 + F.expr("cast(y % 2 as int)")).alias("x1"))
    return (
        C.components(runs).groupBy("leaf_id", "comp")
        .agg(F.min("y").cast("long").alias("y0"), F.count("*").alias("n_lines"), F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))
        .drop("comp")
    )

"""Flagship and whole-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import joins as J
from ..operators import measure as M
from ..operators import runs as R
from ..session import cut_lineage
from . import fixtures as fx
from . import flow
from .oracle import Steps
from .q_masks import digest, leaves
from .q_tables import sql
from .registry import query

_SCALE = "select case when p_partkey%4=0 then concat('P', cast(p_partkey as varchar(20))) else concat('P', cast(p_partkey as varchar(20)), '.jpg') end ref_key, cast((1+p_partkey%7)/cast(8192 as double) as double) cm2_per_px2 from part where p_partkey%5<>0"


def _flow_sql():
    s = Steps()
    t = s.layer("tissue=1")
    h = s.holes(t)
    m = s.add(
        f"select p.leaf_id, p.tissue=1 or h.u is not null roi, h.u is not null or (p.tissue=1 and p.cls=1) dmg from leaf_px p left join (select *, 1 u from {h}) h using (leaf_id,y,x)"
    )
    f = s.add(f"select leaf_id, count(*) filter (roi)::bigint leaf_area_px, count(*) filter (dmg)::bigint damage_px from {m} group by 1")
    return s.select(
        f"""select null::bigint photo_number, concat('P', f.leaf_id, '_white_bg.png') image_name, leaf_area_px, damage_px, round_even(damage_px/leaf_area_px*100.0,3) damage_pct,
 round_even(leaf_area_px*c,4) leaf_area_cm2, round_even(damage_px*c,4) damage_cm2, c is not null has_cm2
 from {f} f left join (select p_partkey leaf_id, (1+p_partkey%7)/8192.0::double c from part where p_partkey%5<>0) using (leaf_id)"""
    )


@query(_flow_sql())
def leaf_damage_results(spark, sf):
    layers = cut_lineage(R.to_runs(fx.leaf_px(spark, sf), {"tissue": F.expr("tissue=1"), "damage": F.expr("cls=1")}))
    frag = flow.quick_fragments(layers, fx.leaf_frames(spark, sf))
    named = frag.withColumn("image_name", F.concat(F.lit("P"), F.col("leaf_id"), F.lit("_white_bg.png")))
    return flow.results(named, sql(spark, sf, _SCALE))


def _sil_sql():
    s = Steps()
    t = s.layer("tissue=1")
    f = s.fill(t)
    return s.select(
        f"""select leaf_id, a::bigint silhouette_px, b::bigint remaining_px, (a-b)::bigint damage_px, round_even((a-b)/a*100.0,4) damage_percent
 from (select leaf_id, count(*) a from {f} group by 1) join (select leaf_id, count(*) b from {t} group by 1) using (leaf_id)"""
    )


@query(_sil_sql())
def silhouette_loss(spark, sf):
    m, fr = leaves(spark, sf, t="tissue=1")
    t = R.pick(m, "t")
    return M.silhouette_damage(R.area(C.fill_holes(t, fr)), R.area(t))


@query(
    Steps().select(
        """select leaf_id, a::bigint leaf_area_px, d::bigint damage_px, round_even(d/a*100.0,3) damage_pct from (
 select leaf_id, count(*) filter (sil=1) a, count(*) filter (dmg=1 or bite=1) d from leaf_px group by 1)"""
    )
)
def metrics_after_edit(spark, sf):
    m, _ = leaves(spark, sf, sil="sil=1", d="dmg=1 or bite=1")
    return M.recompute(R.area(R.pick(m, "sil"), "leaf_area_px"), R.area(R.pick(m, "d")))


def _prior_sql():
    s = Steps()
    m = s.layer("tissue=1 and y % 11 <> 5")
    # odd leaves carry a box 10..21 with margin 2, every third leaf a point
    boxed = s.add(f"select * from {m} where leaf_id%2=0 or (x between 7 and 24 and y between 7 and 24)")
    c = s.comp_px(boxed)
    best = s.add(
        f"""select leaf_id, comp from (select leaf_id, comp, count(*) n, min((x-16)*(x-16)+(y-12)*(y-12)) d from {c} group by 1,2)
 qualify row_number() over (partition by leaf_id order by case when leaf_id%3=0 and d=0 then 0 else 1 end, n desc, comp)=1"""
    )
    return s.digest(s.add(f"select c.leaf_id,c.y,c.x from {c} c join {best} using (leaf_id,comp)"))


@query(_prior_sql())
def box_and_point_hints(spark, sf):
    m = R.to_runs(fx.leaf_px(spark, sf).where("tissue = 1 and y % 11 <> 5"))
    fr = fx.leaf_frames(spark, sf)
    boxes = fr.where("leaf_id % 2 = 1").selectExpr("leaf_id", "10 bx0", "10 by0", "22 bx1", "22 by1")
    points = fr.where("leaf_id % 3 = 0").selectExpr("leaf_id", "16 px", "12 py")
    return digest(J.apply_priors(cut_lineage(m), boxes, points, fr, 0.25))

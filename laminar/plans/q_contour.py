"""Queries over hulls, contours, curvature and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import contour as G
from ..operators import runs as R
from ..session import cut_lineage, table
from .oracle import Steps
from .q_masks import digest, tissue
from .registry import query


def _hull_steps(s, m):
    ends = s.add(f"select leaf_id, y, unnest([min(x), max(x)]) x from {m} group by leaf_id, y")
    rows = s.add(f"select distinct leaf_id, y from {m}")
    rows = s.add(f"select leaf_id, unnest(range(min(y), max(y)+1)) y from {m} group by leaf_id")
    ext = s.add(
        f"""select r.leaf_id, r.y, min(case when a.y=b.y then a.x else a.x+(b.x-a.x)*(r.y-a.y)/(b.y-a.y)::double end) l, max(case when a.y=b.y then a.x else a.x+(b.x-a.x)*(r.y-a.y)/(b.y-a.y)::double end) h
 from {rows} r join {ends} a on a.leaf_id=r.leaf_id and a.y<=r.y join {ends} b on b.leaf_id=r.leaf_id and b.y>=r.y group by 1,2"""
    )
    return s.add(f"select leaf_id, cast(y as int) y, cast(unnest(range(cast(ceil(l-1e-9) as int), cast(floor(h+1e-9) as int)+1)) as int) x from {ext}")


def _hull_sql():
    s = Steps()
    return s.digest(_hull_steps(s, s.largest(s.layer("tissue=1"))))


@query(_hull_sql())
def convex_hull_fill(spark, sf):
    t, _ = tissue(spark, sf)
    return digest(G.convex_hull(t))


def _roi_sql():
    s = Steps()
    base = s.fill(s.layer("tissue=1"))
    big = s.add(f"select leaf_id from {base} group by 1 having count(*)>=50")
    mb = s.add(f"select m.* from {base} m join {big} using (leaf_id)")
    closed = s.both(s.close(mb, R.ellipse_kernel(17)), s.add(f"select fr.* from fr join {big} using (leaf_id)"))
    hull = _hull_steps(s, s.largest(mb))
    return s.digest(s.fill(s.either(base, closed, hull)))


@query(_roi_sql())
def region_by_hull(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(G.expand_roi(t, "hull", fr))


@query()
def contour_pixels(spark, sf):
    t, _ = tissue(spark, sf)
    return G.contour_lengths(G.contour(t))


@query()
def leaf_morphology(spark, sf):
    t, _ = tissue(spark, sf)
    return G.classify_morphology(t)


def _curved(spark, sf):
    t, fr = tissue(spark, sf)
    cnt = cut_lineage(G.contour(t))
    return t, fr, cnt, G.curvature(G.resample(cnt))


def _gap_points(cnt):
    """Thresholds of all leaves, and the points that can lie on a gap; the rest of a contour is never stored."""
    thr = cut_lineage(G.k_threshold(G.curvature(G.resample(cnt))))
    return thr, cut_lineage(G.curvature(G.resample(cnt), near=G.MERGE_GAP))


@query()
def contour_curvature(spark, sf):
    # one pass over the points, which are far more than their border pixels and so are never stored
    _, _, _, pts = _curved(spark, sf)
    means = [F.bround(F.avg(k), 6).alias(k) for k in ("k2", "k8", "k20")]
    return G.k_threshold(pts, also=[F.count("*").alias("n"), *means]).withColumn("k_thresh", F.bround("k_thresh", 6))


@query()
def hull_defects(spark, sf):
    t, _ = tissue(spark, sf)
    big = cut_lineage(C.largest(t))
    return G.convexity_defects(G.contour(big), G.hull_vertices(big))


@query()
def edge_gaps(spark, sf):
    t, fr, cnt, _ = _curved(spark, sf)
    thr, pts = _gap_points(cnt)
    gaps = cut_lineage(G.gap_candidates(pts, thr))
    defects = G.convexity_defects(cnt, G.hull_vertices(C.largest(t)))
    depths = G.match_defects(gaps, pts, defects, 20.0)
    return G.score_gaps(
        gaps, pts, thr, depths, min_depth=2.0, excluded=G.exclusion_zones(t, fr), morphology=G.classify_morphology(t)
    )


def _pet_sql():
    s = Steps()
    return s.select(
        """select leaf_id, min(y)::int petiole_row from (select leaf_id, y, n, max(n) over (partition by leaf_id) mx from (select leaf_id, y, count(*) filter (tissue=1) n from leaf_px group by 1,2))
 where y>=16 and n<0.3*mx group by 1"""
    )


@query(_pet_sql())
def petiole_rows(spark, sf):
    t, fr = tissue(spark, sf)
    return G.petiole_zone(t, fr)


@query()
def tip_and_petiole_zones(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(G.exclusion_zones(t, fr))


@query()
def open_margin_bites(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(G.bite_gaps(t, fr, 1.5, 4))


_TRI = "select p_partkey leaf_id, 0 tri_id, cast(p_partkey%30 as int) sx, cast(p_partkey%7 as int) sy, cast(p_partkey%11 as int) ex, cast(10+p_partkey%13 as int) ey, cast(12+p_partkey%19 as int) fx, cast(5+p_partkey%23 as int) fy from part"


@query(
    f"""with t as ({_TRI}), p as (select *, (ex-sx)*(y-sy)-(ey-sy)*(x-sx) a, (fx-ex)*(y-ey)-(fy-ey)*(x-ex) b, (sx-fx)*(y-fy)-(sy-fy)*(x-fx) c from t, range(0,40) q(y), range(0,40) w(x)
 where y between least(sy,ey,fy) and greatest(sy,ey,fy) and x between least(sx,ex,fx) and greatest(sx,ex,fx))
 select leaf_id, tri_id, count(*)::bigint px, sum(x)::bigint sum_x, sum(y)::bigint sum_y, sum(x*y)::bigint sum_xy from p where (a>=0 and b>=0 and c>=0) or (a<=0 and b<=0 and c<=0) group by 1,2"""
)
def triangle_fill(spark, sf):
    from .q_tables import sql

    return digest(G.triangle_runs(sql(spark, sf, _TRI)))


@query(
    """with recursive c as (select l_orderkey leaf_id, cast(l_linenumber as bigint) cand_id, max(l_discount) depth, cast(max(l_quantity) as bigint) area from lineitem group by 1,2),
 o as (select *, row_number() over (partition by leaf_id order by depth desc, area desc, cand_id) k, 30+leaf_id%50 budget from c),
 f as (select leaf_id, k, cand_id, area<=budget taken, case when area<=budget then area else 0 end used from o where k=1
  union all select o.leaf_id, o.k, o.cand_id, f.used+o.area<=o.budget, f.used + case when f.used+o.area<=o.budget then o.area else 0 end
  from f join o on o.leaf_id=f.leaf_id and o.k=f.k+1)
 select leaf_id, cand_id from f where taken"""
)
def budgeted_fill(spark, sf):
    li = table(spark, sf, "lineitem")
    cands = li.groupBy(F.col("l_orderkey").alias("leaf_id"), F.col("l_linenumber").cast("long").alias("cand_id")).agg(
        F.max("l_discount").alias("depth"), F.max("l_quantity").cast("long").alias("area")
    )
    budget = table(spark, sf, "orders").select(F.col("o_orderkey").alias("leaf_id"), (30 + F.col("o_orderkey") % 50).alias("budget"))
    return G.budget_fill(cands, budget)


def _refine_sql(holes):
    s = Steps()
    fill = (lambda m: m) if holes else s.fill
    base = fill(s.largest(s.layer("tissue=1")))
    big = s.add(f"select leaf_id from {base} group by 1 having count(*)>=50")
    mb = s.add(f"select m.* from {base} m join {big} using (leaf_id)")
    closed = s.both(s.close(mb, R.ellipse_kernel(17)), s.add(f"select fr.* from fr join {big} using (leaf_id)"))
    small = s.add(f"select m.* from {base} m anti join {big} using (leaf_id)")
    out = fill(s.either(closed, small))
    out = fill(s.erode(s.open(out, R.ellipse_kernel(5)), R.ellipse_kernel(3)))
    return s.digest(s.largest(out))


@query(_refine_sql(False))
def leaf_refine_complete(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(G.refine_leaf_mask(t, fr, "complete"))


@query(_refine_sql(True))
def leaf_refine_perforated(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(G.refine_leaf_mask(t, fr, "perforated"))

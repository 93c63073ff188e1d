"""Queries over colour, statistics, depth, detectors and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as K
from ..operators import components as C
from ..operators import detectors as D
from ..operators import metrics as X
from ..operators import raster as P
from ..operators import runs as R
from ..session import cut_lineage, spread, table
from . import fixtures as fx
from .fixtures import SIDE
from .oracle import Steps
from .q_masks import digest, leaves, tissue
from .registry import query

# colour conversions again, as SQL over r, g, b
_HSV = """select *, case when v=0 then 0 else (d*cast(round(1044480.0/v) as bigint)+2048)>>12 end sat, v val,
 case when d=0 then 0 else (case when hh<0 then hh+180 else hh end) end hue, (r*9798+g*19235+b*3735+16384)>>15 gray
 from (select *, case when d=0 then 0 else cast(floor((t*cast(round(122880.0/d) as bigint)+2048)/4096.0) as bigint) end hh from (
  select *, case when v=r then g-b when v=g then b-r+2*d else r-g+4*d end t from (
   select *, greatest(r,g,b) v, greatest(r,g,b)-least(r,g,b) d from {src})))"""
_FOL = "((hue between 25 and 95 and sat between 28 and 255 and val between 20 and 255) or (sat>=28 and val between 25 and 250))"
_WHITE = "(r>={0} and g>={0} and b>={0})"


def _colour_steps(n=SIDE):
    s = Steps(n=n)
    s.parts.append("hp as materialized (" + _HSV.format(src="leaf_px") + ")")
    return s


# a table of colours spread over the RGB cube, one per line item
_RGB = """(select l_orderkey, l_linenumber, l_partkey, cast((l_orderkey*37+l_linenumber*11)%256 as int) r, cast((l_partkey*53+l_suppkey*7)%256 as int) g,
 cast((l_orderkey*5+l_partkey*3)%256 as int) b from lineitem)"""


def _rgb(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "cast((l_orderkey*37+l_linenumber*11)%256 as int) r",
        "cast((l_partkey*53+l_suppkey*7)%256 as int) g", "cast((l_orderkey*5+l_partkey*3)%256 as int) b",
    )


@query(f"select l_orderkey, l_linenumber, l_partkey, hue::int hue, sat::int sat, val::int val, gray::int gray, {_FOL} foliage, (hue between 18 and 100 and sat>=22 and val>=15) or (sat>=28 and val between 25 and 250) stressed, (hue between 90 and 135 and sat>=20 and val>=20) blue, {_WHITE.format(200)} white, d<=55 neutral, gray<=75 dark from (" + _HSV.format(src=_RGB) + ")")
def colour_hsv_gray(spark, sf):
    px = P.with_hsv(_rgb(spark, sf)).withColumn("gray", K.gray())
    return px.select(
        "l_orderkey", "l_linenumber", "l_partkey", "hue", "sat", "val", "gray", K.is_foliage().alias("foliage"),
        K.is_foliage(stressed=True).alias("stressed"), K.is_blue().alias("blue"), K.is_white(200).alias("white"),
        K.is_neutral().alias("neutral"), K.is_dark().alias("dark"),
    )


_LIN = "case when {0}/255.0::double<=0.04045 then {0}/255.0::double/12.92 else pow(({0}/255.0::double+0.055)/1.055,2.4::double) end"
_FT = "case when {0}>0.008856 then pow({0},1.0::double/3.0) else 7.787*{0}+16.0/116.0::double end"
_LABSQL = f"""select *, least(greatest(round_even(lt*255.0/100.0,0),0),255)::int lab_l, least(greatest(round_even(500.0*(fx-fy)+128.0,0),0),255)::int lab_a, least(greatest(round_even(200.0*(fy-fz)+128.0,0),0),255)::int lab_b from (
 select *, {_FT.format('xx')} fx, {_FT.format('yy')} fy, {_FT.format('zz')} fz, case when yy>0.008856 then 116.0*pow(yy,1.0::double/3.0)-16.0 else 903.3*yy end lt from (
 select *, (0.412453::double*lr+0.357580::double*lg+0.180423::double*lb)/0.950456::double xx, 0.212671::double*lr+0.715160::double*lg+0.072169::double*lb yy, (0.019334::double*lr+0.119193::double*lg+0.950227::double*lb)/1.088754::double zz from (
 select *, {_LIN.format('r')} lr, {_LIN.format('g')} lg, {_LIN.format('b')} lb from {{src}})))"""
_CB = "least(greatest(((b-((r*4899+g*9617+b*1868+8192)>>14))*9241+128*16384+8192)>>14,0),255)"


@query(f"select l_orderkey, l_linenumber, l_partkey, lab_l, lab_a, lab_b, {_CB}::int cb from (" + _LABSQL.format(src=_RGB) + ")")
def colour_lab_cb(spark, sf):
    px = P.with_lab(_rgb(spark, sf))
    return px.select("l_orderkey", "l_linenumber", "l_partkey", "lab_l", "lab_a", "lab_b", K.cb().alias("cb"))


_U = "least(greatest({0},0.0::double),1.0::double)"


@query(
    f"""select l_orderkey, l_linenumber, l_partkey, floor(({_U.format('(128.0-lab_b)/60.0::double')}+{_U.format(f'({_CB}-128.0)/60.0::double')}
 +{_U.format('1.0-least(abs(hue-115.0),180.0-abs(hue-115.0))/35.0::double')}*(sat/255.0::double)+{_U.format('(b-greatest(r,g))/(r+g+b+1e-6::double)*4.0')})/4.0*255.0)::int score from ("""
    + _LABSQL.format(src="(" + _HSV.format(src=_RGB) + ")") + ")"
)
def colour_blueness(spark, sf):
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", K.blueness().alias("score"))


# --- statistics -------------------------------------------------------------------

_G8 = """g8 as (select vec_id leaf_id, cast(pos//8 as int) y, cast(pos%8 as int) x, cast(least(255, greatest(0, floor(128+cast(v as double)*300))) as int) gray
 from (select vec_id, unnest(embedding) v, generate_subscripts(embedding,1)-1 pos from embeddings))"""


def gray8(spark, sf):
    e = spread(table(spark, sf, "embeddings"), "vec_id")
    return e.select(F.col("vec_id").alias("leaf_id"), F.posexplode("embedding").alias("pos", "v")).selectExpr(
        "leaf_id", "cast(pos div 8 as int) y", "cast(pos % 8 as int) x",
        "cast(least(255, greatest(0, floor(128+cast(v as double)*300))) as int) gray",
    )


def gray8_frames(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("leaf_id"), F.lit(8).alias("h"), F.lit(8).alias("w"))


@query(
    f"""with {_G8}, refl as (select leaf_id, case when x<0 then -x when x>7 then 14-x else x end sx, case when y<0 then -y when y>7 then 14-y else y end sy, cy y, cx x
 from (select a.leaf_id, a.y cy, a.x cx, a.y+dy.v y, a.x+dx.v x from g8 a, (select unnest(range(-2,3)) v) dy, (select unnest(range(-2,3)) v) dx))
 select r.leaf_id, r.y, r.x, sum(g.gray)/25.0::double box_mean from refl r join g8 g on g.leaf_id=r.leaf_id and g.y=r.sy and g.x=r.sx group by all"""
)
def box_means(spark, sf):
    return P.box_mean(gray8(spark, sf), gray8_frames(spark, sf), "gray", 5)


@query(
    f"""with {_G8}, t as (select unnest(range(0,256)) t), s as (select leaf_id, t, count(*) filter (gray<=t) n1, coalesce(sum(gray) filter (gray<=t),0) s1, count(*) n, sum(gray) s from g8, t group by leaf_id, t),
 v as (select *, case when n1>0 and n1<n then ((s*n1-n*s1)::double*(s*n1-n*s1)::double)/(n1*(n-n1)) else -1 end sc from s)
 select leaf_id, t::int otsu from v qualify row_number() over (partition by leaf_id order by sc desc, t)=1"""
)
def otsu_threshold(spark, sf):
    return P.otsu(P.histogram(gray8(spark, sf), "gray"))


@query(f"with {_G8} select leaf_id, quantile_cont(gray,0.9) p90, quantile_cont(gray,0.5) med from g8 group by leaf_id")
def gray_percentiles(spark, sf):
    g = gray8(spark, sf)
    return P.pct(g, "gray", 0.9, "p90").join(P.pct(g, "gray", 0.5, "med"), "leaf_id")


@query(
    Steps().select(
        """select leaf_id, quantile_cont(r,0.5) paper_r, quantile_cont(g,0.5) paper_g, quantile_cont(b,0.5) paper_b from (
 select * from leaf_px where y<4 union all select * from leaf_px where y>=28 union all select * from leaf_px where x<4 union all select * from leaf_px where x>=28) group by leaf_id"""
    )
)
def paper_colours(spark, sf):
    return P.paper_colour(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf))


_GW = """select p.leaf_id, y, x, floor(least(greatest(r*(gm/(mr+1e-6::double)),0.0),255.0))::int r, floor(least(greatest(g*(gm/(mg+1e-6::double)),0.0),255.0))::int g, floor(least(greatest(b*(gm/(mb+1e-6::double)),0.0),255.0))::int b
 from leaf_px p join (select leaf_id, avg(r) mr, avg(g) mg, avg(b) mb, (avg(b)+avg(g)+avg(r))/3.0::double gm from leaf_px group by leaf_id) m using (leaf_id)"""


@query(Steps().select(f"select leaf_id, sum(r)::bigint r, sum(g)::bigint g, sum(b)::bigint b, sum(r*x+g*y)::bigint mix from ({_GW}) group by leaf_id"))
def white_balance(spark, sf):
    out = P.gray_world(fx.leaf_px(spark, sf))
    return out.groupBy("leaf_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in "rgb"], F.sum(F.col("r") * F.col("x") + F.col("g") * F.col("y")).cast("long").alias("mix")
    )


def _norm_sql():
    s = _colour_steps()
    pc = s.add(
        """select leaf_id, quantile_cont(r,0.5) pr, quantile_cont(g,0.5) pg, quantile_cont(b,0.5) pb from (
 select * from leaf_px where y<4 union all select * from leaf_px where y>=28 union all select * from leaf_px where x<4 union all select * from leaf_px where x>=28) group by leaf_id"""
    )
    bg = s.add(
        f"""select h.leaf_id, y, x, r, g, b, case when (sqrt((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb))<42 or (sat<55 and val>200)) and not (hue between 25 and 95 and sat>=28 and val>=20) then 1 else 0 end bg from hp h join {pc} using (leaf_id)"""
    )
    refl = lambda v: f"(case when {v}<0 then 1 when {v}>31 then 30 else {v} end)"
    rows = s.add(f"select a.leaf_id, a.y, a.x, sum(n.bg) s from {bg} a, (select unnest(range(-1,2)) d) o, {bg} n where n.leaf_id=a.leaf_id and n.y=a.y and n.x={refl('a.x+o.d')} group by 1,2,3")
    boxed = s.add(f"select a.leaf_id, a.y, a.x, sum(n.s) s from {rows} a, (select unnest(range(-1,2)) d) o, {rows} n where n.leaf_id=a.leaf_id and n.x=a.x and n.y={refl('a.y+o.d')} group by 1,2,3")
    soft = s.add(f"select p.leaf_id, p.y, p.x, r, g, b, round_even(s*255/9.0::double,0)/255.0::double al from {bg} p join {boxed} q using (leaf_id,y,x)")
    return s.select(
        f"""select leaf_id, sum(floor(r*(1.0-al)+255.0*al))::bigint r, sum(floor(g*(1.0-al)+255.0*al))::bigint g, sum(floor(b*(1.0-al)+255.0*al)*x)::bigint bx,
 (select round(avg(bg),4) from {bg} q where q.leaf_id=s.leaf_id) bg_fraction from {soft} s group by leaf_id"""
    )


@query(_norm_sql())
def background_whitening(spark, sf):
    out, share = P.normalise_bg(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf))
    return out.groupBy("leaf_id").agg(
        F.sum("r").cast("long").alias("r"), F.sum("g").cast("long").alias("g"), F.sum(F.col("b") * F.col("x")).cast("long").alias("bx")
    ).join(share, "leaf_id")


def _depth_sql(cap):
    s = Steps()
    m, out = s.layer("tissue=1"), None
    out = s.invert(m)
    offs = [(dy, dx) for dy in range(-cap + 1, cap) for dx in range(-cap + 1, cap) if 0 < dy * dy + dx * dx < cap * cap]
    o = s.add("select * from (values " + ",".join(f"({a},{b},{a*a+b*b})" for a, b in offs) + ") t(dy,dx,q)")
    near = s.add(f"select b.leaf_id, b.y+dy y, b.x+dx x, min(q) q from {out} b, {o} group by all")
    return s.select(
        f"select leaf_id, sum(d)::bigint sum_d2, max(d)::int max_d2, sum(d*x)::bigint mix from (select m.leaf_id, m.x, least({cap*cap}, coalesce(n.q,{cap*cap})) d from {m} m left join {near} n using (leaf_id,y,x)) group by leaf_id"
    )


@query(_depth_sql(6))
def depth_map(spark, sf):
    t, fr = tissue(spark, sf)
    d = P.depth(t, fr, 6)
    return d.groupBy("leaf_id").agg(
        F.sum("d2").cast("long").alias("sum_d2"), F.max("d2").alias("max_d2"), F.sum(F.col("d2") * F.col("x")).cast("long").alias("mix")
    )


def _rim_sql():
    s = Steps()
    return s.digest(s.closer(s.layer("tissue=1"), 9))


@query(_rim_sql())
def perimeter_band(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(P.rim_band(t, fr, 3.0))


def _maxd_sql():
    s = Steps()
    c = s.comp_px(s.layer("tissue=1"))
    out = s.invert(s.layer("tissue=1"))
    return s.select(
        f"""select leaf_id, comp, max(d)::bigint max_d2 from (select c.leaf_id, c.comp, c.y, c.x, min((o.y-c.y)*(o.y-c.y)+(o.x-c.x)*(o.x-c.x)) d
 from {c} c join {out} o on o.leaf_id=c.leaf_id and abs(o.y-c.y)<=13 and abs(o.x-c.x)<=13 group by all) group by 1,2"""
    )


@query(_maxd_sql())
def component_depth(spark, sf):
    t, fr = tissue(spark, sf)
    return P.max_depth2(cut_lineage(C.components(t, 8)), fr)


@query(
    Steps().select(
        """select leaf_id, cx0, cy0, cx1, cy1, scale, cast(floor((512-nw)/2) as int) pad_left, cast(floor((512-nh)/2) as int) pad_top from (
 select *, greatest(1,round_even((cx1-cx0)*scale,0))::int nw, greatest(1,round_even((cy1-cy0)*scale,0))::int nh from (
 select *, 508.0::double/greatest(cx1-cx0,cy1-cy0) scale from (
 select leaf_id, greatest(0,bx0-p) cx0, greatest(0,by0-p) cy0, least(32,bx1+p) cx1, least(32,by1+p) cy1 from (
 select *, greatest(4,cast(floor(greatest(bx1-bx0,by1-by0)*0.05) as int)) p from (
 select leaf_id, min(x) bx0, min(y) by0, max(x)+1 bx1, max(y)+1 by1 from leaf_px where tissue=1 group by leaf_id)))))"""
    )
)
def crop_and_letterbox(spark, sf):
    t, fr = tissue(spark, sf)
    boxes = C.component_stats(t).join(fr, "leaf_id").select("leaf_id", "bx0", "by0", "bx1", "by1", "h", "w")
    return P.crop_letterbox(boxes)


@query(
    Steps().select(
        """select leaf_id, cls, count(*)::bigint px, sum(x)::bigint sum_x, sum(y)::bigint sum_y, sum(x*y)::bigint sum_xy from (
 select p.leaf_id, cls, ty.y, tx.x from leaf_px p join (select unnest(range(0,45)) y) ty on p.y=cast(floor(ty.y*32/45.0) as int) join (select unnest(range(0,20)) x) tx on p.x=cast(floor(tx.x*32/20.0) as int)) where cls<>0 group by leaf_id, cls"""
    )
)
def nearest_resize(spark, sf):
    px = fx.leaf_px(spark, sf)
    runs = R.to_runs(px.where("cls <> 0"), keys=("leaf_id", "cls"))
    return digest(P.resize_nearest(runs, fx.leaf_frames(spark, sf), 45, 20))


@query(
    Steps().select(
        """select leaf_id, geom, count(*)::bigint px, sum(x)::bigint sum_x, sum(y)::bigint sum_y, sum(x*y)::bigint sum_xy from (
 select leaf_id,'r90' geom, x y, 31-y x from leaf_px where tissue=1 union all select leaf_id,'r180',31-y,31-x from leaf_px where tissue=1
 union all select leaf_id,'r270',31-x,y from leaf_px where tissue=1 union all select leaf_id,'fh',y,31-x from leaf_px where tissue=1
 union all select leaf_id,'fv',31-y,x from leaf_px where tissue=1) group by leaf_id, geom"""
    )
)
def geometric_copies(spark, sf):
    t, fr = tissue(spark, sf)
    return digest(P.geom_copies(t, fr))


# --- detectors --------------------------------------------------------------------


def _whitebg(s, white=250, foliage=True, max_ratio=None):
    w = _WHITE.format(white)
    cand = s.layer(f"not {w}" + (f" and {_FOL}" if foliage else ""), "hp")
    first = s.largest(s.open(s.close(cand, R.ellipse_kernel(5), 2), R.ellipse_kernel(5)))
    if max_ratio is None:
        return first
    strict = s.layer(f"not {w} and {_FOL}", "hp")
    second = s.largest(s.open(strict, R.ellipse_kernel(5), 2))
    take = s.add(
        f"select a.leaf_id from (select leaf_id, count(*) n from {first} group by 1) a join (select leaf_id, count(*) n from {second} group by 1) b using (leaf_id) where a.n/1024.0>{max_ratio} and b.n<a.n and b.n>=80"
    )
    return s.add(f"select f.* from {first} f anti join {take} using (leaf_id) union all select f.* from {second} f join {take} using (leaf_id)")


def _wb_sql():
    s = _colour_steps()
    return s.digest(_whitebg(s, max_ratio=0.3))


@query(_wb_sql())
def leaf_on_white(spark, sf):
    m, _ = D.leaf_mask_whitebg(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf), max_ratio=0.3)
    return digest(m)


def _wbm_sql():
    s = _colour_steps()
    m = _whitebg(s)
    f = s.fill(m)
    return s.select(
        f"""select p.leaf_id, coalesce(n,0)::bigint area_px, round_even(coalesce(n,0)/1024.0::double,4) area_ratio, (coalesce(n,0)-coalesce(k,0))::bigint holes_filled_px, false retried_strict, 0::bigint blue_removed_px,
 case when coalesce(n,0)=0 then 'no_component' end warning from (select p_partkey leaf_id from part) p left join (select leaf_id, count(*) n from {f} group by 1) using (leaf_id) left join (select leaf_id, count(*) k from {m} group by 1) using (leaf_id)"""
    )


@query(_wbm_sql())
def leaf_on_white_report(spark, sf):
    _, meta = D.leaf_mask_whitebg(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf), fill=True)
    return meta


def _partial_sql(gentle):
    s = _colour_steps()
    m = s.layer("gray<=240", "hp")
    m = s.close(m, R.ellipse_kernel(3), 2) if gentle else s.close(s.open(m, R.ellipse_kernel(5)), R.ellipse_kernel(5), 2)
    return s.digest(s.largest(m))


@query(_partial_sql(False))
def partial_leaf(spark, sf):
    return digest(D.partial_mask(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf)))


@query(_partial_sql(True))
def partial_leaf_gentle(spark, sf):
    return digest(D.partial_mask(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf), gentle=True))


@query()
def intact_leaf(spark, sf):
    return digest(D.leaf_mask_intact(fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf)))


# a blue dot on every leaf: the frass block widened and painted blue
_BLUE = "(x-22)*(x-22)+(y-9)*(y-9)<=4+k%9"


def _blue_px(spark, sf):
    px = fx.leaf_px(spark, sf)
    dot = F.expr(_BLUE)
    return px.withColumns({"r": F.when(dot, 40).otherwise(F.col("r")), "g": F.when(dot, 60).otherwise(F.col("g")), "b": F.when(dot, 190).otherwise(F.col("b"))})


def _blue_sql():
    s = Steps()
    m = s.layer(f"tissue=1 or {_BLUE}")
    blue = s.layer(_BLUE)
    c = s.comp_px(m)
    ok = s.add(
        f"select leaf_id, comp from (select leaf_id, comp, y, x from {c}) left join (select leaf_id,y,x,1 u from {blue}) using (leaf_id,y,x) group by 1,2 having coalesce(sum(u),0)/count(*)<=0.2"
    )
    return s.digest(s.minus(s.add(f"select c.leaf_id,c.y,c.x from {c} c join {ok} using (leaf_id,comp)"), blue))


@query(_blue_sql())
def blue_mark_removal(spark, sf):
    px = _blue_px(spark, sf)
    m = R.to_runs(fx.leaf_px(spark, sf).where(f"tissue = 1 or {_BLUE}"))
    return digest(D.remove_blue(m, R.pick(D.colour_layers(px, blue=K.is_blue()), "blue")))


def _reest_sql():
    s = _colour_steps()
    # pictures whose given mask (the whole frame on even leaves) is too large
    m = s.layer("sil=1 or leaf_id%2=0")
    new = _whitebg(s)
    take = s.add(
        f"select a.leaf_id from (select leaf_id, count(*) n from {m} group by 1) a join (select leaf_id, count(*) n from {new} group by 1) b using (leaf_id) where a.n/1024.0>0.62 and b.n>=100 and b.n<a.n"
    )
    return s.digest(s.add(f"select f.* from {m} f anti join {take} using (leaf_id) union all select f.* from {new} f join {take} using (leaf_id)"))


@query(_reest_sql())
def mask_reestimation(spark, sf):
    px = fx.leaf_px(spark, sf)
    m = R.to_runs(px.where("sil = 1 or leaf_id % 2 = 0"))
    return digest(D.reestimate_mask(m, px, fx.leaf_frames(spark, sf))[0])


def _halo_sql():
    s = _colour_steps()
    t = s.dilate(s.layer("tissue=1"), R.square_kernel(3))
    touch = s.dilate(s.invert(s.fill(t)), R.square_kernel(3))
    fol = s.layer(_FOL, "hp")
    return s.digest(s.minus(t, s.minus(s.both(t, touch), fol)))


@query(_halo_sql())
def halo_trim(spark, sf):
    t, fr = tissue(spark, sf)
    fol = R.pick(D.colour_layers(fx.leaf_px(spark, sf), fol=K.is_foliage()), "fol")
    return digest(D.trim_halo(R.dilate_square(t, 3, fr), fol, fr))


def _paper_sql():
    s = _colour_steps()
    m = s.dilate(s.layer("tissue=1"), R.square_kernel(5))
    paper = s.layer("(sqrt((r-255)*(r-255)+(g-255)*(g-255)+(b-255)*(b-255))<38 or (sat<50 and val>195) or (r>=240 and g>=240 and b>=240))", "hp")
    return s.digest(s.minus(m, s.both(s.closer(m, 9), paper)))


@query(_paper_sql())
def paper_halo_clip(spark, sf):
    t, fr = tissue(spark, sf)
    px = fx.leaf_px(spark, sf)
    flagged = P.with_hsv(px).join(P.paper_colour(px, fr), "leaf_id")
    paper = R.to_runs(flagged.where(K.is_paper()))
    return digest(D.clip_halo(R.dilate_square(t, 5, fr), paper, fr, 3))


def _clipc_sql():
    s = _colour_steps()
    m = s.dilate(s.layer("sil=1"), R.square_kernel(7))
    sil = s.close(s.fill(_whitebg(s, 248, False)), R.ellipse_kernel(13))
    return s.digest(s.both(m, sil))


@query(_clipc_sql())
def colour_silhouette_clip(spark, sf):
    px, fr = fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf)
    m = R.dilate_square(R.to_runs(px.where("sil = 1")), 7, fr)
    return digest(D.clip_colour(m, px, fr))


def _whiten_sql():
    s = _colour_steps()
    t = s.layer("tissue=1")
    f = s.fill(t)
    internal = s.minus(f, t)
    dark = s.layer(f"gray<200 and not {_FOL}", "hp")
    murky = s.layer("val<95 and sat<55", "hp")
    return s.digest(s.sized(s.either(internal, s.both(f, s.either(dark, murky))), 6))


@query(_whiten_sql())
def hole_repaint(spark, sf):
    t, fr = tissue(spark, sf)
    lay = D.colour_layers(fx.leaf_px(spark, sf), dark=(F.col("gray") < 200) & ~K.is_foliage(), murky=(F.col("val") < 95) & (F.col("sat") < 55))
    lay = cut_lineage(lay)
    return digest(D.whiten_holes(t, R.pick(lay, "dark"), R.pick(lay, "murky"), fr))


def _holes_at(s, filled, roi, bright):
    fol = s.layer(_FOL, "hp")
    inner = s.minus(filled, s.dilate(s.invert(filled), R.disk_kernel(4, strict=False)))
    cand = s.both(s.minus(s.both(bright, roi), fol), inner)
    closed = s.close(cand, R.ellipse_kernel(3))
    core = s.erode(closed, R.ellipse_kernel(3))
    near = s.dilate(fol, R.ellipse_kernel(3), 2)
    c = s.comp_px(closed)
    rim = s.minus(closed, core)
    ok = s.add(
        f"""select c.leaf_id, c.comp from {c} c left join (select *, 1 e from {rim}) r using (leaf_id,y,x) left join (select *, 1 f from {near}) n using (leaf_id,y,x)
 group by 1,2 having count(*)>=3 and (coalesce(sum(e),0)=0 or coalesce(sum(e*f),0)/coalesce(sum(e),1)>=0.45)"""
    )
    return s.add(f"select c.leaf_id,c.y,c.x from {c} c join {ok} using (leaf_id,comp)")


def _wh_sql():
    s = _colour_steps()
    f = s.fill(s.layer("tissue=1"))
    return s.digest(_holes_at(s, f, f, s.layer(_WHITE.format(235), "hp")))


@query(_wh_sql())
def white_hole_detection(spark, sf):
    t, fr = tissue(spark, sf)
    filled = cut_lineage(C.fill_holes(t, fr))
    lay = cut_lineage(D.colour_layers(fx.leaf_px(spark, sf), fol=K.is_foliage(), white=K.is_white(235)))
    bright = R.mask_and(R.pick(lay, "white"), filled)
    inner = P.deeper_than(filled, fr, 2.0)
    return digest(D.white_holes(bright, R.pick(lay, "fol"), inner, fr))


@query()
def automatic_brightness(spark, sf):
    t, fr = tissue(spark, sf)
    filled = cut_lineage(C.fill_holes(t, fr))
    used, holes = D.auto_brightness(fx.leaf_px(spark, sf), filled, filled, fr)
    return used.join(R.area(holes, "hole_px"), "leaf_id", "left").fillna(0, ["hole_px"])


def _sup_sql():
    s = _colour_steps()
    f = s.fill(s.layer("tissue=1"))
    base = s.add(f"select hp.*, val/greatest(sat,1)::double vs from hp join {f} using (leaf_id,y,x) where not {_WHITE.format(250)}")
    p85 = s.add(f"select leaf_id, quantile_cont(sat,0.85) p85 from {base} group by 1")
    t = s.add(
        f"""select leaf_id, count(*) filter (h1) n1, median(vs) filter (h1) m1, count(*) filter (h2) n2, median(vs) filter (h2) m2, count(*) filter (h3) n3, median(vs) filter (h3) m3 from (
 select leaf_id, vs, hue between 18 and 100 and sat>=100 and val<=130 h1, hue between 18 and 100 and sat>=70 and val<=150 h2, sat>=p85 and val<=150 h3 from {base} join {p85} using (leaf_id)) group by 1"""
    )
    ref = s.add(f"select leaf_id, case when n1>=500 then n1 when n2>=100 then n2 else n3 end n, case when n1>=500 then m1 when n2>=100 then m2 else m3 end m from {t}")
    cand = s.add(f"select leaf_id,y,x from {base} join {ref} using (leaf_id) where n>=50 and vs>=greatest(1.1,2.0*m) and sat between 12 and 110 and val between 55 and 245")
    inner = s.minus(f, s.dilate(s.invert(f), R.disk_kernel(4, strict=False)))
    return s.digest(s.sized(s.open(s.both(cand, inner), R.ellipse_kernel(3)), 5))


@query(_sup_sql())
def scraped_tissue(spark, sf):
    t, fr = tissue(spark, sf)
    filled = cut_lineage(C.fill_holes(t, fr))
    return digest(D.superficial(fx.leaf_px(spark, sf), filled, filled, fr, min_area=5)[0])


def _contrast_sql(s, n):
    r = n // 2
    refl = lambda v: f"(case when {v}<0 then -({v}) when {v}>31 then 62-({v}) else {v} end)"
    rows = s.add(f"select a.leaf_id, a.y, a.x, sum(n.gray) s from hp a, (select unnest(range(-{r},{r + 1})) d) o, hp n where n.leaf_id=a.leaf_id and n.y=a.y and n.x={refl('a.x+o.d')} group by a.leaf_id, a.y, a.x")
    both = s.add(f"select a.leaf_id, a.y, a.x, sum(n.s) s from {rows} a, (select unnest(range(-{r},{r + 1})) d) o, {rows} n where n.leaf_id=a.leaf_id and n.x=a.x and n.y={refl('a.y+o.d')} group by a.leaf_id, a.y, a.x")
    return s.add(f"select hp.*, c.s - hp.gray*{n * n} dr from hp join {both} c using (leaf_id,y,x)")


def _fg_sql():
    s = _colour_steps()
    t = s.layer("tissue=1")
    f = s.fill(t)
    c = _contrast_sql(s, 13)
    cand = s.layer(f"dr>={16 * 169} and gray<=75 and v-least(r,g,b)<=55 and not {_WHITE.format(250)}", c)
    return s.digest(s.sized(s.both(s.both(cand, f), t), 2, 1200))


@query(_fg_sql())
def frass_pellets(spark, sf):
    t, fr = tissue(spark, sf)
    filled = cut_lineage(C.fill_holes(t, fr))
    return digest(D.frass_global(fx.leaf_px(spark, sf), filled, t, fr, lo=2))


def _fd_sql():
    s = _colour_steps()
    t = s.layer("tissue=1")
    d = s.layer("cls=1 or (cls=2 and (x+y)%2=0)")
    c = _contrast_sql(s, 11)
    cand = s.layer(f"dr>={14 * 121} and gray<=108 and not (hue between 25 and 90 and sat>=55) and not {_WHITE.format(250)}", c)
    m = s.both(s.both(cand, s.dilate(d, R.ellipse_kernel(5))), t)
    k = s.comp_px(m)
    ok = s.add(f"select k.leaf_id, k.comp from {k} k left join (select *, 1 u from {d}) using (leaf_id,y,x) group by 1,2 having count(*) between 1 and 900 and sum(u)>0")
    return s.digest(s.add(f"select k.leaf_id,k.y,k.x from {k} k join {ok} using (leaf_id,comp)"))


@query(_fd_sql())
def frass_on_damage(spark, sf):
    m, fr = leaves(spark, sf, t="tissue=1", d="cls=1 or (cls=2 and (x+y)%2=0)")
    t = R.pick(m, "t")
    return digest(D.frass_in_damage(fx.leaf_px(spark, sf), R.pick(m, "d"), t, t, fr, lo=1))


def _fp_sql():
    s = _colour_steps()
    f, d, u = s.layer("cls=2"), s.layer("cls=1"), s.layer("cls=3 and x<12")
    zd, zu = s.dilate(d, R.ellipse_kernel(5)), s.dilate(u, R.ellipse_kernel(5))
    m = s.add(
        f"""select f.leaf_id, f.y, f.x, case when a.u is not null then 'damage' when b.u is not null then 'undamaged' else 'damage' end side
 from {f} f left join (select *, 1 u from {zd}) a using (leaf_id,y,x) left join (select *, 1 u from {zu}) b using (leaf_id,y,x)"""
    )
    return s.digest(m, "leaf_id, side")


@query(_fp_sql())
def frass_partition(spark, sf):
    m, fr = leaves(spark, sf, f="cls=2", d="cls=1", u="cls=3 and x<12")
    return digest(D.partition_frass(R.pick(m, "f"), R.pick(m, "d"), R.pick(m, "u"), None, fr, 2))


def _shell_comp(s, dmg, t, depths):
    f = s.fill(t)
    outside = s.invert(f)
    touch = s.dilate(outside, R.square_kernel(3))
    near = [s.dilate(outside, R.disk_kernel(d * d)) for d in depths]
    work = s.both(dmg, f)
    c = s.comp_px(work)
    joins = " ".join(f"left join (select *, 1 q{i} from {n}) z{i} using (leaf_id,y,x)" for i, n in enumerate(near))
    px = s.add(f"select c.*, coalesce(tt,0) tt, {', '.join(f'coalesce(q{i},0) q{i}' for i in range(len(near)))} from {c} c {joins} left join (select *, 1 tt from {touch}) tq using (leaf_id,y,x)")
    st = s.add(
        f"select leaf_id, comp, count(*) a, max(x)-min(x)+1 bw, max(y)-min(y)+1 bh, max(tt) tt, {', '.join(f'sum(q{i}) n{i}' for i in range(len(near)))} from {px} group by 1,2"
    )
    return work, px, st


def _strip_sql(s, dmg, t):
    _, px, st = _shell_comp(s, dmg, t, X.SHELLS)
    return s.add(
        f"""select p.leaf_id, p.y, p.x from {px} p join {st} s using (leaf_id, comp) where not (s.tt=1 and ((a<12 and s.n2=a) or (least(bw,bh)<=2 and greatest(bw,bh)>=15 and s.n4=a) or (s.n1/a>=0.85 and s.n3=a))) and not (p.q0=1 and p.tt=1)"""
    )


def _sp_sql():
    s = Steps()
    return s.digest(_strip_sql(s, s.layer("(dmg=1 or (sil=1 and (x+y)%7<2) or hole=1)"), s.layer("tissue=1")))


@query(_sp_sql())
def perimeter_strip(spark, sf):
    m, fr = leaves(spark, sf, t="tissue=1", d="(dmg=1 or (sil=1 and (x+y)%7<2) or hole=1)")
    filled = cut_lineage(C.fill_holes(R.pick(m, "t"), fr))
    return digest(X.strip_perimeter(R.pick(m, "d"), cut_lineage(X.shells(filled, fr))))


def _ea_sql():
    s = Steps()
    d = s.layer("cls=1 or (sil=1 and y%6<2 and tissue=1)")
    work, px, st = _shell_comp(s, d, s.layer("tissue=1"), (1.5, 2.0, 3.5))
    kept = s.add(
        f"""select p.leaf_id, p.y, p.x from {px} p join {st} s using (leaf_id, comp) where not (a<12 or (least(bw,bh)<=2 and greatest(bw,bh)>=15 and s.tt=1) or (s.n1/a>=0.85 and s.n2=a) or (s.tt=1 and s.n2=a and s.n1/a>=0.5)) and p.q0=0"""
    )
    drop = s.minus(work, kept)
    return s.select(
        f"""select leaf_id, cls, count(*)::bigint n, sum(x*y)::bigint sum_xy from (select p.leaf_id, p.y, p.x, case when u is not null then 3 when p.cls=1 or (p.sil=1 and p.y%6<2 and p.tissue=1) then 1 else p.cls end cls
 from leaf_px p left join (select *, 1 u from {drop}) using (leaf_id,y,x)) group by 1,2"""
    )


@query(_ea_sql())
def edge_artifact_filter(spark, sf):
    px = fx.leaf_px(spark, sf)
    fr = fx.leaf_frames(spark, sf)
    cls = px.selectExpr("leaf_id", "y", "x", "case when cls=1 or (sil=1 and y%6<2 and tissue=1) then 1 else cls end cls")
    out, _ = X.filter_edge_artifacts(cls, R.to_runs(px.where("tissue = 1")), fr)
    return out.groupBy("leaf_id", "cls").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).cast("long").alias("sum_xy"))


def _marg_sql():
    s = Steps()
    t = s.layer("tissue=1")
    return s.digest(s.minus(s.both(s.holes(t), s.layer("sil=1")), s.layer("dmg=1")))


@query(_marg_sql())
def marginal_damage(spark, sf):
    m, fr = leaves(spark, sf, t="tissue=1", r="sil=1", c="dmg=1")
    return digest(X.marginal(R.pick(m, "t"), R.pick(m, "r"), R.pick(m, "c"), fr))


def _metrics(spark, sf, **kw):
    px, fr = fx.leaf_px(spark, sf), fx.leaf_frames(spark, sf)
    t = cut_lineage(R.to_runs(px.where("tissue = 1")))
    roi = cut_lineage(C.fill_holes(t, fr))
    classes = cut_lineage(R.to_runs(px.where("cls <> 0"), keys=("leaf_id", "cls")))
    return X.leaf_metrics(px, classes, t, roi, fr, superficial_min_area=5, frass_min_area=2, **kw)


@query()
def leaf_damage_metrics(spark, sf):
    return _metrics(spark, sf)[0]

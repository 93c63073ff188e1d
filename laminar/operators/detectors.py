"""Leaf, hole, scrape and frass detection from colour and shape.

Colour decides per pixel inside the scan of the pixel table; from there on
everything is runs.  ``colour_layers`` folds all colour tests of a leaf into
one table of runs in a single shuffle, and the detectors combine them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import colour as K
from ..session import cut_lineage
from . import components as C
from . import raster as P
from .runs import (
    SPAN, area, close_then_open, combine, dilate, dilate_ellipse, dilate_square, ellipse_kernel, erode, keys_of, mask_diff, mask_not,
    merge, morph_close, morph_open, overlay, pick, to_runs,
)

CROSS = ellipse_kernel(3)
DISC5 = ellipse_kernel(5)
MAX_LEAF_RATIO = 0.62


def intersect_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of two run tables, keeping the extra columns of both.

    An equi-join on leaf and scan line with an overlap test; both sides are
    short within one line.
    """
    shared = [c for c in keys_of(a) if c in keys_of(b)]
    rb = b.withColumnRenamed("x0", "_b0").withColumnRenamed("x1", "_b1")
    return (
        a.join(rb, [*shared, "y"])
        .where("x0 < _b1 and _b0 < x1")
        .withColumn("_n0", F.greatest("x0", "_b0"))
        .withColumn("x1", F.least("x1", "_b1"))
        .withColumn("x0", F.col("_n0"))
        .drop("_n0", "_b0", "_b1")
    )


def colour_layers(px: DataFrame, **layers: Column | str) -> DataFrame:
    """Named colour tests over ``r, g, b`` (and hue, sat, val, gray) as runs."""
    flagged = P.with_hsv(px).withColumn("gray", K.gray())
    tests = {k: F.expr(v) if isinstance(v, str) else v for k, v in layers.items()}
    return to_runs(flagged, tests)


# --------------------------------------------------------------------------
# whole-leaf masks
# --------------------------------------------------------------------------


def remove_blue(mask: DataFrame, blue: DataFrame, limit: float = 0.20) -> DataFrame:
    """Drop components that are mostly blue, then every blue pixel."""
    comp = C.components(mask, 8)
    keys = [k for k in keys_of(comp) if k != "comp"]
    size = F.col("x1") - F.col("x0")
    sizes = comp.groupBy(*keys, "comp").agg(F.sum(size).alias("area"))
    hit = intersect_runs(comp, blue).groupBy(*keys, "comp").agg(F.sum(size).alias("blue"))
    bad = sizes.join(hit, [*keys, "comp"]).where(F.col("blue") / F.col("area") > limit)
    kept = comp.join(bad.select(*keys, "comp"), [*keys, "comp"], "left_anti").select(*keys, *SPAN)
    return mask_diff(kept, blue)


def leaf_mask_whitebg(
    px: DataFrame, frames: DataFrame, white: int = 250, min_ratio: float = 0.0005, max_ratio: float = MAX_LEAF_RATIO,
    require_foliage: bool = True, fill: bool = False, drop_blue: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Leaf on a white background, and a row describing the outcome.

    Not-white foliage is closed twice, opened once and reduced to its
    largest component.  A mask covering too much of the picture is tried
    again more strictly; only those pictures take the second path.
    """
    not_white = ~K.is_white(white)
    cand = not_white & K.is_foliage() if require_foliage else not_white
    layers = cut_lineage(colour_layers(px, cand=cand, strict=not_white & K.is_foliage(), blue=K.is_blue()))
    first = C.largest(close_then_open(pick(layers, "cand"), DISC5, frames))
    bare = cut_lineage(first)
    out = C.fill_holes(bare, frames) if fill else bare
    out = cut_lineage(out)
    sizes = frames.join(area(out), "leaf_id", "left").select(
        "leaf_id", F.coalesce("area", F.lit(0)).alias("a1"), (F.col("h") * F.col("w")).alias("px")
    )
    big = sizes.where(F.col("a1") / F.col("px") > max_ratio)
    strict = pick(layers, "strict").join(big.select("leaf_id"), "leaf_id", "left_semi")
    second = C.largest(morph_open(strict, DISC5, frames, 2))
    second = cut_lineage(C.fill_holes(second, frames) if fill else second)
    floor_px = F.greatest(F.lit(80), F.floor(F.col("px") * min_ratio))
    take = (
        big.join(area(second, "a2"), "leaf_id")
        .where((F.col("a2") < F.col("a1")) & (F.col("a2") >= floor_px))
        .select("leaf_id", F.lit(True).alias("retried"))
    )
    final = out.join(take.select("leaf_id"), "leaf_id", "left_anti").unionByName(
        second.join(take.select("leaf_id"), "leaf_id", "left_semi").select(*out.columns)
    )
    before = final
    if drop_blue:
        final = remove_blue(final, pick(layers, "blue"))
    meta = (
        sizes.join(take, "leaf_id", "left")
        .join(area(before, "a3"), "leaf_id", "left")
        .join(area(final, "a4"), "leaf_id", "left")
        .join(area(bare, "a0"), "leaf_id", "left")
    )
    meta = meta.select(
        "leaf_id",
        F.coalesce("a4", F.lit(0)).cast("long").alias("area_px"),
        F.bround(F.coalesce("a4", F.lit(0)) / F.col("px"), 4).alias("area_ratio"),
        (F.col("a1") - F.coalesce("a0", F.lit(0))).cast("long").alias("holes_filled_px"),
        F.coalesce("retried", F.lit(False)).alias("retried_strict"),
        (F.coalesce("a3", F.lit(0)) - F.coalesce("a4", F.lit(0))).cast("long").alias("blue_removed_px"),
        F.when(F.coalesce("a3", F.lit(0)) == 0, "no_component")
        .when(F.coalesce("a3", F.lit(0)) / F.col("px") > max_ratio, "mask_too_large")
        .alias("warning"),
    )
    return final, meta


def leaf_mask_intact(
    px: DataFrame, frames: DataFrame, sat_min: int = 15, close_k: int = 7, min_ratio: float = 0.001,
) -> DataFrame:
    """Undamaged leaf: dark by Otsu on lightness, coloured, not blue.

    Components are ranked by area times mean greenness; the best is filled
    and closed twice.  Without enough coloured pixels the saturation test is
    left out, without a scoring component the largest one is taken.
    """
    base = P.with_lab(P.with_hsv(px))
    cuts = P.otsu(P.histogram(base, "lab_l"))
    lit = base.join(cuts, "leaf_id").withColumn(
        "_fg", (F.col("lab_l") <= F.col("otsu")) & ~((F.col("hue") > 90) & (F.col("hue") < 150) & (F.col("sat") > 40))
    )
    lit = lit.withColumn("_c", F.col("_fg") & (F.col("sat") > sat_min))
    counts = lit.groupBy("leaf_id").agg(F.count_if("_c").alias("_n")).join(frames, "leaf_id").select(
        "leaf_id", (F.col("_n") < F.floor(F.col("h") * F.col("w") * min_ratio)).alias("_few")
    )
    chosen = cut_lineage(
        lit.where("_fg").join(counts, "leaf_id").where("_c or _few").select("leaf_id", "y", "x", (128 - F.col("lab_a")).alias("green"))
    )
    comp = cut_lineage(C.components(to_runs(chosen), 8))
    joined = comp.join(chosen, ["leaf_id", "y"]).where("x >= x0 and x < x1")
    stats = (
        joined.groupBy("leaf_id", "comp")
        .agg(F.count("*").alias("area"), F.sum("green").alias("green"))
        .join(frames, "leaf_id")
        .withColumn("_ok", F.col("area") >= F.floor(F.col("h") * F.col("w") * min_ratio))
    )
    # area * mean greenness is the plain sum; qualifying components come first
    best = C.first_by(
        stats.select("leaf_id", "comp", "area", "green", "_ok"), ["leaf_id"],
        F.when(F.col("_ok"), 0).otherwise(1),
        F.when(F.col("_ok"), -F.col("green")).otherwise(-F.col("area")), F.col("comp"),
    )
    filled = C.fill_holes(C.keep(comp, best), frames)
    return morph_close(filled, ellipse_kernel(close_k), frames, 2)


def partial_mask(px: DataFrame, frames: DataFrame, threshold: int = 240, gentle: bool = False) -> DataFrame:
    """Visible tissue: not brighter than the threshold, smoothed, largest."""
    m = to_runs(px.where(K.gray() <= threshold))
    if gentle:
        m = morph_close(m, CROSS, frames, 2)
    else:
        m = morph_close(morph_open(m, DISC5, frames), DISC5, frames, 2)
    return C.largest(m)


def reestimate_mask(
    mask: DataFrame, px: DataFrame, frames: DataFrame, max_ratio: float = MAX_LEAF_RATIO
) -> tuple[DataFrame, DataFrame]:
    """Replace masks covering too much of the picture by a colour mask, if
    that one is smaller and at least 100 px; also lists the replaced leaves."""
    sizes = area(mask).join(frames, "leaf_id")
    big = sizes.where(F.col("area") / (F.col("h") * F.col("w")) > max_ratio).select("leaf_id", "area")
    retry = px.join(big.select("leaf_id"), "leaf_id", "left_semi")
    new, _ = leaf_mask_whitebg(retry, frames.join(big.select("leaf_id"), "leaf_id", "left_semi"), max_ratio=max_ratio)
    take = area(new, "a2").join(big, "leaf_id").where("a2 >= 100 and a2 < area").select("leaf_id")
    out = mask.join(take, "leaf_id", "left_anti").unionByName(new.join(take, "leaf_id", "left_semi").select(*mask.columns))
    return out, take


# --------------------------------------------------------------------------
# rims, halos and repainting
# --------------------------------------------------------------------------


def exterior_touch(filled: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels within 3 x 3 of the outside of a filled leaf."""
    return dilate_square(mask_not(filled, frames), 3, frames)


def trim_halo(tissue: DataFrame, foliage: DataFrame, frames: DataFrame) -> DataFrame:
    """Tissue without non-foliage pixels that touch the outside."""
    touch = exterior_touch(C.fill_holes(tissue, frames), frames)
    return combine({"_t": tissue, "_f": foliage, "_e": touch}, "_t and not (not _f and _e)")


def rim_ghost(filled: DataFrame, foliage: DataFrame, frames: DataFrame, band: float = 2.0) -> DataFrame:
    """Non-foliage pixels of the filled leaf within ``band`` of its edge."""
    deep = P.deeper_than(filled, frames, max(1.0, float(band)))
    return combine({"_i": filled, "_d": deep, "_f": foliage}, "_i and not _d and not _f")


def clip_halo(mask: DataFrame, paper: DataFrame, frames: DataFrame, max_depth: int = 12) -> DataFrame:
    """Mask without paper-like pixels near its outer edge."""
    if max_depth < 1:
        return mask
    near = P.rim_band(mask, frames, max_depth)
    return combine({"_m": mask, "_p": paper, "_n": near}, "_m and not (_p and _n)")


def clip_colour(mask: DataFrame, px: DataFrame, frames: DataFrame, radius: int = 6, white: int = 248,
                fill: bool = True) -> DataFrame:
    """Mask limited to the closed colour silhouette."""
    sil, _ = leaf_mask_whitebg(px, frames, white, 0.0003, 0.92, False, fill)
    if radius > 0:
        sil = morph_close(sil, ellipse_kernel(2 * radius + 1), frames)
    return combine({"_m": mask, "_s": sil}, "_m and _s")


def whiten_holes(tissue: DataFrame, dark: DataFrame, murky: DataFrame, frames: DataFrame,
                 solid: DataFrame | None = None, min_area: int = 6) -> DataFrame:
    """Pixels to repaint white: enclosed holes and dark non-leaf spots.

    ``dark`` is gray < 200 and not foliage, ``murky`` is value < 95 with
    saturation < 55.
    """
    filled = C.fill_holes(tissue, frames)
    solid = filled if solid is None else solid
    cand = combine(
        {"_s": solid, "_f": filled, "_t": tissue, "_d": dark, "_m": murky}, "(_f and not _t) or (_s and (_d or _m))"
    )
    return C.filter_components(cand, min_area)


# --------------------------------------------------------------------------
# white holes
# --------------------------------------------------------------------------


def white_holes(bright: DataFrame, foliage: DataFrame, inner: DataFrame, frames: DataFrame,
                min_area: int = 3, share: float = 0.45) -> DataFrame:
    """White regions framed by leaf.

    ``bright`` are region pixels above the brightness, ``inner`` those deeper
    than the edge band.  Candidates are closed with a cross; a component
    stays when enough of its border lies on the dilated foliage.  Extra keys
    (such as a threshold) are handled side by side.
    """
    cand = combine({"_b": bright, "_f": foliage, "_i": inner}, "_b and not _f and _i")
    closed = cut_lineage(morph_close(cand, CROSS, frames))
    comp = C.components(closed, 8)
    keys = [k for k in keys_of(comp) if k != "comp"]
    core = erode(closed, CROSS, frames)
    near = dilate(foliage.join(closed.select(*keys).distinct(), keys, "left_semi"), CROSS, frames, 2)
    parts = overlay({"_m": closed, "_c": core, "_n": near}).where("_m").select(*keys, *SPAN, "_c", "_n")
    size = F.col("x1") - F.col("x0")
    stats = intersect_runs(comp, parts).groupBy(*keys, "comp").agg(
        F.sum(size).alias("area"),
        F.sum(F.when(~F.col("_c"), size).otherwise(0)).alias("_rim"),
        F.sum(F.when(~F.col("_c") & F.col("_n"), size).otherwise(0)).alias("_on"),
    )
    ok = stats.where((F.col("area") >= min_area) & ((F.col("_rim") == 0) | (F.col("_on") / F.col("_rim") >= share)))
    return C.keep(comp, ok)


def _per_threshold(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Repeat a leaf's runs for each of its thresholds (at most 17)."""
    return runs.join(thresholds, "leaf_id").select("leaf_id", "t", *SPAN)


def brightness_seed(px: DataFrame, roi: DataFrame, hint: int | None = 235, floor: int = 175, ceiling: int = 250) -> DataFrame:
    """Start brightness per leaf: 90th percentile of foliage plus 20,
    averaged with Otsu of the rest when there is enough of it."""
    flagged = P.with_hsv(px).withColumn("_fol", K.is_foliage()).withColumn("_m", F.least("r", "g", "b"))
    inside = intersect_px(flagged, roi)
    hist = inside.groupBy("leaf_id", "_fol", F.col("_m").alias("v")).agg(F.count("*").alias("n"))
    hist = cut_lineage(hist)
    fol = hist.where("_fol").groupBy("leaf_id").agg(F.sum("n").alias("_nf"), F.percentile("v", F.lit(0.9), F.col("n")).alias("_p90"))
    rest = hist.where("not _fol").groupBy("leaf_id").agg(F.sum("n").alias("_nr"))
    cut = P.otsu(hist.where("not _fol").select("leaf_id", "v", "n"))
    j = roi.select("leaf_id").distinct().join(fol, "leaf_id", "left").join(rest, "leaf_id", "left").join(cut, "leaf_id", "left")

    def clip(c):
        return F.floor(F.least(F.greatest(c, F.lit(float(floor))), F.lit(float(ceiling)))).cast("int")

    start = F.when(F.col("_nf") > 100, clip(F.col("_p90") + 20.0)).otherwise(hint if hint else 220)
    return j.withColumn("_s", start).select(
        "leaf_id",
        F.when((F.col("_nr") > 200) & (F.col("otsu") > 0), clip(0.5 * F.col("_s") + 0.5 * F.col("otsu"))).otherwise(F.col("_s")).cast("int").alias("seed"),
    )


def intersect_px(px: DataFrame, roi: DataFrame) -> DataFrame:
    """Pixels inside a mask."""
    lines = roi.select(*keys_of(roi), "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    return px.join(lines, [*keys_of(roi), "y"]).where("x >= _x0 and x < _x1").drop("_x0", "_x1")


def auto_brightness(
    px: DataFrame, tissue_filled: DataFrame, roi: DataFrame, frames: DataFrame, hint: int | None = 235,
    min_area: int = 3, edge_band: float = 2.0, floor: int = 175, ceiling: int = 250,
) -> tuple[DataFrame, DataFrame]:
    """Brightness per leaf, and the white holes found at it.

    All thresholds of the sweep are evaluated side by side in one job; the
    stop rules are then a running flag over at most 17 rows per leaf.
    """
    seeds = cut_lineage(brightness_seed(px, roi, hint, floor, ceiling))
    sweep = F.array_distinct(F.array(*[F.lit(t) for t in range(ceiling, floor - 1, -5)], F.col("seed")))
    lowest = F.greatest(F.lit(floor), F.col("seed") - 45)
    levels = seeds.select("leaf_id", F.explode(sweep).alias("t"))
    # the final clamp may land between sweep steps, so its level is evaluated too
    probed = levels.unionByName(seeds.select("leaf_id", lowest.alias("t"))).distinct()
    flagged = P.with_hsv(px).where(~K.is_foliage()).withColumn("_m", F.least("r", "g", "b")).where(F.col("_m") >= floor)
    bright_px = intersect_px(flagged.select("leaf_id", "y", "x", "_m"), roi).join(probed, "leaf_id").where("_m >= t")
    bright = cut_lineage(to_runs(bright_px, keys=("leaf_id", "t")))
    live = cut_lineage(probed.join(bright.select("leaf_id").distinct(), "leaf_id", "left_semi"))
    foliage = to_runs(P.with_hsv(px).join(live.select("leaf_id").distinct(), "leaf_id", "left_semi").where(K.is_foliage()))
    inner = P.deeper_than(tissue_filled, frames, edge_band) if edge_band > 0 else roi
    holes = cut_lineage(
        white_holes(
            bright, _per_threshold(foliage, live), _per_threshold(inner, live), frames.join(live, "leaf_id"), min_area,
        )
    )
    areas = levels.join(area(holes), ["leaf_id", "t"], "left").fillna(0, ["area"]).join(area(roi, "roi_px"), "leaf_id").join(seeds, "leaf_id")
    order = W.partitionBy("leaf_id").orderBy(F.desc("t"))
    a, prev = F.col("area"), F.coalesce(F.lag("area").over(order), F.lit(0))
    swept = areas.withColumn("_prev", prev)
    frac = a / F.greatest(F.lit(1), F.col("roi_px"))
    stop = ((F.col("_prev") > 200) & (a / F.greatest(F.lit(1), F.col("_prev")) > 2.5) & (a > 800)) | (frac > 0.40)
    score = a * (1.0 - F.greatest(F.lit(0.0), frac - 0.12) * 2.5) - 0.15 * F.abs(F.col("t") - F.col("seed")) * F.greatest(a, F.lit(1)) / 5000.0
    alive = swept.withColumn("_stop", F.max(stop).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_score", score)
    best = alive.groupBy("leaf_id", "seed").agg(
        F.max_by("t", F.when(~F.col("_stop"), F.struct(F.col("_score"), -F.col("t")))).alias("_t"),
        F.max(F.when(~F.col("_stop"), F.col("_score"))).alias("_sc"),
    )
    chosen = F.when(F.col("_sc") >= -1.0, F.col("_t")).otherwise(F.col("seed"))
    result = best.select("leaf_id", "seed", F.least(F.greatest(chosen, lowest), F.lit(ceiling)).cast("int").alias("brightness"))
    result = cut_lineage(result)
    found = holes.join(result.select("leaf_id", F.col("brightness").alias("t")), ["leaf_id", "t"], "left_semi")
    return result, found.select("leaf_id", *SPAN)


# --------------------------------------------------------------------------
# scraped tissue and frass
# --------------------------------------------------------------------------


def healthy_reference(px_roi: DataFrame) -> DataFrame:
    """Value/saturation level of healthy tissue, from the strictest of three
    reference sets that is large enough (pixels carry hue, sat, val)."""
    green = F.col("hue").between(18, 100)
    s, v = F.col("sat"), F.col("val")
    p85 = P.pct(px_roi, "sat", 0.85, "_p85")
    j = px_roi.join(p85, "leaf_id")
    sets = j.select(
        "leaf_id", (v / F.greatest(s, F.lit(1))).alias("_r"),
        (green & (s >= 100) & (v <= 130)).alias("_h1"), (green & (s >= 70) & (v <= 150)).alias("_h2"),
        ((s >= F.col("_p85")) & (v <= 150)).alias("_h3"),
    )
    counts = sets.groupBy("leaf_id", "_r", "_h1", "_h2", "_h3").agg(F.count("*").alias("n"))
    aggs = []
    for i in (1, 2, 3):
        n = F.when(F.col(f"_h{i}"), F.col("n")).otherwise(0)
        aggs += [F.sum(n).alias(f"_n{i}"), F.percentile(F.when(F.col(f"_h{i}"), F.col("_r")), F.lit(0.5), F.col("n")).alias(f"_m{i}")]
    t = counts.groupBy("leaf_id").agg(*aggs)
    tier = F.when(F.col("_n1") >= 500, 1).when(F.col("_n2") >= 100, 2).otherwise(3)

    def at(p):
        return F.when(F.col("_tier") == 1, F.col(f"{p}1")).when(F.col("_tier") == 2, F.col(f"{p}2")).otherwise(F.col(f"{p}3"))

    return t.withColumn("_tier", tier).select("leaf_id", at("_n").alias("ref_px"), at("_m").alias("ref_vs"))


def superficial(px: DataFrame, filled: DataFrame, roi: DataFrame, frames: DataFrame, min_area: int = 20,
                min_ratio: float = 1.1, mult: float = 2.0, max_sat: int = 110, edge_band: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Scraped pale tissue, and the threshold row of each leaf."""
    inside = intersect_px(P.with_hsv(px).where(~K.is_white(250)), roi)
    ref = cut_lineage(healthy_reference(inside))
    limit = F.greatest(F.lit(min_ratio), F.col("ref_vs") * mult)
    meta = ref.select("leaf_id", "ref_px", "ref_vs", F.when(F.col("ref_px") < 50, F.lit(min_ratio)).otherwise(limit).alias("vs_threshold"))
    pale = inside.join(meta.where("ref_px >= 50"), "leaf_id").where(
        (F.col("val") / F.greatest(F.col("sat"), F.lit(1)) >= F.col("vs_threshold"))
        & F.col("sat").between(12, max_sat) & F.col("val").between(55, 245)
    )
    cand = to_runs(pale)
    if edge_band > 0:
        cand = combine({"_c": cand, "_d": P.deeper_than(filled, frames, edge_band)}, "_c and _d")
    opened = morph_open(cand, CROSS, frames)
    return C.filter_components(opened, min_area), meta


def _contrast(px: DataFrame, frames: DataFrame, n: int) -> DataFrame:
    """Pixels with ``gray`` and ``drop``, n*n times the local darkening."""
    g = P.settle(px.withColumns({**K.hsv_columns(), "gray": K.gray()}))
    kept = [c for c in g.columns if c not in ("leaf_id", "y", "x")]
    return P.box_sum(g, frames, "gray", n, "_s", kept).withColumn("drop", F.col("_s") - F.col("gray") * (n * n))


def frass_global(px: DataFrame, roi: DataFrame, tissue: DataFrame, frames: DataFrame, contrast: float = 16.0,
                 dark: int = 75, chroma: int = 55, lo: int = 4, hi: int = 1200) -> DataFrame:
    """Dark neutral pellets by local contrast and size."""
    c = _contrast(px, frames, 13).where(
        (F.col("drop") >= contrast * 169) & (F.col("gray") <= dark) & K.is_neutral(chroma) & ~K.is_white(250)
    )
    cand = combine({"_c": to_runs(c), "_r": roi, "_t": tissue}, "_c and _r and _t")
    return C.filter_components(cand, lo, hi)


def frass_in_damage(px: DataFrame, damage: DataFrame, roi: DataFrame, tissue: DataFrame, frames: DataFrame,
                    contrast: float = 14.0, gray_max: int = 108, lo: int = 4, hi: int = 900) -> DataFrame:
    """Pellets sitting on or beside damage, with a milder contrast test."""
    green = F.col("hue").between(25, 90) & (F.col("sat") >= 55)
    c = _contrast(px, frames, 11).where(
        (F.col("drop") >= contrast * 121) & (F.col("gray") <= gray_max) & ~green & ~K.is_white(250)
    )
    zone = dilate_ellipse(damage, 5, frames)
    cand = combine({"_c": to_runs(c), "_z": zone, "_r": roi, "_t": tissue}, "_c and _z and _r and _t")
    comp = C.components(cand, 8)
    keys = [k for k in keys_of(comp) if k != "comp"]
    sizes = comp.groupBy(*keys, "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("area")).where(F.col("area").between(lo, hi))
    on = intersect_runs(comp, damage).select(*keys, "comp").distinct()
    return C.keep(comp, sizes.join(on, [*keys, "comp"], "left_semi"))


def partition_frass(frass: DataFrame, damage: DataFrame, undamaged: DataFrame, healthy: DataFrame | None,
                    frames: DataFrame, px: int = 5) -> DataFrame:
    """Frass pixels with a ``side``: by the nearer zone, then by colour."""
    k = ellipse_kernel(max(3, 2 * px + 1))
    layers = {"_f": frass, "_d": dilate(damage, k, frames), "_u": dilate(undamaged, k, frames)}
    green = F.lit(False)
    if healthy is not None:
        layers["_g"] = healthy
        green = F.col("_g")
    side = F.when(F.col("_d"), "damage").when(F.col("_u"), "undamaged").when(green, "undamaged").otherwise("damage")
    keys = keys_of(frass)
    return merge(overlay(layers).where("_f").select(*keys, side.alias("side"), *SPAN))

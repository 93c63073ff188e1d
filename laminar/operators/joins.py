"""Joins between photos, masks, calibration and measurement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import numeric as Q

PI = 3.141592653589793


def pair_images_masks(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match ``images(image_name)`` with ``masks(mask_name)`` by leaf identity.

    Nested duplicates are left out; of several images of one leaf the
    shortest name stays (alphabetical on ties).  The second table lists the
    images without a mask.
    """
    m = (
        masks.withColumn("_s", N.stem("mask_name"))
        .where(F.col("_s").endswith("_mask"))
        .select(N.canonical_leaf_id(F.regexp_replace("_s", "_mask$", "")).alias("leaf_id"), "mask_name")
        .groupBy("leaf_id")
        .agg(F.max("mask_name").alias("mask_name"))
    )
    i = (
        images.withColumn("_s", N.stem("image_name"))
        .where(~N.is_nested_dup("_s"))
        .select("image_name", N.canonical_leaf_id("_s").alias("leaf_id"))
    )
    best = i.groupBy("leaf_id").agg(F.min(F.struct(F.length("image_name"), "image_name")).alias("_b"))
    pairs = best.join(m, "leaf_id").select("leaf_id", F.col("_b.image_name").alias("image_name"), "mask_name")
    return pairs, i.join(m, "leaf_id", "left_anti")


def pick_by_extension(files: DataFrame) -> DataFrame:
    """One file per stem, by the order of preferred extensions."""
    rank = reduce(
        lambda acc, e: acc.when(F.col("_e") == e[1], e[0]),
        enumerate(N.PREFERRED_EXTENSIONS[1:], 1),
        F.when(F.col("_e") == N.PREFERRED_EXTENSIONS[0], 0),
    ).otherwise(len(N.PREFERRED_EXTENSIONS))
    named = files.withColumn("stem", N.stem("name")).withColumn("_e", N.extension("name"))
    return named.groupBy("stem").agg(F.min(F.struct(rank.alias("r"), "name")).alias("_b")).select(
        "stem", F.col("_b.name").alias("name")
    )


def dedupe_first(images: DataFrame) -> DataFrame:
    """First image per leaf identity in sorted order, nested names skipped."""
    s = N.stem("name")
    return (
        images.where(~N.is_nested_dup(s))
        .groupBy(N.canonical_leaf_id(s).alias("leaf_id"))
        .agg(F.min("name").alias("name"))
    )


def lookup_scale(images: DataFrame, scale_ref: DataFrame, parent_step: bool = True) -> DataFrame:
    """Scale of each ``image_name`` by falling back through its aliases.

    Order: exact name, stem, base without background suffix (bare, then with
    an extension), parent photo (bare, then with an extension), stem with an
    extension.  The reference is indexed once as bare and
    extension-stripped keys, so an image sends at most seven short probes
    into one equi-join instead of one per possible extension.
    """
    ext_rank = F.array_position(F.array(*[F.lit(e) for e in N.SCALE_EXTENSIONS]), F.regexp_extract("ref_key", r"(\.[^.]+)$", 1))
    ref = scale_ref.where("cm2_per_px2 is not null").select("ref_key", "cm2_per_px2", ext_rank.cast("int").alias("_x"))
    index = ref.select(F.col("ref_key").alias("_k"), F.lit("bare").alias("_kind"), F.lit(0).alias("_x"), "cm2_per_px2").unionByName(
        ref.where("_x > 0").select(
            F.regexp_replace("ref_key", r"\.[^.]+$", "").alias("_k"), F.lit("ext").alias("_kind"), "_x", "cm2_per_px2"
        )
    )
    named = (
        images.select("image_name")
        .withColumn("_stem", N.stem("image_name"))
        .withColumn("_base", N.scale_base("_stem"))
        .withColumn("_parent", N.parent_photo("_base"))
    )
    stripped = F.when(F.col("_base") != F.col("_stem"), F.col("_base"))
    steps = [
        (F.col("image_name"), "bare"),
        (F.col("_stem"), "bare"),
        (stripped, "bare"),
        (stripped, "ext"),
        *([(F.col("_parent"), "bare"), (F.col("_parent"), "ext")] if parent_step else []),
        (F.col("_stem"), "ext"),
    ]
    probes = named.select(
        "image_name",
        F.explode(
            F.array(
                *[
                    F.struct(k.alias("k"), F.lit(kind).alias("kind"), F.lit(p).alias("p"))
                    for p, (k, kind) in enumerate(steps)
                ]
            )
        ).alias("_t"),
    ).select("image_name", F.col("_t.k").alias("_k"), F.col("_t.kind").alias("_kind"), F.col("_t.p").alias("_p"))
    hits = probes.where("_k is not null").join(index, ["_k", "_kind"])
    best = hits.groupBy("image_name").agg(
        F.min_by("cm2_per_px2", F.struct("_p", "_x")).alias("cm2_per_px2"), F.min("_p").alias("rule")
    )
    return images.join(best, "image_name", "left")


def _factor(from_original: bool):
    """Linear factor from the calibration's pixels to leaf pixels, or null."""
    sf = F.when(F.col("scale_factor") > 0, F.col("scale_factor"))
    if not from_original:
        return sf
    return F.when(
        (F.col("scale_source") == "original_photo") & (F.col("pre_scale") > 0), F.col("pre_scale") * sf
    )


def build_scale_ref(seg_meta: DataFrame, overrides: DataFrame, known_mm: float = 6.0) -> DataFrame:
    """Square centimetres per pixel for each image, with a reason if absent.

    ``seg_meta`` carries image_id, scale_factor, pre_scale, scale_source,
    found, mm2_per_px2.  A manual mark wins; an invalid mark skips the image
    instead of falling back to the detected circle.
    """
    known = PI * (known_mm / 2) ** 2
    marked = overrides.select("image_id", F.col("diameter_px").alias("_d"), F.lit(True).alias("_has"))
    j = seg_meta.join(marked, "image_id", "left")
    manual = F.col("_has").isNotNull()
    f_man, f_auto = _factor(True), _factor(False)
    detected = F.coalesce(F.col("found"), F.lit(False)) & (F.coalesce("mm2_per_px2", F.lit(0.0)) != 0)
    reason = (
        F.when(manual & ~(F.coalesce("_d", F.lit(0.0)) > 0), "invalid_override")
        .when(manual & f_man.isNull(), "override_not_mappable")
        .when(manual, "manual")
        .when(~detected, "no_circle")
        .when(f_auto.isNull(), "no_scale_factor")
        .otherwise("detected")
    )
    circle = PI * (F.col("_d") / 2) * (F.col("_d") / 2)
    value = F.when(F.col("reason") == "manual", F.lit(known) / circle / 100.0 / (f_man * f_man)).when(
        F.col("reason") == "detected", F.col("mm2_per_px2") / 100.0 / (f_auto * f_auto)
    )
    return j.withColumn("reason", reason).select("image_id", "reason", value.alias("cm2_per_px2"))


def scale_from_scan(primary: DataFrame, scan: DataFrame, seg_meta: DataFrame) -> DataFrame:
    """Scan results mapped through same-stem metadata, only when the primary
    table holds no scale at all; unmappable images come back null."""
    usable = primary.where("cm2_per_px2 is not null")
    mapped = (
        scan.where("cm2_per_px2 is not null")
        .withColumn("image_id", N.stem("image_name"))
        .join(seg_meta.select("image_id", "scale_factor", "pre_scale", "scale_source"), "image_id", "left")
    )
    f = _factor(True)
    return mapped.where(~usable.exists()).select("image_name", (F.col("cm2_per_px2") / (f * f)).alias("cm2_per_px2"))


def scan_scale(circles: DataFrame, known_cm2: float = 0.2827) -> DataFrame:
    """Scale of a scanned photo from the dot's diameter."""
    d = F.col("diameter_px") / 2
    return circles.select(
        "image_name", F.when(F.col("diameter_px") > 0, F.lit(known_cm2) / (PI * d * d)).alias("cm2_per_px2")
    )


def mask_pairs(damaged: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damaged masks with their clean mask per dataset, and pair counts.

    Both tables carry ``dataset, stem``; the variant suffix is dropped
    before matching.
    """
    pairs = (
        damaged.select("dataset", F.col("stem").alias("damaged_stem"), N.clean_stem("stem").alias("stem"))
        .join(clean.select("dataset", "stem").distinct(), ["dataset", "stem"])
        .select("dataset", "damaged_stem", F.col("stem").alias("clean_stem"))
    )
    return pairs, pairs.groupBy("dataset").agg(F.count("*").alias("n_pairs"))


def build_measurements(results: DataFrame, meta: DataFrame, include_cm2: bool = True) -> DataFrame:
    """Export rows: metadata of the same stem wins, else the result row.

    ``results`` is ``image_name, leaf_area_px, damage_pct, leaf_area_cm2,
    damage_cm2``; ``meta`` is ``stem, leaf_area_px, damage_px, damage_pct,
    scale_cm2_per_px``.
    """
    r = results.withColumn("image_name", F.trim("image_name")).where("image_name <> ''").select(
        "image_name", N.stem("image_name").alias("stem"), *[
            Q.safe_float(c).alias(f"_r_{c}") for c in ("leaf_area_px", "damage_pct", "leaf_area_cm2", "damage_cm2")
        ]
    )
    m = meta.select("stem", F.lit(True).alias("_m"), *[
        F.col(c).alias(f"_m_{c}") for c in ("leaf_area_px", "damage_px", "damage_pct", "scale_cm2_per_px")
    ])
    j = r.join(m, "stem", "left")
    has = F.col("_m").isNotNull()
    leaf = F.when(has, Q.safe_int("_m_leaf_area_px")).otherwise(Q.safe_int("_r_leaf_area_px"))
    pct = F.when(has, Q.safe_float("_m_damage_pct", 0.0)).otherwise(F.coalesce("_r_damage_pct", F.lit(0.0)))
    rebuilt = F.when(F.col("leaf_area_px") > 0, F.rint(F.col("leaf_area_px") * F.col("_pct") / 100.0)).otherwise(0).cast("long")
    out = (
        j.withColumn("leaf_area_px", leaf)
        .withColumn("_pct", pct)
        .withColumn("damage_px", F.when(has, Q.safe_int("_m_damage_px")).otherwise(rebuilt))
        .withColumn("undamaged_px", F.greatest(F.lit(0), F.col("leaf_area_px") - F.col("damage_px")).cast("long"))
        .withColumn("damage_pct", Q.round_pct("_pct"))
        .withColumn("undamaged_pct", Q.round_pct(F.greatest(F.lit(0.0), 100.0 - F.col("_pct"))))
    )
    cols = ["image_name", "leaf_area_px", "damage_px", "undamaged_px", "damage_pct", "undamaged_pct"]
    if include_cm2:
        scale = F.when(Q.safe_float("_m_scale_cm2_per_px") > 0, Q.safe_float("_m_scale_cm2_per_px"))
        out = (
            out.withColumn("_s", scale)
            .withColumn("scale_cm2_per_px", Q.round_scale("_s"))
            .withColumn("leaf_area_cm2", F.when(F.col("_s").isNotNull(), Q.round_cm2(F.coalesce("_r_leaf_area_cm2", F.col("leaf_area_px") * F.col("_s")))))
            .withColumn("damage_cm2", F.when(F.col("_s").isNotNull(), Q.round_cm2(F.coalesce("_r_damage_cm2", F.col("damage_px") * F.col("_s")))))
            .withColumn("undamaged_cm2", Q.round_cm2(F.col("undamaged_px") * F.col("_s")))
        )
        cols += ["scale_cm2_per_px", "leaf_area_cm2", "damage_cm2", "undamaged_cm2"]
    return out.select(*cols)


def photo_circle_to_leaves(leaves: DataFrame, circles: DataFrame) -> DataFrame:
    """Every leaf of a photo gets the photo's reference circle."""
    return leaves.join(circles, "photo_id", "left")


def apply_priors(masks: DataFrame, boxes: DataFrame, points: DataFrame, frames: DataFrame,
                 margin: float = 0.25) -> DataFrame:
    """Masks limited by optional box and point hints (both keyed by leaf)."""
    from .components import component_at, largest
    from .runs import SPAN, box_region, box_runs, keys_of, mask_and

    keys = keys_of(masks)
    region = box_runs(box_region(boxes.join(frames, keys), margin).drop("h", "w"))
    boxed = mask_and(masks, region.select(*keys, *SPAN)).unionByName(
        masks.join(boxes.select(*keys), keys, "left_anti").select(*keys, *SPAN)
    )
    with_point = boxed.join(points.select(*keys), keys, "left_semi").select(*keys, *SPAN)
    without = boxed.join(points.select(*keys), keys, "left_anti").select(*keys, *SPAN)
    return component_at(with_point, points, "largest").unionByName(largest(without))


def split_inputs(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of isolated leaves, and of photos still to be segmented."""
    done = N.is_preextracted(N.stem("name"))
    return names.where(done), names.where(~done)


def merge_outputs(extracted: DataFrame, isolated: DataFrame) -> DataFrame:
    """Segmented leaves plus isolated inputs that would overwrite none."""
    return extracted.unionByName(isolated.join(extracted.select("name"), "name", "left_anti"))


def promote_masks(preview: DataFrame, masks: DataFrame) -> DataFrame:
    """Edited contour masks replace the analysis masks of the same leaf."""
    p = preview.select(
        F.regexp_replace(F.regexp_replace("stem", "_leaf_mask$", ""), "(?i)_white_bg$", "").alias("leaf_id"),
        F.col("ref"),
        F.lit("preview").alias("source"),
    )
    p = p.groupBy("leaf_id").agg(F.max_by("ref", "ref").alias("ref"), F.max("source").alias("source"))
    kept = masks.select("leaf_id", "ref", F.lit("masks").alias("source")).join(p.select("leaf_id"), "leaf_id", "left_anti")
    return p.unionByName(kept)

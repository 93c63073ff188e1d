"""Roll-ups, unit choice, ranks, splits and reports over measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import naming as N
from ..functions import numeric as Q


def with_cm2(fragments: DataFrame, scale: DataFrame) -> DataFrame:
    """Square centimetres per fragment; blank for images without a scale."""
    j = fragments.join(scale.select("image_name", "cm2_per_px2"), "image_name", "left")
    s = F.when(F.col("cm2_per_px2") != 0, F.col("cm2_per_px2"))
    return j.withColumn("leaf_area_cm2", Q.round_cm2(F.col("leaf_area_px") * s)).withColumn(
        "damage_cm2", Q.round_cm2(F.col("damage_px") * s)
    )


def rollup_images(fragments: DataFrame) -> DataFrame:
    """Fragments to images: pixel sums, percent of sums, summed cm2.

    Square centimetres are summed after their per-fragment rounding.
    """
    both = F.col("leaf_area_cm2").isNotNull() & F.col("damage_cm2").isNotNull()
    sums = fragments.groupBy("image_name").agg(
        F.sum("leaf_area_px").cast("long").alias("leaf_area_px"),
        F.sum("damage_px").cast("long").alias("damage_px"),
        F.sum(F.when(both, F.col("leaf_area_cm2"))).alias("_a"),
        F.sum(F.when(both, F.col("damage_cm2"))).alias("_d"),
        F.max(both).alias("has_cm2"),
    )
    return sums.select(
        N.photo_number("image_name").alias("photo_number"),
        "image_name",
        "leaf_area_px",
        "damage_px",
        Q.round_pct(Q.pct("damage_px", "leaf_area_px")).alias("damage_pct"),
        Q.round_cm2("_a").alias("leaf_area_cm2"),
        Q.round_cm2("_d").alias("damage_cm2"),
        "has_cm2",
    )


def unit_mode(results: DataFrame) -> DataFrame:
    """The two display columns in the unit of the whole table.

    One image with a scale switches every row's column names to square
    centimetres; rows without a scale then still show pixels and percent.
    The flag is a scalar subquery, not a window over the whole table.
    """
    any_cm2 = results.agg(F.max("has_cm2")).scalar()
    return results.select(
        "photo_number",
        "image_name",
        F.when(any_cm2, "cm2").otherwise("px_pct").alias("unit"),
        F.when(F.col("has_cm2"), F.col("leaf_area_cm2")).otherwise(F.col("leaf_area_px").cast("double")).alias("leaf_area"),
        F.when(F.col("has_cm2"), F.col("damage_cm2")).otherwise(F.col("damage_pct")).alias("damage"),
    )


def weighted_damage(fragments: DataFrame) -> DataFrame:
    """Fragment damage next to the area-weighted damage of its image.

    The image sums are aggregated first and joined back, so one image with
    very many fragments never gathers in a single window group.
    """
    total = fragments.groupBy("image_name").agg(F.sum("damage_px").alias("_d"), F.sum("leaf_area_px").alias("_a"))
    return fragments.join(total, "image_name").select(
        *fragments.columns,
        Q.round_pct(Q.pct("damage_px", "leaf_area_px")).alias("fragment_pct"),
        Q.round_pct(F.col("_d") / F.greatest(F.lit(1), F.col("_a")) * 100.0).alias("image_pct"),
    )


def rank_leaves(fragments: DataFrame) -> DataFrame:
    """Fragments of an image numbered by area, largest first."""
    w = W.partitionBy("image_name").orderBy(F.desc("leaf_area_px"), "frag")
    return fragments.withColumn("rank", F.row_number().over(w))


def best_circle(cands: DataFrame, images: DataFrame, min_conf: float = 0.45, known_mm: float | None = 6.0) -> DataFrame:
    """Best-scoring circle of every image; an earlier method wins ties.

    ``cands`` is ``image_id, method_rank, method, diameter_px, area_px,
    score``.  An image of ``images`` without a candidate has ``found`` false
    and a low confidence.
    """
    best = cands.groupBy("image_id").agg(
        F.min_by(F.struct("method", "diameter_px", "area_px", "score"), F.struct(-F.col("score"), F.col("method_rank"))).alias("b")
    )
    out = images.select("image_id").distinct().join(best, "image_id", "left").select(
        "image_id", F.col("b").isNotNull().alias("found"), "b.*"
    ).withColumn("low_confidence", F.coalesce(F.col("score") < min_conf, F.lit(True)))
    if known_mm:
        area = 3.141592653589793 * (known_mm / 2) ** 2
        out = out.withColumn("mm_per_px", F.lit(known_mm) / F.col("diameter_px")).withColumn(
            "mm2_per_px2", F.lit(area) / F.col("area_px")
        )
    return out


def choose_mask(cands: DataFrame, min_px: int) -> DataFrame:
    """Pick one candidate mask per leaf by the fallback rules.

    ``cands`` is ``leaf_id, priority, name, area`` with priority 0 for the
    merged mask and 1 for the first model.  A too small merge yields to the
    first model; later candidates replace a too small choice only when they
    are larger.  The fold runs over the few candidates of a leaf.
    """
    folded = cands.groupBy("leaf_id").agg(F.sort_array(F.collect_list(F.struct("priority", "area", "name"))).alias("c"))
    pick = F.expr(
        f"""aggregate(slice(c, 2, size(c)), c[0],
              (acc, n) -> case when acc.area >= {min_px} then acc
                               when n.priority = 1 or n.area > acc.area then n else acc end)"""
    )
    return folded.select("leaf_id", pick.alias("p")).select("leaf_id", F.col("p.name").alias("chosen"), F.col("p.area").alias("area"))


def qc_low_confidence(seg_meta: DataFrame, overrides: DataFrame) -> DataFrame:
    """Images whose circle is missing or doubtful and not marked by hand."""
    doubt = ~F.coalesce("found", F.lit(False)) | F.coalesce("low_confidence", F.lit(False))
    return seg_meta.where(doubt).join(overrides.select("image_id"), "image_id", "left_anti").select("image_id")


def run_summary(seg_meta: DataFrame, overrides: DataFrame, masks: DataFrame) -> DataFrame:
    """Counts of a run in one row."""
    j = seg_meta.join(overrides.select("image_id", F.lit(1).alias("_o")), "image_id", "left").join(
        masks.select("image_id", F.lit(1).alias("_m")), "image_id", "left"
    )
    return j.agg(
        F.count("*").alias("n_images"),
        F.count_if(F.coalesce("found", F.lit(False))).alias("n_detected"),
        F.count_if(F.col("_o") == 1).alias("n_manual"),
        F.count_if(F.col("_m") == 1).alias("n_masks"),
        F.count_if(F.col("_m").isNull()).alias("n_failed"),
    )


def summary_by_kind(manifest: DataFrame) -> DataFrame:
    """Damage fractions per kind over the untransformed rows."""
    return manifest.where("geom = 'id'").groupBy("kind").agg(
        F.count("*").alias("n"),
        F.avg("damage_frac").alias("mean_frac"),
        F.min("damage_frac").alias("min_frac"),
        F.max("damage_frac").alias("max_frac"),
    )


def seeded_hash(key, seed: int):
    """Reproducible pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def qc_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` reproducible random rows (top-n by hash, merged per partition)."""
    return df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h").limit(n).drop("_h")


def split_by_leaf(pairs: DataFrame, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Train/validation label per pair, all copies of a leaf together.

    The validation part is the ``clamp(round(n * val), 1, n - 1)`` leaves with
    the smallest hash.  A 4096-bin histogram of hashes finds the bin that
    holds the cut; ranks are taken inside bins only, so no task sees more
    than a sliver of the leaves.
    """
    leaves = pairs.select(N.training_leaf_id("stem").alias("leaf")).distinct()
    hashed = leaves.withColumn("_h", seeded_hash("leaf", seed)).withColumn("_bin", F.substring("_h", 1, 3))
    bins = hashed.groupBy("_bin").agg(F.count("*").alias("_n"))
    upto = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # at most 4096 rows
    everything = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut = bins.select(
        "_bin", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_total")
    )
    n_val = F.when(
        F.col("_total") > 1,
        F.least(F.greatest(F.rint(F.col("_total") * val), F.lit(1)), F.col("_total") - 1),
    ).otherwise(1)
    ranked = hashed.join(cut, "_bin").withColumn(
        "_r", F.col("_before") + F.row_number().over(W.partitionBy("_bin").orderBy("_h", "leaf"))
    )
    split = ranked.select("leaf", F.when(F.col("_r") <= n_val, "val").otherwise("train").alias("split"))
    return pairs.withColumn("leaf", N.training_leaf_id("stem")).join(split, "leaf")


def unprocessed(photos: DataFrame, done: DataFrame, key: str = "photo_id") -> DataFrame:
    """Photos without a finished result."""
    return photos.join(done.select(key), key, "left_anti")


def upsert_results(results: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply the latest update of each image to its result row.

    ``updates`` is ``image_name, seq`` plus any measurement columns; only
    columns the results have are touched, unknown images are ignored.  If
    the results keep ``last_seq``, an update only counts when its ``seq`` is
    larger, so the order and repetition of batches do not matter.
    """
    cols = [c for c in results.columns if c not in ("image_name", "last_seq") and c in updates.columns]
    kept = "last_seq" in results.columns
    latest = updates.groupBy("image_name").agg(F.max_by(F.struct("seq", *cols), "seq").alias("_u"))
    j = results.join(latest, "image_name", "left")
    newer = F.col("_u").isNotNull()
    if kept:
        newer = newer & (F.col("last_seq").isNull() | (F.col("_u.seq") > F.col("last_seq")))
    source = {c: f"_u.{c}" for c in cols} | ({"last_seq": "_u.seq"} if kept else {})
    return j.select(
        *[
            F.when(newer, F.coalesce(F.col(source[c]), F.col(c))).otherwise(F.col(c)).cast(results.schema[c].dataType).alias(c)
            if c in source else F.col(c)
            for c in results.columns
        ]
    )


def purge(tables: dict[str, DataFrame], stems: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given stems and their
    background-suffixed twins (tables carry ``stem``)."""
    gone = stems.select(F.explode(F.array("stem", F.concat("stem", F.lit("_white_bg")))).alias("stem")).distinct()
    return {name: t.join(gone, "stem", "left_anti") for name, t in tables.items()}


def recompute(meta: DataFrame, damage_area: DataFrame) -> DataFrame:
    """Damage after edits; the leaf area stays, damage may exceed it."""
    j = meta.select("leaf_id", "leaf_area_px").join(damage_area, "leaf_id", "left")
    d = F.coalesce("area", F.lit(0)).cast("long")
    return j.select("leaf_id", "leaf_area_px", d.alias("damage_px"), Q.round_pct(Q.pct(d, "leaf_area_px")).alias("damage_pct"))


def silhouette_damage(solid: DataFrame, final: DataFrame) -> DataFrame:
    """Silhouette minus remaining tissue, in pixels and percent."""
    j = solid.select("leaf_id", F.col("area").alias("silhouette_px")).join(
        final.select("leaf_id", F.col("area").alias("remaining_px")), "leaf_id", "left"
    ).fillna(0, ["remaining_px"])
    d = F.greatest(F.lit(0), F.col("silhouette_px") - F.col("remaining_px")).cast("long")
    return j.withColumn("damage_px", d).withColumn("damage_percent", F.bround(Q.pct("damage_px", "silhouette_px"), 4))

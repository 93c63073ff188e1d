"""Line-level near-duplicate removal from sidecar texts by a deletion-neighbourhood join.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, stored

LINE = ["h1", "h2"]  # 128-bit fingerprint of a line
PLACE = ["image_id", "text_hash", "line_no"]  # texts that share an id are told apart by their hash
LEAST_WORDS = 3  # in shorter lines one edit is no likeness


def _lines(texts: DataFrame) -> DataFrame:
    """Every non-blank line with its place and fingerprint."""
    split = texts.select(
        "image_id", F.xxhash64("meta_text").alias("text_hash"), F.posexplode(F.split("meta_text", "\n")).alias("line_no", "line")
    )
    trimmed = split.withColumn("line", F.trim("line")).where("line <> ''")
    return trimmed.select(
        *PLACE, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")
    )


def _half_keys(least_words: int) -> str:
    """Keys that two lines within one edit must share: equal first or last halves, told apart by the longer length.

    With p common leading and s common trailing words, one edit leaves p + s >= (longer length) - 1, so p or s is at
    least half of the longer length, rounded down.
    """
    half = "cast({m} div 2 as int)"
    keys = []
    for longer in ("n", "n + 1"):
        f = half.format(m=f"({longer})")
        keys.append(f"xxhash64('first', {longer}, slice(words, 1, {f}))")
        keys.append(f"xxhash64('last', {longer}, slice(words, n - {f} + 1, {f}))")
    return f"case when n >= {least_words} then array({', '.join(keys)}) end"


def duplicate_lines(sidecars: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Distinct lines with their earliest place and whether they go: ``first (image_id, text_hash, line_no), n, near``.

    A line is near an earlier one if a single word was inserted, deleted or replaced; lines of fewer than
    ``least_words`` words are only compared for equality.
    """
    texts = sidecars.select("image_id", "meta_text").where("image_id is not null and meta_text is not null")
    keyed = (
        _lines(texts)
        .withColumn("words", F.split("line", " "))
        .withColumn("n", F.size("words"))
        .select(*LINE, "n", F.struct(*PLACE).alias("place"), F.expr(_half_keys(least_words)).alias("keys"))
        .select(*LINE, "n", "place", *[F.expr(f"keys[{i}]").alias(f"k{i}") for i in range(4)])
    )
    distinct = stored(
        keyed.groupBy(*LINE).agg(
            F.min("place").alias("first"), F.max("n").alias("n"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(4)]
        ).drop(*LINE),
        "lines",
    )

    # Lines that share half of their words with another line; no other line can be within one edit.
    halves = distinct.where(f"n >= {least_words}").select(
        "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")
    )
    met = halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    near_by = halves.join(met, "key", "left_semi").select("first").distinct()
    spot = near_by.select("first.*")
    texts_of = stored(
        _lines(texts)
        .join(spot, PLACE, "left_semi")
        .select(F.struct(*PLACE).alias("first"), "line")
        .dropDuplicates(["first"]),
        "near-lines",
    )

    # Deletion neighbourhood: the line itself and the line without each of its words.  The key of a word sequence is the
    # exclusive or of hashes of (word, place); words after the gap move up by one place.
    words = texts_of.select("first", F.posexplode(F.split("line", " ")).alias("at", "word"))
    line = Window.partitionBy("first")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hashed = words.select("first", "at", F.xxhash64("word", "at").alias("x"), F.xxhash64("word", F.col("at") - 1).alias("y"))
    summed = hashed.select(
        "first", "at", "x", "y", F.bit_xor("x").over(upto).alias("x_upto"), F.bit_xor("y").over(upto).alias("y_upto"),
        F.bit_xor("x").over(whole).alias("x_all"), F.bit_xor("y").over(whole).alias("y_all"),
        F.count("*").over(whole).cast("int").alias("n"),
    )
    variants = summed.select(
        "first",
        F.expr(
            "inline(if(at = 0, array(struct(x_all as key, n as size, -1 as gap), "
            "struct(x_upto ^ x ^ y_all ^ y_upto as key, n - 1 as size, at as gap)), "
            "array(struct(x_upto ^ x ^ y_all ^ y_upto as key, n - 1 as size, at as gap))))"
        ),
    )
    variants = stored(variants, "variants")

    # Equal variants.  The same gap means one replaced word; a whole line equal to a variant means one more word.
    spots = variants.groupBy("key", "size", "gap").agg(F.min("first").alias("same"), F.count("*").alias("c"))
    buckets = spots.groupBy("key", "size").agg(
        F.min(F.when(F.col("gap") < 0, F.col("same"))).alias("full"),
        F.min(F.when(F.col("gap") >= 0, F.col("same"))).alias("cut"),
        F.sum("c").alias("members"),
    ).where("members > 1")
    partners = spots.join(buckets, ["key", "size"]).select(
        "key", "size", "gap", F.when(F.col("gap") < 0, F.col("cut")).otherwise(F.least("same", "full")).alias("earlier")
    )
    candidates = (
        variants.join(partners, ["key", "size", "gap"])
        .where("earlier < first")
        .groupBy("first")
        .agg(F.min("earlier").alias("earlier"))
    )
    sides = texts_of.select("first", F.split("line", " ").alias("a"))
    others = texts_of.select(F.col("first").alias("earlier"), F.split("line", " ").alias("b"))
    same = "coalesce(nullif(array_position(zip_with({0}, {1}, (v, w) -> v <=> w), false), 0) - 1, size({0}))"
    near = (
        candidates.join(sides, "first")
        .join(others, "earlier")
        .withColumn("p", F.expr(same.format("a", "b")))
        .withColumn("s", F.expr(same.format("reverse(a)", "reverse(b)")))
        .where("abs(size(a) - size(b)) <= 1")
        .where("p + s >= least(size(a), size(b)) - if(size(a) = size(b), 1, 0)")
        .select("first", F.lit(True).alias("near"))
    )
    near = stored(near, "near")
    discard(variants)
    discard(texts_of)
    return distinct.select("first", "n").join(near, "first", "left").select(
        "first", "n", F.coalesce("near", F.lit(False)).alias("near")
    )


def drop_duplicate_lines(sidecars: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Remove lines of sidecar texts (``image_id, meta_text``) that repeat an earlier line or differ by one word.

    Lines are parted by line feeds and trimmed of spaces; words are parted by single spaces.  Earlier means smaller
    ``(image_id, hash of the text, line number)``; the hash only matters where an id has several texts.  A line goes if an earlier line equals it, or if it has ``least_words`` words or more
    and an earlier line of as many is one inserted, deleted or replaced word away.  Blank lines stay.

    Candidates come from a join of hashed deletion variants and are verified word by word.  Equal lines collapse before
    the join, and lines that share no half with another cannot match and emit no variants.  In a bucket only its
    earliest members are compared with the rest, so a common line costs no pairs.

    Returns ``image_id, meta_text`` (what is left)``, n_lines`` (non-blank)``, n_dropped`` and the other input columns.
    A null text stays null with 0 lines; rows without an id are returned as they are and remove nothing; rows that
    repeat an id and text count as one text.  An empty table gives an empty result.
    """
    lines = duplicate_lines(sidecars, least_words)
    masks = (
        lines.where("not near")
        .select(
            "first.image_id",
            "first.text_hash",
            F.expr("cast(first.line_no div 63 as int)").alias("block"),
            F.expr("shiftleft(1L, cast(first.line_no % 63 as int))").alias("bit"),
        )
        .groupBy("image_id", "text_hash", "block")
        .agg(F.bit_or("bit").alias("mask"))
        .groupBy("image_id", "text_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("_masks"))
    )
    masks = masks.withColumnsRenamed({"image_id": "_id", "text_hash": "_hash"})
    own = (F.col("image_id") == F.col("_id")) & (F.xxhash64("meta_text") == F.col("_hash"))
    joined = sidecars.join(masks, own, "left").withColumn("_lines", F.split("meta_text", "\n"))
    dense = joined.withColumn(
        "_dense", F.expr("transform(sequence(0, cast((size(_lines) - 1) div 63 as int)), b -> coalesce(_masks[b], 0L))")
    )
    keep = "trim(l) = '' or image_id is null or shiftright(_dense[cast(i div 63 as int)], cast(i % 63 as int)) & 1L = 1L"
    left = dense.withColumn("_left", F.expr(f"filter(_lines, (l, i) -> {keep})"))
    others = [c for c in sidecars.columns if c not in ("image_id", "meta_text", "n_lines", "n_dropped")]
    count = "coalesce(size(filter({0}, l -> trim(l) <> '')), 0)"
    return left.select(
        "image_id",
        F.expr("array_join(_left, '\\n')").alias("meta_text"),
        F.expr(f"cast(if(meta_text is null, 0, {count.format('_lines')}) as bigint)").alias("n_lines"),
        F.expr(f"cast(if(meta_text is null, 0, {count.format('_lines')} - {count.format('_left')}) as bigint)").alias("n_dropped"),
        *others,
    )

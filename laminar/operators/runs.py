"""Mask algebra on run-length tables.

A mask is a DataFrame ``(keys..., y, x0, x1)`` with half-open runs
``[x0, x1)``.  Every column other than ``y, x0, x1`` is a key, so one table
can carry several leaves, layers or fragments and every operator below works
on all of them in one pass.

All operators shuffle on ``(keys, y)`` - one scan line of one leaf - so the
largest group any task sees is bounded by the width of a picture, no matter
how many scan lines a leaf has or how uneven the leaves are.  Morphology
with a fixed kernel shuffles on ``(keys, band)``, at most ``MORPH_ROWS`` scan
lines and the lines near them that the kernel reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import ship

SPAN = ("y", "x0", "x1")
WORD = 32
MORPH_ROWS = 256  # scan lines of one picture that morphology treats together
COPIES = 1 << 21  # widened runs at once, or those of one group


def keys_of(df: DataFrame, *extra: str) -> list[str]:
    skip = set(SPAN) | set(extra)
    return [c for c in df.columns if c not in skip]


def _line(keys: Sequence[str]) -> list[str]:
    return [*keys, "y"]


# --------------------------------------------------------------------------
# pixels <-> runs
# --------------------------------------------------------------------------


def to_runs(px: DataFrame, layers: dict[str, Column] | None = None, keys: Sequence[str] = ("leaf_id",)) -> DataFrame:
    """Pixels -> runs, for one mask or many named layers in a single shuffle.

    Pixels are folded into 32-pixel words with a bitwise OR before the
    shuffle, so a scan line travels as a handful of integers instead of one
    row per pixel; repeated pixels collapse on the way.
    """
    keys = list(keys)
    named = layers is not None
    layers = layers or {"mask": F.lit(True)}
    bit = F.expr(f"shiftleft(1L, cast(x as int) & {WORD - 1})")
    packed = px.groupBy(*keys, "y", F.expr("shiftright(cast(x as int), 5)").alias("_w")).agg(
        *[
            F.bit_or(F.when(cond, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{i}")
            for i, cond in enumerate(layers.values())
        ]
    )
    # the words of a scan line meet in one row; where they lie already fixes where it is built
    ship(px.sparkSession)
    masks = [f"_m{i}" for i in range(len(layers))]
    lined = packed.where(" or ".join(f"{m} <> 0" for m in masks)).groupBy(*keys, "y")
    words = lined.agg(F.sort_array(F.collect_list(F.struct("_w", *masks))).alias("_words")).withColumn("y", F.col("y").cast("int"))
    fields = [T.StructField(f.name, f.dataType) for f in words.select(*keys).schema.fields]
    layer = [T.StructField("layer", T.StringType())] if named else []
    schema = T.StructType([*fields, *layer, *[T.StructField(c, T.IntegerType()) for c in SPAN]])
    return words.mapInArrow(_word_runs(keys, list(layers) if named else None), schema)


def _word_runs(keys: Sequence[str], names: Sequence[str] | None):
    """Runs of every layer from scan lines of words ``(_w, _m0, _m1, ...)`` sorted by ``_w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            columns = lists.flatten().flatten()
            place = columns[0].to_numpy().astype(np.int64)
            after = (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1)  # words that continue the one before
            for i, mask in enumerate(columns[1:]):
                bits = np.unpackbits(mask.to_numpy().astype("<u4").view(np.uint8), bitorder="little").reshape(-1, WORD)
                before, behind = np.zeros_like(bits), np.zeros_like(bits)
                before[:, 1:], behind[:, :-1] = bits[:, :-1], bits[:, 1:]
                before[1:, 0], behind[:-1, -1] = bits[:-1, -1] & after, bits[1:, 0] & after
                first, last = (np.flatnonzero(bits > near) for near in (before, behind))
                of = pa.array(owner[first // WORD])
                x0, x1 = (place[at // WORD] * WORD + at % WORD for at in (first, last))
                out = [batch.column(c).take(of) for c in keys]
                out += [pa.repeat(names[i], len(first))] if names else []
                out += [batch.column("y").take(of), pa.array(x0.astype(np.int32)), pa.array((x1 + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, [*keys, *(["layer"] if names else []), *SPAN])

    return run


def to_pixels(runs: DataFrame) -> DataFrame:
    """Runs -> one row per pixel."""
    keys = keys_of(runs)
    return runs.select(*keys, "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))


def pick(layered: DataFrame, name: str) -> DataFrame:
    """One layer of a layered run table."""
    return layered.where(F.col("layer") == name).drop("layer")


def tag(runs: DataFrame, **values) -> DataFrame:
    """Add constant key columns (for example ``layer='damage'``)."""
    keys = keys_of(runs)
    return runs.select(*keys, *[F.lit(v).alias(k) for k, v in values.items()], *SPAN)


# --------------------------------------------------------------------------
# set operations
# --------------------------------------------------------------------------


def merge(runs: DataFrame) -> DataFrame:
    """Disjoint, maximal runs: overlapping and touching runs become one.

    A run opens an island when it starts beyond everything seen before; the
    island ends where the next one's "seen before" mark stands.
    """
    keys = keys_of(runs)
    line = W.partitionBy(*_line(keys)).orderBy("x0")
    seen = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    total = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    opens = (
        runs.where("x1 > x0")
        .select(*keys, "y", "x0", seen.alias("_seen"), total.alias("_all"))
        .where("_seen is null or x0 > _seen")
    )
    return opens.select(*keys, "y", "x0", F.coalesce(F.lead("_seen").over(line), F.col("_all")).alias("x1"))


def overlay(layers: dict[str, DataFrame]) -> DataFrame:
    """Cut every scan line where any layer changes.

    Returns ``(keys..., y, x0, x1, <one boolean column per layer>)``.  Any
    number of masks meet in one shuffle; overlapping runs inside a layer are
    fine.  Boolean algebra and area counts over several masks are then plain
    column expressions.
    """
    names = list(layers)
    keys = keys_of(next(iter(layers.values())))
    events = None
    for i, name in enumerate(names):
        part = layers[name].select(
            *keys,
            "y",
            F.explode(
                F.array(
                    F.struct(F.col("x0").cast("int").alias("x"), F.lit(1).alias("d")),
                    F.struct(F.col("x1").cast("int").alias("x"), F.lit(-1).alias("d")),
                )
            ).alias("_e"),
        ).select(*keys, F.col("y").cast("int").alias("y"), F.lit(i).alias("_l"), "_e.x", "_e.d")
        events = part if events is None else events.unionByName(part)
    line = W.partitionBy(*_line(keys)).orderBy("x")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    cut = events.select(
        *keys,
        "y",
        F.col("x").alias("x0"),
        F.lead("x").over(line).alias("x1"),
        *[
            (F.sum(F.when(F.col("_l") == i, F.col("d")).otherwise(0)).over(upto) > 0).alias(n)
            for i, n in enumerate(names)
        ],
    )
    return cut.where("x1 > x0")


def combine(layers: dict[str, DataFrame], where: str | Column) -> DataFrame:
    """Pixels of an overlay satisfying a boolean expression over layer names."""
    cond = F.expr(where) if isinstance(where, str) else where
    keys = keys_of(next(iter(layers.values())))
    return merge(overlay(layers).where(cond).select(*keys, *SPAN))


def mask_or(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return merge(out)


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine({"_a": a, "_b": b}, "_a and _b")


def mask_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine({"_a": a, "_b": b}, "_a and not _b")


def frame_runs(frames: DataFrame) -> DataFrame:
    """The full picture as a mask; ``frames`` is ``(keys..., h, w)``."""
    keys = [c for c in frames.columns if c not in ("h", "w")]
    return frames.select(
        *keys,
        F.explode(F.expr("sequence(0, cast(h as int) - 1)")).alias("y"),
        F.lit(0).alias("x0"),
        F.col("w").cast("int").alias("x1"),
    )


def _frames_for(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Repeat frames for extra keys (layers, thresholds, sizes) the runs carry."""
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    if set(keys) == set(fkeys):
        return frames
    return frames.join(runs.select(*keys).distinct(), fkeys).select(*keys, "h", "w")


def _with_marks(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs plus one empty marker per scan line of the picture.

    The marker stands at the right edge and carries the width, so clipping
    to the picture happens inside the scan-line window and needs no join.
    """
    keys = keys_of(runs)
    marks = frame_runs(_frames_for(runs, frames)).select(*keys, "y", F.col("x1").alias("x0"), "x1", F.col("x1").alias("_w"))
    return runs.select(*keys, *SPAN, F.lit(None).cast("int").alias("_w")).unionByName(marks)


def mask_not(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Complement inside the frame; scan lines without any run become full.

    Every gap lies between a run (or the right-edge marker) and whatever
    ended before it.  Runs may overlap or stick out of the picture.
    """
    keys = keys_of(runs)
    line = W.partitionBy(*_line(keys)).orderBy("x0")
    seen = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    width = F.max("_w").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        _with_marks(runs, frames)
        .select(*keys, "y", F.greatest(F.coalesce(seen, F.lit(0)), F.lit(0)).alias("_from"), "x0", width.alias("_width"))
        .select(*keys, "y", F.col("_from").alias("x0"), F.least("x0", "_width").alias("x1"), "_width")
        .where("_width is not null and x1 > x0")
        .select(*keys, *SPAN)
    )


def clip_to_frame(runs: DataFrame, frames: DataFrame) -> DataFrame:
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    return (
        runs.join(frames, fkeys)
        .where("y >= 0 and y < h")
        .select(
            *keys,
            "y",
            F.greatest("x0", F.lit(0)).alias("x0"),
            F.least("x1", F.col("w").cast("int")).alias("x1"),
        )
        .where("x1 > x0")
    )


def clip_classes(classes: DataFrame, roi: DataFrame, keys: Sequence[str] = ("leaf_id",)) -> DataFrame:
    """Class map with every pixel outside the region set to background."""
    keys = list(keys)
    lines = roi.groupBy(*keys, "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_in")).hint("shuffle_hash")
    inside = F.exists("_in", lambda r: (F.col("x") >= r["x0"]) & (F.col("x") < r["x1"]))
    return (
        classes.join(lines, [*keys, "y"], "left")
        .withColumn("cls", F.when(inside, F.col("cls")).otherwise(0).cast("int"))
        .drop("_in")
    )


def area(runs: DataFrame, name: str = "area") -> DataFrame:
    keys = keys_of(runs)
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias(name))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection, union and their ratio (0 where the union is empty)."""
    keys = keys_of(a)
    size = F.col("x1") - F.col("x0")
    return (
        overlay({"_a": a, "_b": b})
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.expr("_a and _b"), size).otherwise(0)).cast("long").alias("inter_px"),
            F.sum(F.when(F.expr("_a or _b"), size).otherwise(0)).cast("long").alias("union_px"),
        )
        .withColumn(
            "iou",
            F.when(F.col("union_px") > 0, F.col("inter_px") / F.col("union_px")).otherwise(0.0),
        )
    )


# --------------------------------------------------------------------------
# structuring elements
# --------------------------------------------------------------------------


def square_kernel(k: int) -> list[tuple[int, int, int]]:
    """Rows ``(dy, left, right)`` of a k x k box anchored at ``k // 2``."""
    c = k // 2
    return [(i - c, c, k - 1 - c) for i in range(k)]


def ellipse_kernel(k: int) -> list[tuple[int, int, int]]:
    """Rows of the k x k elliptic element (3 is a cross, 5 is 1,5,5,5,1)."""
    r = k // 2
    rows = []
    for dy in range(-r, k - r):
        if abs(dy) > r:
            continue
        half = 0 if r == 0 else round(r * math.sqrt((r * r - dy * dy) / (r * r)))
        rows.append((dy, half, min(half, k - 1 - r)))
    return rows


def disk_kernel(limit2: float, strict: bool = True) -> list[tuple[int, int, int]]:
    """Offsets with ``dx^2 + dy^2 < limit2`` (``<=`` when not strict)."""
    rows = []
    r = int(math.isqrt(int(math.ceil(limit2))) + 1)
    for dy in range(-r, r + 1):
        fits = [dx for dx in range(0, r + 1) if (dx * dx + dy * dy < limit2 if strict else dx * dx + dy * dy <= limit2)]
        if fits:
            rows.append((dy, max(fits), max(fits)))
    return rows


# --------------------------------------------------------------------------
# morphology
# --------------------------------------------------------------------------


def compose(kernel: Sequence[tuple[int, int, int]], times: int) -> list[tuple[int, int, int]]:
    """One kernel doing the work of ``times`` passes.

    Exact for kernels whose rows shrink away from the centre: every combined
    step then splits into steps that stay inside the picture.
    """
    rows = {dy: (lo, hi) for dy, lo, hi in kernel}
    total = dict(rows)
    for _ in range(times - 1):
        nxt: dict[int, tuple[int, int]] = {}
        for a, (alo, ahi) in total.items():
            for b, (blo, bhi) in rows.items():
                lo, hi = nxt.get(a + b, (-1, -1))
                nxt[a + b] = (max(lo, alo + blo), max(hi, ahi + bhi))
        total = nxt
    return [(dy, lo, hi) for dy, (lo, hi) in sorted(total.items())]


def _times(kernel, iterations: int):
    if iterations == 1:
        return kernel
    if isinstance(kernel, str):
        raise ValueError("a kernel that differs by leaf works in one pass")
    return compose(kernel, iterations)


# One pass of whole bands: the runs themselves are shuffled, once for all steps
# of an operator, and widened where they arrive; their copies never travel.


def _starts(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before; nulls are equal."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in keys:
        v = batch.column(c)
        a, b = v.slice(0, len(v) - 1), v.slice(1)
        differs = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= np.asarray(differs)
    return new


def in_groups(df: DataFrame, group_by: Sequence[str], order: Sequence[str], apply, schema, rows: int = 0) -> DataFrame:
    """Whole groups of sorted rows, many at a time, through ``apply``: an Arrow table in, record batches out.

    Tables end where a group does and hold ``rows`` rows or more if there are as many, so a group costs no call of its own.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows >= rows:
                joint = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
                cuts = np.flatnonzero(_starts(joint, group_by)) - bool(held)
                if len(cuts):
                    cut = int(cuts[-1])
                    yield from apply(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                    held = [batch.slice(cut)]
                    continue
            held.append(batch)
        if held:
            yield from apply(pa.Table.from_batches(held).combine_chunks())

    return df.repartition(*group_by).sortWithinPartitions(*group_by, *order).mapInArrow(run, schema)


def _lines(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs in order of line and start, and the furthest end up to each; a line is ``span`` wide."""
    start, end = line * span + x0, line * span + x1
    order = np.argsort(start)
    return start[order], np.maximum.accumulate(end[order])


def _ellipses(radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All kernel rows of elliptic elements of any radius each: the element, its line and half width."""
    each = 2 * radius + 1
    of = np.repeat(np.arange(len(radius)), each)
    r = radius[of]
    dy = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) - r
    return of, dy, np.rint(r * np.sqrt((r * r - dy * dy) / np.maximum(r * r, 1))).astype(np.int64)


def _band_steps(steps: Sequence[np.ndarray | str | None]):
    """Morphology of whole bands: an array of kernel rows ``(dy, left, right)`` widens, None takes the complement; a name
    stands for the elliptic element of each row's ``radius``.

    A group's row without ``x1`` is its picture (``y`` the height, ``x0`` the width); groups without one are dropped.
    """
    reach = [0 if k is None or isinstance(k, str) else int(np.abs(k[:, 0]).max()) for k in steps]
    sized = [isinstance(k, str) for k in steps]

    def run(group: np.ndarray, band: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, frame: np.ndarray, radius: np.ndarray):
        n = int(group[-1]) + 1
        high, wide, low, size = (np.zeros(n, np.int64) for _ in range(4))
        size[group] = radius
        np.maximum.at(high, group[frame], y[frame])
        np.maximum.at(wide, group[frame], x0[frame])
        low[group] = band * MORPH_ROWS
        group, y, x0, x1 = (v[~frame] for v in (group, y, x0, x1))
        span = int(wide.max()) + 2
        for i, kernel in enumerate(steps):
            rest = sum(reach[i + 1 :]) + sum(sized[i + 1 :]) * size
            top, bottom = np.maximum(low - rest, 0), np.minimum(low + MORPH_ROWS + rest, high)
            last = i == len(steps) - 1
            if kernel is not None:
                if isinstance(kernel, str):
                    of, dy, half = _ellipses(size[group])
                    group, y, x0, x1 = group[of], y[of] + dy, x0[of] - half, x1[of] + half
                else:
                    group = np.repeat(group, len(kernel))
                    y = (y[:, None] + kernel[:, 0]).reshape(-1)
                    x0, x1 = (x0[:, None] - kernel[:, 1]).reshape(-1), (x1[:, None] + kernel[:, 2]).reshape(-1)
                if not last:
                    continue  # the complement that follows sorts and cuts them
            # lines still needed, cut to the picture
            x0, x1 = np.maximum(x0, 0), np.minimum(x1, wide[group])
            on = (y >= top[group]) & (y < bottom[group]) & (x1 > x0)
            group, y, x0, x1 = (v[on] for v in (group, y, x0, x1))
            count = np.maximum(bottom - top, 0)
            base = np.cumsum(count) - count
            line = base[group] + y - top[group]
            if kernel is None:  # the right edge of every line ends its last gap
                owner = np.repeat(np.arange(n), count)
                edge = wide[owner]
                start, end = _lines(np.r_[line, np.arange(len(owner))], np.r_[x0, edge], np.r_[x1, edge], span)
                seen = np.maximum(np.r_[-1, end[:-1]], start // span * span)
                gap = start > seen
                start, end = seen[gap], start[gap]
            else:
                start, end = _lines(line, x0, x1, span)
                opens = np.flatnonzero(start > np.r_[-1, end[:-1]])
                start, end = start[opens], end[np.r_[opens[1:] - 1, len(end) - 1]] if len(opens) else end
            line = start // span
            group = np.searchsorted(base, line, "right") - 1
            y, x0, x1 = line - base[group] + top[group], start - line * span, end - line * span
        return group, y, x0, x1

    return run


def _morph(runs: DataFrame, steps: Sequence[Sequence[tuple[int, int, int]] | str | None], frames: DataFrame) -> DataFrame:
    """Widenings by kernels and complements (None), one after another, in one shuffle of the runs.

    The name of a key column stands for the elliptic element of the radius it holds; ``frames`` carries the column too.
    """
    keys = keys_of(runs)
    named = [k for k in steps if isinstance(k, str)]
    # an output pixel looks at source = output + offset, so a run spreads to the opposite side
    rows = [k if k is None or isinstance(k, str) else np.array([(-dy, right, left) for dy, left, right in k], np.int64) for k in steps]
    halo = sum(int(np.abs(k[:, 0]).max()) for k in rows if isinstance(k, np.ndarray))
    reach = " + ".join([str(halo), *named])
    first, last = (f"cast(floor((y {sign} ({reach})) / {MORPH_ROWS}) as int)" for sign in "-+")
    spread_over = f"sequence({first}, {last})"
    number = [F.col(c).cast("int").alias(c) for c in SPAN]
    placed = runs.where("x1 > x0").select(*keys, F.explode(F.expr(spread_over)).alias("_band"), *number)
    pictures = _frames_for(runs, frames).where("h > 0").select(
        *keys, F.explode(F.expr(f"sequence(0, cast(floor((h - 1) / {MORPH_ROWS}) as int))")).alias("_band"),
        F.col("h").cast("int").alias("y"), F.col("w").cast("int").alias("x0"), F.lit(None).cast("int").alias("x1"),
    )
    group_by = [*keys, "_band"]
    apply = _band_steps(rows)
    names = [*keys, *SPAN]
    fields = [T.StructField(f.name, f.dataType) for f in runs.select(*keys).schema.fields]
    schema = T.StructType([*fields, *[T.StructField(c, T.IntegerType()) for c in SPAN]])

    def done(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        new = _starts(batch, group_by)
        first = np.r_[0, np.flatnonzero(new)]
        x1 = batch.column("x1")
        frame = x1.is_null().to_numpy()
        values = [batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("_band", *SPAN)]
        values += [frame, batch.column(named[0]).fill_null(0).to_numpy().astype(np.int64) if named else np.zeros(len(x1), np.int64)]
        # groups of large elements go in turn, so that copies stay few
        ends = np.r_[first[1:], len(x1)]
        turn = np.cumsum(2 * values[-1] + 1)[ends - 1] // COPIES
        for one in np.split(np.arange(len(first)), np.flatnonzero(np.diff(turn)) + 1):
            own = slice(first[one[0]], ends[one[-1]])
            group, *out = apply(np.cumsum(new[own]) - new[own.start], *[v[own] for v in values])
            owner = pa.array(first[one[0] + group])
            columns = [batch.column(c).take(owner).combine_chunks() for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v.astype(np.int32)) for v in out]], names)

    return in_groups(placed.unionByName(pictures), group_by, (), done, schema)


def dilate(runs: DataFrame, kernel: Sequence[tuple[int, int, int]] | str, frames: DataFrame, iterations: int = 1) -> DataFrame:
    """Spread every run by the kernel rows and merge, in one shuffle.

    Repeated passes are folded into one larger kernel.  ``kernel`` may be the
    name of a key column of ``runs`` and ``frames`` that holds a radius, so
    each leaf can have its own elliptic element.
    """
    return _morph(runs, [_times(kernel, iterations)], frames)


def erode(runs: DataFrame, kernel: Sequence[tuple[int, int, int]] | str, frames: DataFrame, iterations: int = 1) -> DataFrame:
    """Erosion as the complement of dilating the complement.

    Pixels beyond the picture are ignored, so a mask touching the border is
    not eaten from there.
    """
    return _morph(runs, [None, _times(kernel, iterations), None], frames)


def morph_open(runs, kernel, frames, iterations: int = 1):
    k = _times(kernel, iterations)
    return _morph(runs, [None, k, None, k], frames)


def morph_close(runs, kernel, frames, iterations: int = 1):
    """Dilation, then erosion."""
    k = _times(kernel, iterations)
    return _morph(runs, [k, None, k, None], frames)


def close_then_open(runs, kernel, frames, closes: int = 2, opens: int = 1):
    """Closing followed by opening; the two erosions in the middle are one."""
    grow, core = _times(kernel, closes), compose(kernel, closes + opens)
    return _morph(runs, [grow, None, core, None, _times(kernel, opens)], frames)


def dilate_square(runs, k, frames):
    return dilate(runs, square_kernel(k), frames)


def dilate_ellipse(runs, k, frames, iterations: int = 1):
    return dilate(runs, ellipse_kernel(k), frames, iterations)


def erode_ellipse(runs, k, frames, iterations: int = 1):
    return erode(runs, ellipse_kernel(k), frames, iterations)


def adaptive_radius(area_col: str, divisor: float = 12.0) -> Column:
    """Closing radius ``max(8, round(sqrt(area) / divisor))``; 0 below 50 px."""
    return F.when(F.col(area_col) < 50, F.lit(0)).otherwise(
        F.greatest(F.lit(8), F.rint(F.sqrt(F.col(area_col)) / divisor).cast("int"))
    )


def close_adaptive(runs: DataFrame, frames: DataFrame, divisor: float = 12.0) -> DataFrame:
    """Closing whose radius follows each leaf's own area."""
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    sizes = area(runs, "_a").select(*keys, adaptive_radius("_a", divisor).alias("_r"))
    sized = runs.join(sizes, keys)
    big = sized.where("_r > 0")
    # _r travels as a key of runs and frames, so no step looks its leaves up in the runs again
    sized_frames = frames.join(sizes.where("_r > 0"), fkeys).select(*keys, "_r", "h", "w")
    closed = morph_close(big, "_r", sized_frames).drop("_r")
    return closed.unionByName(sized.where("_r = 0").drop("_r"))


# --------------------------------------------------------------------------
# boxes, bands and merging rules
# --------------------------------------------------------------------------


def box_region(boxes: DataFrame, margin: float = 0.25) -> DataFrame:
    """Boxes ``(keys, bx0, by0, bx1, by1, h, w)`` grown by a share of their
    longer side and cut to the picture, with the box itself as columns."""
    pad = F.floor(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) * margin).cast("int")
    return boxes.select(
        *[c for c in boxes.columns if c not in ("bx0", "by0", "bx1", "by1", "h", "w")],
        F.greatest(F.lit(0), F.col("bx0") - pad).alias("ex0"),
        F.greatest(F.lit(0), F.col("by0") - pad).alias("ey0"),
        F.least(F.col("w"), F.col("bx1") + pad).alias("ex1"),
        F.least(F.col("h"), F.col("by1") + pad).alias("ey1"),
    )


def box_runs(region: DataFrame) -> DataFrame:
    """Grown boxes as a mask."""
    keys = [c for c in region.columns if c not in ("ex0", "ey0", "ex1", "ey1")]
    return region.where("ey1 > ey0 and ex1 > ex0").select(
        *keys,
        F.explode(F.expr("sequence(cast(ey0 as int), cast(ey1 as int) - 1)")).alias("y"),
        F.col("ex0").cast("int").alias("x0"),
        F.col("ex1").cast("int").alias("x1"),
    )


def remove_box(runs: DataFrame, boxes: DataFrame, expand: int = 5) -> DataFrame:
    """Mask minus a bounding box widened by ``expand`` pixels."""
    keys = keys_of(runs)
    grown = boxes.select(
        *keys,
        (F.col("bx0") - expand).alias("ex0"),
        (F.col("by0") - expand).alias("ey0"),
        (F.col("bx1") + expand).alias("ex1"),
        (F.col("by1") + expand).alias("ey1"),
    )
    return mask_diff(runs, box_runs(grown))


def refine_boundary(coarse: DataFrame, fine: DataFrame, frames: DataFrame, band: int = 20) -> DataFrame:
    """Keep the interior of ``coarse``; in its border band follow ``fine``."""
    interior = erode(coarse, square_kernel(band), frames)
    return combine({"_i": interior, "_c": coarse, "_f": fine}, "_i or (_c and _f)")


def merge_masks(primary: DataFrame, secondary: DataFrame, mode: str, frames: DataFrame, dilate_k: int = 15) -> DataFrame:
    """Combine two segmentations of the same leaf.

    ``mobilesam_primary`` keeps the second mask and takes its border from the
    first, ``intersection`` and ``union`` are what they say, every other
    name keeps the first mask near the second.
    """
    if mode == "mobilesam_primary":
        return refine_boundary(secondary, primary, frames)
    if mode == "intersection":
        return mask_and(primary, secondary)
    if mode == "union":
        return mask_or(primary, secondary)
    return mask_and(primary, dilate_square(secondary, dilate_k, frames))


def clip_to_segmentation(mask: DataFrame, seg: DataFrame, frames: DataFrame, px: int = 7) -> DataFrame:
    """Mask limited to the dilated segmentation; leaves without one pass."""
    k = max(3, int(px))
    k += 1 - k % 2
    keys = keys_of(mask)
    known = seg.select(*keys).distinct()
    clipped = mask_and(mask.join(known, keys, "left_semi"), dilate_ellipse(seg, k, frames))
    return clipped.unionByName(mask.join(known, keys, "left_anti").select(*clipped.columns))


def row_profile(runs: DataFrame) -> DataFrame:
    """Width of each scan line."""
    keys = keys_of(runs)
    return runs.groupBy(*keys, "y").agg(
        F.sum(F.col("x1") - F.col("x0")).cast("long").alias("width"),
        F.min("x0").alias("left"),
        F.max("x1").alias("right"),
    )


def shape_sums(runs: DataFrame) -> DataFrame:
    """Area, box, sums of x and y and the widest row, all by closed form."""
    keys = keys_of(runs)
    n = (F.col("x1") - F.col("x0")).cast("long")
    sum_x = n * (F.col("x0") + F.col("x1") - 1)
    lines = runs.groupBy(*keys, "y").agg(
        F.sum(n).alias("n"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.sum(sum_x).alias("sx2"),
    )
    return lines.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("area"),
        F.min("x0").alias("bx0"),
        F.min("y").alias("by0"),
        F.max("x1").alias("bx1"),
        (F.max("y") + 1).alias("by1"),
        F.sum("sx2").cast("long").alias("sum_2x"),
        F.sum(F.col("n") * F.col("y")).cast("long").alias("sum_y"),
        F.max("n").cast("long").alias("max_width"),
    )

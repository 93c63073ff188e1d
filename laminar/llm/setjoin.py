"""Jaccard join of sidecar texts over word shingles by set-relation skipping.

Index level: an inverted list is cut into blocks by set size, and inside a block pairs whose positions leave too little
overlap are skipped.  Answer level: the members of a block are compared with one leader; the overlap of two members is
then derived from what both share with it and from the few shingles they have beyond it, so most pairs are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .graph import smallest_reachable
from .store import stored
from .text import BLANK_TABLE, Words, shingle_sets, slices

#: Share of the hash range whose shingles are counted over the whole collection.  A set with so many unique shingles
#: among them that they fill its prefix can match nothing and is done.  Any share gives the same links.
COUNTED = 0.25
_CUT = np.uint64(int(COUNTED * 2**64))
ROUNDS = 2  # times a cell takes its most central member as leader before what is left is compared pair by pair
TILE = 2048  # sets of one group that meet as many others in one piece of work when links are counted
TILE_SHINGLES = 1 << 21  # and the shingles they hold, unless one set alone has more


def prefix_length(n, percent: int):
    """Shingles of which one must be shared with any set that overlaps by ``percent``."""
    return n - (percent * n + 99) // 100 + 1


def _listed(sets: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def _setter(words: int, percent: int):
    """Size and fingerprint of each set; its shingles in the counted range, and as many more as its prefix needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text"):
            sets = shingle_sets(Words(batch.column("meta_text"), BLANK_TABLE), words)
            inside = [int(np.searchsorted(s, _CUT)) for s in sets]
            low = [s[: max(k, prefix_length(len(s), percent))] if len(s) else s for s, k in zip(sets, inside)]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("image_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(inside, pa.int64()), pa.array(prints, pa.binary()), _listed(low)],
                ["row", "image_id", "n_shingles", "inside", "cls", "low"],
            )

    return run


def _shingler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text"):
            held = [x.tobytes() for x in shingle_sets(Words(batch.column("meta_text"), BLANK_TABLE), words)]
            prints = [xxhash.xxh3_128_digest(x) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(held, pa.binary())], ["cls", "shingles"])

    return run


def _overlaps(with_extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, extra = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                common.append(int(both.sum()))
                extra.append(y[~both])
            out = [batch.column("a"), batch.column("b"), pa.array(common, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*out, _listed(extra)] if with_extra else out, ["a", "b", "common", "extra"] if with_extra else ["a", "b", "common"]
            )

    return run


def _compare(pairs: DataFrame, sets: DataFrame, with_extra: bool = False, fan: int = 256) -> DataFrame:
    """``(a, b, common)`` of pairs of class numbers, with ``extra`` the shingles of b that a lacks.

    The set of a travels once per ``fan`` of its pairs.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("parts"))
    dealt = pairs.join(load, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"))
    left = sets.select(F.col("num").alias("a"), F.col("shingles").alias("set_a")).join(load, "a")
    left = left.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "set_a")
    right = sets.select(F.col("num").alias("b"), F.col("shingles").alias("set_b"))
    both = dealt.hint("merge").join(right, "b").join(left.hint("merge"), ["a", "part"]).select("a", "b", "set_a", "set_b")
    kind = "a long, b long, common long" + ", extra array<long>" * with_extra
    return both.mapInArrow(_overlaps(with_extra), kind)


def _common(sets: list[np.ndarray], left: slice, right: slice, cells: int = 1 << 22) -> np.ndarray:
    """Overlaps of the sets in ``left`` (rows) with those in ``right``, a band of shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    number = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], number[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total, wide = int(shared.sum()), max(1, cells // len(sets))
    out = np.zeros((len(sets[left]), len(sets[right])), np.int64)
    for start in range(0, total, wide):
        a, b = np.searchsorted(code, [start, start + wide])
        grid = np.zeros((len(sets), min(wide, total - start)), np.float32)
        grid[owner[a:b], code[a:b] - start] = 1
        out += (grid[left] @ grid[right].T).astype(np.int64)
    return out


def _tile_links(percent: int):
    """Links of each set with the sets it meets in its tile; rows of a tile follow each other."""
    keys = ["grp", "low", "high", "i", "j"]

    def counted(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        right = rows.column("right").to_numpy()
        order = np.argsort(right, kind="stable")
        num = rows.column("num").to_numpy()[order]
        held = rows.column("shingles")
        sets = [np.frombuffer(held[int(k)].as_buffer(), np.uint64) for k in order]
        n = np.array([len(x) for x in sets], np.int64)
        own = not right.any()  # a tile that meets itself
        cut = len(sets) if own else int((~right).sum())
        a, b = slice(0, cut), slice(0 if own else cut, len(sets))
        common = _common(sets, a, b)
        near = (100 + percent) * common >= percent * (n[a, None] + n[None, b])
        if own:
            np.fill_diagonal(near, False)
            return num, near.sum(axis=1)
        return num, np.r_[near.sum(axis=1), near.sum(axis=0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if parts and last != tuple(key[a]):
                    out.append(counted(parts))
                    parts = []
                parts.append(batch.slice(a, b - a))
                last = tuple(key[a])
            if out:
                yield _counts(out)
        if parts:
            yield _counts([counted(parts)])

    return run


def _counts(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    num, links = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(num), pa.array(links)], ["num", "links"])


def _link_counts(links: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(num, n_links)``: the sets each set is linked with, all pairs of its group counted.

    Linked sets are in one group.  Where the links found are all its pairs, nothing is left to count.  Elsewhere the
    group is dealt into tiles of bounded size by its sets' sizes, and tiles whose sizes leave room for a link meet.
    """
    ends = links.union(links.select("b", "a")).groupBy(F.col("a").alias("num")).agg(F.count("*").alias("met"))
    placed = stored(groups.select(F.col("node").alias("num"), F.col("root").alias("grp")).join(ends, "num"), "placed")
    whole = placed.groupBy("grp").agg((F.sum("met") == F.count("*") * (F.count("*") - 1)).alias("whole"))
    placed = placed.join(whole, "grp")
    step = max(float(np.log(100 / percent)), 1e-3) * (1 + 1e-9)
    size = F.octet_length("shingles") / 8
    part = placed.where("not whole").select("num", "grp").join(sets, "num").withColumn("scale", F.floor(F.log(size) / step))
    part = stored(part, "members")
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(TILE)), F.lit(float(TILE_SHINGLES)) / F.exp((F.col("scale") + 1) * step)))
    dealt = part.groupBy("grp", "scale").agg(F.ceil(F.count("*") / F.first(room)).cast("int").alias("parts"))
    # a scale meets itself, the one below and the one above
    near = [dealt.select("grp", (F.col("scale") + d).alias("scale"), F.col("parts").alias(c)) for d, c in ((1, "below"), (-1, "above"))]
    dealt = dealt.join(near[0], ["grp", "scale"], "left").join(near[1], ["grp", "scale"], "left")
    tiles = F.expr(
        """flatten(array(
          transform(sequence(0, parts - 1), p -> named_struct(
            'low', scale, 'high', scale, 'i', least(p, own), 'j', greatest(p, own), 'right', own > p)),
          if(above is null, array(), transform(sequence(0, above - 1), p -> named_struct(
            'low', scale, 'high', scale + 1, 'i', own, 'j', p, 'right', false))),
          if(below is null, array(), transform(sequence(0, below - 1), p -> named_struct(
            'low', scale - 1, 'high', scale, 'i', p, 'j', own, 'right', true)))))"""
    )
    keys = ["grp", "low", "high", "i", "j"]
    own = F.expr("cast(pmod(xxhash64(num), parts) as int)")
    laid = part.join(dealt, ["grp", "scale"]).withColumn("own", own).select("grp", "num", "shingles", F.explode(tiles).alias("t"))
    laid = laid.select("grp", *[F.col(f"t.{c}").alias(c) for c in (*keys[1:], "right")], "num", "shingles")
    met = laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tile_links(percent), "num long, links long")
    counted = met.groupBy("num").agg(F.sum("links").alias("n_links"))
    return placed.where("whole").select("num", F.col("met").alias("n_links")).union(counted)


def _index(reps: DataFrame, percent: int) -> DataFrame:
    """Prefix postings ``(shingle, num, n, pos)`` of the sets that can still match.

    Shingles are ordered by whether they lie in the counted range, then by the number of sets that hold them, then by
    value; ``pos`` is the place in that order.
    """
    low = reps.select("num", "n", "inside", F.posexplode("low").alias("at", "shingle"))
    shared = low.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    held = low.join(shared, "shingle")
    least = F.expr(f"n - ((n * {percent} + 99) div 100) + 1")  # prefix_length
    counted = F.col("at") < F.col("inside")
    spot = F.struct((~counted).alias("outside"), F.when(counted, F.col("df")).alias("df"), F.col("at"), F.col("shingle"))
    per = held.groupBy("num", "n", "inside").agg(
        F.count(F.when(counted, 1)).alias("known"), F.array_sort(F.collect_list(spot)).alias("spots")
    )
    # unique counted shingles come first; a prefix made of them alone matches nothing
    able = per.withColumn("alone", F.col("inside") - F.col("known")).where(F.col("alone") < least)
    listed = able.select("num", "n", "inside", "alone", least.alias("least"), F.posexplode("spots").alias("ahead", "s"))
    placed = listed.select(
        F.col("s.shingle").alias("shingle"), "num", "n", "least",
        F.when(F.col("s.outside"), F.col("s.at").cast("long")).otherwise(F.col("alone") + F.col("ahead")).alias("pos"),
    )
    return placed.where("pos < least").select("shingle", "num", "n", "pos")


def _needed(percent: int, n_a: str = "n_a", n_b: str = "n_b") -> str:
    """Least overlap of two linked sets, as a condition on ``{100 + percent} * overlap``."""
    return f"{percent} * ({n_a} + {n_b})"


def _fits(percent: int) -> str:
    """Sizes leave room for a link, and so do the places of a shingle that is the first the two sets share."""
    room = "least(n_a - pos_a, n_b - pos_b)"
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * {room} >= {_needed(percent)}"


def similar_sidecars(sidecars: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Join sidecar texts (``image_id, meta_text``) whose shingle sets overlap by ``percent`` (Jaccard), exactly.

    Words are lower-cased (A-Z) runs between white space.  A text's set holds its distinct ``words``-word shingles (as
    64-bit hashes); a shorter text is one shingle; a null text or one without words has none and links with nothing.

    Equal sets collapse into a class.  Classes meet in the inverted lists of prefix shingles, rarest first; lists are
    cut into blocks by size, so that only sizes within the threshold meet, and skip by position.  The members of a
    block are compared with its leader; a leader and all it met form a cell.  While members of a cell are in different
    groups, its most central member becomes the leader.  What is then left apart is compared only where the overlaps
    with the leader and the shingles shared beyond it leave room for a link.  No link between different texts is lost;
    copies are not expanded.

    Returns one row per input row: ``image_id, n_shingles, component_id`` (smallest id reachable by links, itself
    included) and ``n_links`` (classes its own is linked with; all pairs of a group are counted, in tiles of bounded
    size).  Rows that share an id are judged by their own texts.  Rows without an id link with nothing and have a null ``component_id``.  Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = sidecars.sparkSession
    ship(spark)
    id_type = sidecars.schema["image_id"].dataType.simpleString()
    texts = sidecars.select("image_id", "meta_text")
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "image_id", "meta_text")
    signed = stored(
        numbered.mapInArrow(
            _setter(words, percent),
            f"row long, image_id {id_type}, n_shingles long, inside long, cls binary, low array<long>",
        ),
        "sets",
    )
    known = signed.where("image_id is not null and cls is not null")
    classes = stored(known.groupBy("cls").agg(F.min("row").alias("num"), F.min("image_id").alias("image_id")), "classes")
    reps = known.join(classes.select(F.col("num").alias("row")).hint("merge"), "row", "left_semi").select(
        F.col("row").alias("num"), F.col("n_shingles").alias("n"), "inside", "low"
    )
    # sizes within the threshold lie in one class of the scale or in two neighbours, which meet in the upper one's block
    step_of_scale = max(float(np.log(100 / percent)), 1e-3) * (1 + 1e-9)
    scale = F.floor(F.log(F.col("n").cast("double")) / step_of_scale)
    postings = stored(_index(reps, percent), "postings")
    blocks = postings.withColumn("block", F.explode(F.array(scale, scale + 1)))
    first = F.min(F.struct(F.xxhash64("num").alias("rank"), F.col("num"), F.col("n"), F.col("pos")))
    led = blocks.groupBy("shingle", "block").agg(F.count("*").alias("met"), first.alias("_l")).where("met > 1")
    leaders = led.select("shingle", "block", *[F.col(f"_l.{c}").alias(f"{c}_a") for c in ("num", "n", "pos")])
    member = blocks.select("shingle", "block", *[F.col(c).alias(f"{c}_b") for c in ("num", "n", "pos")])
    # a cell: a leader and the members of all the blocks it leads
    cells = stored(
        member.join(leaders, ["shingle", "block"]).where("num_a <> num_b")
        .groupBy(F.col("num_a").alias("a"), F.col("num_b").alias("b"))
        .agg(F.max(F.expr(_fits(percent))).alias("fits"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")),
        "cells",
    )
    wanted = classes.join(cells.select(F.explode(F.array("a", "b")).alias("num")).distinct(), "num", "left_semi")
    sets = stored(
        texts.join(wanted.select("image_id").distinct(), "image_id", "left_semi")
        .mapInArrow(_shingler(words), "cls binary, shingles binary")
        .join(wanted.select("cls", "num"), "cls")
        .dropDuplicates(["cls"])
        .select("num", "shingles"),
        "shingles",
    )
    linked = f"{100 + percent} * common >= {_needed(percent)}"
    compared = stored(_compare(cells.where("fits").select("a", "b"), sets), "compared")
    cells = stored(cells.join(compared, ["a", "b"], "left").drop("fits"), "cells")
    links = cells.where(linked).select("a", "b")
    groups = smallest_reachable(links)
    cells = cells.select(
        F.col("a").alias("lead"), F.col("a").alias("now"), F.col("n_a").alias("n_now"), F.col("b").alias("num"), F.col("n_b").alias("n"), "common"
    )

    def split(cells: DataFrame) -> DataFrame:
        """Members with their groups, of the cells that hold several."""
        grouped = cells.drop("grp").join(groups, F.col("num") == groups.node, "left")
        grouped = grouped.withColumn("grp", F.coalesce("root", "num")).drop("node", "root")
        several = grouped.groupBy("lead").agg(F.min("grp").alias("_lo"), F.max("grp").alias("_hi")).where("_lo <> _hi")
        return stored(grouped.join(several.select("lead"), "lead", "left_semi"), "cells")

    def answered(cells: DataFrame) -> DataFrame:
        """Overlaps of members with their cell's leader, and their shingles beyond it."""
        pairs = cells.select(F.col("now").alias("a"), F.col("num").alias("b")).distinct()
        return stored(_compare(pairs, sets, with_extra=True), "answers").withColumnsRenamed({"a": "now", "b": "num"})

    cells, answers = split(cells), None
    for _ in range(ROUNDS):
        if cells.isEmpty():
            break
        # the member most like the leader is the more central one: it leads next and leaves the cell with its answers
        like = F.coalesce(F.col("common") / (F.col("n_now") + F.col("n") - F.col("common")), F.lit(-1.0))
        chosen = cells.groupBy("lead").agg(F.max(F.struct(like.alias("like"), F.xxhash64("num").alias("tie"), F.col("num"), F.col("n"))).alias("_l"))
        chosen = stored(chosen.select("lead", F.col("_l.num").alias("now"), F.col("_l.n").alias("n_now")), "leaders")
        cells = stored(cells.drop("now", "n_now", "common").join(chosen, "lead").where("num <> now"), "cells")
        answers = answered(cells)
        cells = stored(cells.join(answers.drop("extra"), ["now", "num"]), "cells")
        new = cells.withColumnsRenamed({"n_now": "n_a", "n": "n_b"}).where(linked).select(F.col("now").alias("a"), F.col("num").alias("b"))
        links = links.union(new.distinct())
        groups = smallest_reachable(links)
        cells = split(cells)

    # What is left: members of one cell in different groups.  The overlap of y and z is what both share with the leader,
    # at most the smaller of their overlaps with it, and what they share beyond it.
    if not cells.isEmpty():
        if answers is None:
            answers = answered(cells)
            cells = cells.drop("common").join(answers.drop("extra"), ["now", "num"])
        near = f"{100 + percent} * (least(common_a, common_b) + least(more_a, more_b)) >= {_needed(percent)}"
        near += f" and grp_a <> grp_b and num_a < num_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

        def met(rows: DataFrame, *on: str) -> DataFrame:
            y, z = (rows.select(*on, *[F.col(c).alias(f"{c}_{k}") for c in ("num", "n", "grp", "common", "more")]) for k in "ab")
            found = y.hint("merge").join(z, list(on)).where(near)
            return found.select(F.col("num_a").alias("a"), F.col("num_b").alias("b"), "n_a", "n_b")

        # enough in common with the leader alone; cells whose such members are all in one group are done
        alone = cells.where(f"100 * common >= {percent} * n").withColumn("more", F.lit(0).cast("long"))
        open_cells = alone.groupBy("lead").agg(F.min("grp").alias("_lo"), F.max("grp").alias("_hi")).where("_lo <> _hi")
        by_leader = met(alone.join(open_cells.select("lead"), "lead", "left_semi"), "lead")
        # or something beyond it that another group of the cell has as well
        beyond = cells.join(answers.select("now", "num", F.explode("extra").alias("shingle")), ["now", "num"])
        shared = beyond.groupBy("lead", "shingle").agg(F.min("grp").alias("_lo"), F.max("grp").alias("_hi")).where("_lo <> _hi")
        beyond = stored(beyond.join(shared.select("lead", "shingle"), ["lead", "shingle"]), "beyond")
        more = beyond.groupBy("lead", "num").agg(F.count("*").alias("more"))
        able = beyond.join(more, ["lead", "num"]).where(f"100 * (common + more) >= {percent} * n")
        pairs = stored(by_leader.union(met(able, "lead", "shingle")).distinct(), "pairs")
        rest = _compare(pairs.select("a", "b"), sets).join(pairs, ["a", "b"]).where(linked).select("a", "b")
        links = stored(links.union(rest), "links")
        groups = smallest_reachable(links)

    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = stored(_link_counts(links, groups, sets, percent), "counts")
    placed = classes.join(groups, classes.num == groups.node, "left").select("cls", "num", "image_id", F.coalesce("root", "num").alias("grp"))
    smallest = placed.groupBy("grp").agg(F.min("image_id").alias("component_id"))
    outcome = placed.join(smallest, "grp").join(ends, "num", "left").select("cls", "component_id", "n_links")
    return signed.join(outcome, "cls", "left").select(
        "image_id", "n_shingles",
        F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id")).alias("component_id"),
        F.when(F.col("image_id").isNotNull(), F.col("n_links")).otherwise(0).alias("n_links"),
    ).fillna(0, ["n_links"])

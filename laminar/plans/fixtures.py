"""Leaf rasters, scenes and name tables derived from the shared test tables.

Every table row becomes one leaf (or name, edit, embedding raster), so the
work of a query grows with its input.  Each builder has a DuckDB twin in
``*_sql`` that yields identical rows from integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

SIDE = 32  # leaf rasters are SIDE x SIDE


def _leaf_body(n: int) -> str:
    """Expressions shared by both engines (integer arithmetic only)."""
    c = n // 2
    u = n // 32  # one unit of detail
    return f"""
  case when (x-{c})*(x-{c})*b*b+(y-{c})*(y-{c})*a*a <= a*a*b*b then 1 else 0 end sil,
  case when (x-({c}-{2*u}+k%5))*(x-({c}-{2*u}+k%5))+(y-({c}-{3*u}+k%7))*(y-({c}-{3*u}+k%7)) <= (1+k%3)*(1+k%3)*{u*u} then 1 else 0 end hole,
  case when (x-({c}+{3*u}-k%3))*(x-({c}+{3*u}-k%3))+(y-({c}+{4*u}))*(y-({c}+{4*u})) <= (k%4)*(k%4)*{u*u} then 1 else 0 end dmg,
  case when x between {c}-{3*u}+k%2 and {c}-{2*u}+k%2 and y between {c}+{2*u}-k%3 and {c}+{3*u}-k%3 then 1 else 0 end frass,
  case when (x-({c}-{7*u}))*(x-({c}-{7*u}))+(y-({c}-{u}*(k%3)))*(y-({c}-{u}*(k%3))) <= (k%6)*{u*u} then 1 else 0 end bite"""


def _leaf_seed(n: int) -> list[str]:
    u = n // 32
    return [
        "p_partkey leaf_id",
        f"cast({6 * u}+p_size%{8 * u} as int) a",
        f"cast({5 * u}+p_size%{4 * u} as int) b",
        "cast(p_partkey%60 as int) k",
    ]


_COLOURS = """
  case when sil=0 or hole=1 or bite=1 then 255 when frass=1 then 30 when dmg=1 then 170 else 40+(x*7+y*3+k)%25 end r,
  case when sil=0 or hole=1 or bite=1 then 255 when frass=1 then 28 when dmg=1 then 180 else 110+(x*5+y+k)%30 end g,
  case when sil=0 or hole=1 or bite=1 then 255 when frass=1 then 26 when dmg=1 then 140 else 35+(x+y*2+k)%20 end b"""

_LAYERS = """
  case when sil=1 and hole=0 and bite=0 then 1 else 0 end tissue,
  case when sil=0 or hole=1 or bite=1 then 0 when frass=1 then 2 when dmg=1 then 1 else 3 end cls"""


def _drawn(spark: SparkSession, sf_dir: str, n: int, *more: str) -> DataFrame:
    """Masks and classes of every leaf's pixels, plus the columns of ``more``.

    The pixels come from a join with the n x n grid, whose size estimate is
    that of both sides; exploded rows would be taken for as small as their
    seeds, and whole rasters be broadcast.
    """
    seed = spread(table(spark, sf_dir, "part").selectExpr(*_leaf_seed(n)), "leaf_id")
    cells = spark.range(n * n).selectExpr(f"cast(id div {n} as int) y", f"cast(id % {n} as int) x")
    grid = seed.crossJoin(F.broadcast(cells))
    shaped = grid.selectExpr("leaf_id", "y", "x", "k", *_split(_leaf_body(n)))
    return shaped.selectExpr("leaf_id", "y", "x", "k", "sil", "hole", "dmg", "frass", "bite", *_split(_LAYERS), *more)


def leaf_px(spark: SparkSession, sf_dir: str, n: int = SIDE) -> DataFrame:
    """One n x n leaf per part: silhouette, hole, open bite, scraped patch, pellet.

    The finished row is unfolded from a one-element array, so its columns
    are plain values for the plan above, as if read from a pixel table;
    otherwise every pushed-down filter would repeat the drawing formulas.
    ``leaf_id`` stays outside, so the pixels remain spread by leaf.
    """
    drawn = _drawn(spark, sf_dir, n, *_split(_COLOURS))
    return drawn.select("leaf_id", F.inline_outer(F.array(F.struct(*[c for c in drawn.columns if c != "leaf_id"]))))


def leaf_masks(spark: SparkSession, sf_dir: str, n: int = SIDE) -> DataFrame:
    """``leaf_px`` without the colours, for queries that never look at them.

    The mask formulas are short, so they are left to the optimiser, which
    draws only the masks in use and tests them before anything is built.
    """
    return _drawn(spark, sf_dir, n)


def _split(sql: str) -> list[str]:
    return [line.strip().rstrip(",") for line in sql.strip().splitlines()]


def leaf_sql(n: int = SIDE) -> str:
    """CTE list defining ``leaf_px``."""
    return f"""leaf as (select {', '.join(_leaf_seed(n))} from part),
g as (select leaf_id, y, x, k, {_leaf_body(n)}
  from leaf, range(0,{n}) q(y), range(0,{n}) w(x)),
leaf_px as (select leaf_id, cast(y as int) y, cast(x as int) x, k, sil, hole, dmg, frass, bite, {_LAYERS}, {_COLOURS} from g)"""


def leaf_frames(spark: SparkSession, sf_dir: str, n: int = SIDE) -> DataFrame:
    """Picture sizes, one row per leaf.

    A part's file is far smaller than its rows, so the size guessed from it
    would send all of them through the driver; the hint keeps them spread.
    """
    return (
        table(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("leaf_id"), F.lit(n).alias("h"), F.lit(n).alias("w"))
        .hint("shuffle_hash")
    )

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from laminar.plans import registry  # noqa: E402
from laminar.session import local_session  # noqa: E402

HEADLINE = (
    "pixels_to_runs", "mask_difference", "closing_twice", "hole_filling", "component_statistics", "iou_of_masks",
    "scale_lookup", "image_rollup", "weighted_image_damage", "leaf_grouped_split", "leaf_damage_results",
)


def duckdb_times(sf_dir: str, names: list[str]) -> dict[str, float]:
    """The same queries by their SQL, as the yardstick."""
    import duckdb

    db = duckdb.connect()
    db.execute(f"set threads to {os.environ.get('BENCH_CPUS', '8')}")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    times = {}
    for name in names:
        start = time.perf_counter()
        db.execute(registry.ORACLE[name]).fetchall()
        times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registry.load()
    cold, warm = {}, {}
    for times in (cold, warm):
        for name in HEADLINE:
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(cold.values()), 3), "unit": "sec",
                      "queries": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "warm": warm, "duckdb": duckdb_times(sf_dir, list(HEADLINE))}))


if __name__ == "__main__":
    main()

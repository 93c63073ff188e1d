"""Credentials in sidecar texts, told apart by how many projects and owners share them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import stored
from .text import slices

# Fixed patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "owned")

SPAN = "struct<kind:string,start:int,end:int,value:string>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """All candidate spans ``(kind, start, end, value)`` by start, then kind; places are code points.

    ``owned`` spans are loose high-entropy tokens that no other kind covers; they count only if their value proves to belong to one owner.
    """
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    covered = sorted((s, e) for _, s, e, _ in found)
    for m in LOOSE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= 3.5:
            if not any(s < m.end() and m.start() < e for s, e in covered):
                found.append(("owned", m.start(), m.end(), value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scanner():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "meta_text"):
            spans = []
            for text in batch.column("meta_text").to_pylist():
                got = find_spans(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b, "value": xxhash.xxh3_128_hexdigest(v)} for k, a, b, v in got])
            rows = pa.array(range((part << 33) + row, (part << 33) + row + len(spans)), pa.int64())
            row += len(spans)
            yield pa.RecordBatch.from_arrays(
                [rows, *(batch.column(c) for c in ("image_id", "project", "owner")), pa.array(spans, pa.list_(_SPAN))],
                ["row", "image_id", "project", "owner", "spans"],
            )

    return run


def scan_credentials(sidecars: DataFrame, copied_owners: int = 2) -> DataFrame:
    """Credentials in sidecar texts (``image_id, meta_text, project, owner``) with the verdict of the whole collection.

    Assignments, access keys and long hexadecimal runs are always reported.  Hashes of all candidate values, loose
    high-entropy tokens among them, are counted by distinct projects and owners: a value held by ``copied_owners`` or
    more owners is an ``example`` that people copy, one of a single owner looks ``live``.  Loose tokens are reported
    only if they look live.

    Returns per row ``image_id`` and ``spans``, by start and kind: ``kind, start, end`` (code points, end exclusive)``,
    n_documents, n_projects, n_owners, verdict``.  Values leave the tasks only as 128-bit hashes.  A null text has no
    spans; a null project or owner counts as one of its own; rows that repeat an id are scanned each and an id counts as
    one document.  A value that a third of all rows hold is pre-aggregated before its shuffle and its verdict joined
    back by a join that Spark can split.  An empty table gives an empty result; further columns are ignored.
    """
    ship(sidecars.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in sidecars.schema.fields}
    columns = ("image_id", "meta_text", "project", "owner")
    found = stored(
        sidecars.select(*columns).mapInArrow(
            _scanner(),
            f"row long, image_id {types['image_id']}, project {types['project']}, owner {types['owner']}, spans array<{SPAN}>",
        ),
        "spans",
    )
    each = found.select("row", "image_id", "project", "owner", F.explode("spans").alias("s")).select(
        "row", "image_id", "project", "owner", "s.*"
    )
    held = each.groupBy("value", "image_id", "project", "owner").agg(F.lit(1).alias("one"))
    projects = held.select("value", "project").distinct().groupBy("value").agg(F.count("*").alias("n_projects"))
    owners = held.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    documents = held.select("value", "image_id").distinct().groupBy("value").agg(F.count("*").alias("n_documents"))
    verdicts = documents.join(projects, "value").join(owners, "value")
    judged = (
        each.join(verdicts, "value")
        .withColumn("verdict", F.when(F.col("n_owners") >= copied_owners, "example").otherwise("live"))
        .where("kind <> 'owned' or verdict = 'live'")
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start", F.expr(f"array_position(array{KINDS}, kind)").alias("place"), "kind", "end",
                        "n_documents", "n_projects", "n_owners", "verdict",
                    )
                )
            ).alias("spans")
        )
    )
    return (
        found.select("row", "image_id")
        .join(judged, "row", "left")
        .select("image_id", F.coalesce("spans", F.from_json(F.lit("[]"), judged.schema["spans"].dataType)).alias("spans"))
    )

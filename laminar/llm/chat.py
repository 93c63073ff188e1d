"""Tool-call linking: edit requests and their outcomes as canonical JSON messages.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Argument types and the variant types that fit them.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
}


def _levels(calls: DataFrame) -> DataFrame:
    """Distance of each call to the first of its chain, by pointer doubling; null on a cycle.

    A call's pointer moves twice as far each round, so rounds grow with the logarithm of the longest chain.
    """
    point = stored(
        calls.select(
            "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")
        ),
        "pointers",
    )
    left, bound = point.where("up is not null").count(), 1
    total = point.count() if left else 0
    while left and bound <= 2 * total:
        above = point.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        waiting = point.where("up is not null").join(above, "up", "left")
        moved = waiting.select("node", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"))
        point = stored(point.where("up is null").unionByName(moved), "pointers")
        left, bound = point.where("up is not null").count(), bound * 2
    return point.select("node", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_edits(edits: DataFrame, operations: DataFrame) -> DataFrame:
    """Link edit requests with their outcomes, order them, check their arguments and write canonical JSON.

    ``edits`` holds the log of editing sessions: ``image_name, seq`` (place in the log)``, kind`` (``request`` or
    ``outcome``; others are plain messages)``, edit_id`` (unique per image and request)``, after_id`` (request that this one
    builds on)``, op, body`` (JSON arguments of a request, else text).  ``operations`` describes arguments: ``op, name, type``
    (string, integer, number, boolean, array or object)``, required`` (boolean).

    Requests and outcomes meet by ``(image_name, edit_id)``; the outcome with the smallest ``seq`` counts.  ``level`` is the
    number of requests that a request builds on, one after the other, so ``(level, seq)`` is a topological order of an
    image's requests; it is null for all other rows and for requests that lead into a cycle.

    Returns a row per input row: ``image_name, seq, kind, edit_id, level, outcome_seq, problems`` (sorted)``, message``
    (JSON with sorted keys and no spaces; a request holds its outcome's text).  Problems of a request are ``bad json``,
    ``cycle``, ``missing <name>``, ``no outcome``, ``repeated id``, ``type <name>``, ``unknown <name>``, ``unknown after_id``
    and ``unknown op``; an outcome can have ``no request`` or ``repeated id``.  Null keys link nothing; a null body is an empty
    object; an unknown ``after_id`` counts as none; a null argument only fits if it is not required.  Of rows that repeat an
    id the smallest ``seq`` counts and the others link nothing.  An empty log gives an empty result; further columns are
    ignored.
    """
    log = edits.select("image_name", "seq", "kind", "edit_id", "after_id", "op", "body")
    log = stored(log.withColumn("row", F.monotonically_increasing_id()), "log")
    known = log.where("image_name is not null and edit_id is not null and kind in ('request', 'outcome')")
    first = known.groupBy("image_name", "edit_id", "kind").agg(F.min(F.struct("seq", "row")).alias("_f"))
    first = stored(first.select("image_name", "edit_id", "kind", "_f.row", "_f.seq"), "firsts")
    lead = first.where("kind = 'request'").select("image_name", "edit_id", "row")
    reply = (
        log.where("kind = 'outcome'")
        .join(first.select("row", F.col("seq").alias("outcome_seq")), "row")
        .select("image_name", "edit_id", "outcome_seq", F.col("body").alias("outcome"))
    )
    before = lead.select("image_name", F.col("edit_id").alias("after_id"), F.col("row").alias("parent"))
    asks = (
        log.where("kind = 'request'")
        .join(lead.select("row", F.lit(True).alias("leads")), "row", "left")
        .join(before, ["image_name", "after_id"], "left")
        .join(reply, ["image_name", "edit_id"], "left")
        .withColumn("v", F.expr("try_parse_json(coalesce(body, '{}'))"))
    )
    asks = stored(asks.withColumn("is_object", F.expr("coalesce(schema_of_variant(v) like 'OBJECT<%', false)")), "asks")
    levels = _levels(asks.select(F.col("row").alias("node"), "parent")).withColumnRenamed("node", "row")

    # Arguments against their descriptions: a full join of those given and those described.
    parts = edits.sparkSession.tvf.variant_explode(F.col("v").outer())
    given = asks.where("is_object").select("row", "op", "v").lateralJoin(parts)
    given = given.select("row", "op", F.col("key").alias("name"), F.expr("schema_of_variant(value)").alias("found"))
    described = operations.select("op", "name", "type", "required").dropDuplicates(["op", "name"])
    wanted = asks.where("is_object").select("row", "op").join(described, "op")
    fits = " or ".join(f"(type = '{t}' and found rlike '^({p})$')" for t, p in TYPES.items())
    argued = (
        given.join(wanted.drop("op"), ["row", "name"], "full")
        .join(described.select("op").distinct().withColumn("has_op", F.lit(True)), "op", "left")
        .select(
            "row",
            F.when(F.col("type").isNull() & F.col("has_op"), F.concat(F.lit("unknown "), "name"))
            .when(F.col("required") & (F.col("found").isNull() | (F.col("found") == "VOID")), F.concat(F.lit("missing "), "name"))
            .when(F.col("type").isNotNull() & (F.col("found") != "VOID") & ~F.expr(fits), F.concat(F.lit("type "), "name"))
            .alias("problem"),
        )
        .where("problem is not null")
        .groupBy("row")
        .agg(F.collect_set("problem").alias("argued"))
    )
    ops = described.select("op").distinct().withColumn("has_op", F.lit(True))
    checks = {
        "bad json": "not is_object",
        "cycle": "level is null",
        "no outcome": "leads and outcome_seq is null",
        "repeated id": "edit_id is not null and image_name is not null and leads is null",
        "unknown after_id": "after_id is not null and parent is null",
        "unknown op": "has_op is null",
    }
    found = ", ".join(f"case when {c} then '{p}' end" for p, c in checks.items())
    nothing = F.array().cast("array<string>")
    requests = (
        asks.join(levels, "row")
        .join(argued, "row", "left")
        .join(ops, "op", "left")
        .withColumn("argued", F.coalesce("argued", nothing))
        .select(
            "image_name", "seq", "kind", "edit_id", "level",
            F.when(F.col("leads"), F.col("outcome_seq")).alias("outcome_seq"),
            F.expr(f"array_sort(array_compact(concat(array({found}), argued)))").alias("problems"),
            F.to_json(
                F.expr(
                    "named_struct('arguments', v, 'id', edit_id, 'kind', kind, 'op', op, 'outcome', if(leads, outcome, null), 'seq', seq)"
                ),
                {"ignoreNullFields": "false"},
            ).alias("message"),
        )
    )
    others = (
        log.where("kind is null or kind <> 'request'")
        .join(first.select("row", F.lit(True).alias("leads")), "row", "left")
        .join(lead.select("image_name", "edit_id", F.lit(True).alias("asked")), ["image_name", "edit_id"], "left")
        .select(
            "image_name", "seq", "kind", "edit_id", F.lit(None).cast("long").alias("level"),
            F.lit(None).cast(log.schema["seq"].dataType).alias("outcome_seq"),
            F.expr(
                "array_compact(array(case when kind = 'outcome' and asked is null then 'no request' end, "
                "case when kind = 'outcome' and edit_id is not null and image_name is not null and leads is null then 'repeated id' end))"
            ).alias("problems"),
            F.to_json(
                F.expr("named_struct('content', body, 'id', edit_id, 'kind', kind, 'seq', seq)"), {"ignoreNullFields": "false"}
            ).alias("message"),
        )
    )
    return requests.unionByName(others)

"""The numbered queries: thin steps that map the given tables to the operators and their results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def sidecars(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``documents`` as sidecar texts."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.col("text").alias("meta_text"), *extra
    )


#: Text with A-Z in lower case, in SQL.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i+4], ' ')) as h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.y) as component_id, d.doc_id = min(r.y) as kept
from d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""


@query(OP5_SQL)
def op5_minhash_near_dedup(spark, sf_dir):
    from .minhash import near_duplicates

    found = near_duplicates(sidecars(spark, sf_dir)).withColumnRenamed("image_id", "doc_id")
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def held_out_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as held-out leaf descriptions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("leaf_id"), F.col("text").alias("leaf_text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as reviews of sidecar texts."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("image_id"), F.col("quality").alias("usable"), F.col("toxic").alias("offensive")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_best_fit_packing(spark, sf_dir):
    from .packing import pack_sidecars

    return pack_sidecars(sidecars(spark, sf_dir), vocabulary()).withColumnRenamed("image_id", "doc_id")


OP8_SQL = f"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, w, least(10, len(w)) as m from (
  select item_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark) where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i:i+m-1], ' ') as t from (select *, unnest(range(1, len(w) - m + 2)) as i from b)),
dw as (select doc_id, i, m, array_to_string(w[i:i+m-1], ' ') as t
  from (select doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) as i from d, (select distinct m from b))),
h as (select doc_id, i, m, item_id from dw join win using (m, t)),
pos as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + m)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from h) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(pos.n, 0) as n_hit, coalesce(it.n, 0) as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256, coalesce(pos.n, 0) > 0 as contaminated
from d left join pos on pos.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""


@query(OP8_SQL)
def op8_benchmark_decontamination(spark, sf_dir):
    from .decontam import find_passages

    found = find_passages(sidecars(spark, sf_dir), held_out_leaves(spark, sf_dir))
    return found.select(
        F.col("image_id").alias("doc_id"),
        "n_words",
        F.expr("cast(aggregate(spans, 0, (n, s) -> n + s.end - s.first) as bigint)").alias("n_hit"),
        F.size("leaf_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaf_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query()
def op9_token_binary(spark, sf_dir):
    from .shards import read_shards, write_shards

    return read_shards(write_shards(sidecars(spark, sf_dir), vocabulary())).withColumnRenamed("image_id", "doc_id")


OP3_SQL = """
with recursive l as (
  select doc_id, unnest(range(0, len(s))) as no, trim(unnest(s), ' ') as line
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)),
u as (select line, min((doc_id, no)) as ord, string_split(line, ' ') as w from l where line <> '' group by line),
v as (
  select ord, -1 as gap, md5(array_to_string(w, ' ')) as key, len(w) as n from u where len(w) >= 3
  union all
  select ord, g, md5(array_to_string(list_concat(w[1:g], w[g+2:]), ' ')), len(w) - 1
  from (select ord, w, unnest(range(0, len(w))) as g from u where len(w) >= 3)),
b as (select key, n, min(ord) filter (where gap < 0) as fu, min(ord) filter (where gap >= 0) as cu from v group by all having count(*) > 1),
s as (select key, n, gap, min(ord) as su from v group by all),
near as (select distinct v.ord from v join b using (key, n) join s using (key, n, gap)
  where (gap < 0 and cu < v.ord) or (gap >= 0 and (su < v.ord or fu < v.ord))),
k as (select l.doc_id, l.no, l.line, l.line = '' or (u.ord = (l.doc_id, l.no) and near.ord is null) as keep
  from l left join u on l.line = u.line left join near on near.ord = u.ord),
raw as (select doc_id, unnest(range(0, len(s))) as no, unnest(s) as t
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))
select d.doc_id, coalesce(a.n_lines, 0) as n_lines, coalesce(a.n_dropped, 0) as n_dropped, a.text_sha256 from documents d left join (
  select k.doc_id, count(*) filter (where k.line <> '') as n_lines, count(*) filter (where not k.keep) as n_dropped,
    sha256(coalesce(string_agg(raw.t, chr(10) order by raw.no) filter (where k.keep), '')) as text_sha256
  from k join raw on k.doc_id = raw.doc_id and k.no = raw.no group by k.doc_id) a on a.doc_id = d.doc_id
"""


@query(OP3_SQL)
def op3_line_dedup(spark, sf_dir):
    from .lines import drop_duplicate_lines

    left = drop_duplicate_lines(sidecars(spark, sf_dir))
    return left.select(
        F.col("image_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("meta_text", 256).alias("text_sha256")
    )


@query()
def op6_importance_resampling(spark, sf_dir):
    from .importance import resample

    drawn = resample(sidecars(spark, sf_dir), reviews(spark, sf_dir))
    return drawn.where("chosen").select(F.col("image_id").alias("doc_id"), "log_weight", "draw")


@query()
def op7_secret_ownership(spark, sf_dir):
    from .credentials import scan_credentials

    owned = sidecars(
        spark, sf_dir, F.concat_ws("/", "source", "lang").alias("project"), F.col("source").alias("owner")
    )
    found = scan_credentials(owned)
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) as bigint) as n_{0}"
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = joined.format("filter(spans, s -> s.kind <> 'owned')")
    return found.select(
        F.col("image_id").alias("doc_id"),
        *[F.expr(count.format(k)) for k in ("assign", "access", "hex")],
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


@query()
def op10_nearest_vectors(spark, sf_dir):
    from .vptree import nearest_leaves

    leaves = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("leaf_id"), F.col("embedding").alias("curvature")
    )
    near = nearest_leaves(leaves, leaves.where("leaf_id % 20 = 0"))
    return near.withColumnRenamed("leaf_id", "vec_id")


@query()
def op4_context_mixing(spark, sf_dir):
    from .mixing import score_sidecars

    part = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1").alias("held_out")
    return score_sidecars(sidecars(spark, sf_dir, part)).withColumnRenamed("image_id", "doc_id")


OP2_SQL = """
with recursive t as (select conv_id, turn, role, text, len(string_split(text, ' ')) as words,
    exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 2 and p.role = 'user') as chained,
    (select any_value(a.text) from conversations a where a.conv_id = c.conv_id and a.turn = c.turn + 1 and a.role = 'assistant') as outcome,
    exists (select 1 from conversations a where a.conv_id = c.conv_id and a.turn = c.turn + 1 and a.role = 'assistant') as answered,
    exists (select 1 from conversations a where a.conv_id = c.conv_id and a.turn = c.turn - 1 and a.role = 'user') as asked
  from conversations c),
g as (select conv_id, turn, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from t where role = 'user'),
lv as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level from g)
select t.conv_id, t.turn, if(role = 'user', 'request', if(role = 'assistant', 'outcome', 'message')) as kind,
  lv.level, if(role = 'user' and answered, t.turn + 1, null) as outcome_turn,
  case when role = 'user' then concat_ws(',', if(not answered, 'no outcome', null), if(t.turn >= 2 and not chained, 'unknown after_id', null))
    when role = 'assistant' and not asked then 'no request' else '' end as problems,
  sha256(case when role = 'user' then json_object('arguments', json_object('text', text, 'words', words), 'id', 't' || t.turn, 'kind', 'request',
      'op', 'say', 'outcome', outcome, 'seq', t.turn)::varchar
    else json_object('content', text, 'id', if(role = 'assistant', 't' || (t.turn - 1), null), 'kind', if(role = 'assistant', 'outcome', 'message'),
      'seq', t.turn)::varchar end) as message_sha256
from t left join lv on t.conv_id = lv.conv_id and t.turn = lv.turn and t.role = 'user'
"""


@query(OP2_SQL)
def op2_tool_call_linking(spark, sf_dir):
    from .chat import link_edits

    turns = table(spark, sf_dir, "conversations")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    log = turns.select(
        F.col("conv_id").alias("image_name"),
        F.col("turn").alias("seq"),
        F.when(user, "request").when(reply, "outcome").otherwise("message").alias("kind"),
        F.when(user, F.concat(F.lit("t"), "turn")).when(reply, F.concat(F.lit("t"), F.col("turn") - 1)).alias("edit_id"),
        F.when(user & (F.col("turn") >= 2), F.concat(F.lit("t"), F.col("turn") - 2)).alias("after_id"),
        F.when(user, "say").alias("op"),
        F.when(user, F.to_json(F.expr("named_struct('text', text, 'words', size(split(text, ' ')))"))).otherwise(F.col("text")).alias("body"),
    )
    operations = spark.sql(
        "select * from values ('say', 'text', 'string', true), ('say', 'words', 'integer', true) as t(op, name, type, required)"
    )
    linked = link_edits(log, operations)
    return linked.select(
        F.col("image_name").alias("conv_id"), F.col("seq").alias("turn"), "kind", "level",
        F.col("outcome_seq").alias("outcome_turn"), F.array_join("problems", ",").alias("problems"),
        F.sha2("message", 256).alias("message_sha256"),
    )


OP11_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i+4], ' ')) as h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.y) as component_id
from d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""


@query(OP11_SQL)
def op11_ngram_jaccard_join(spark, sf_dir):
    from .setjoin import similar_sidecars

    found = similar_sidecars(sidecars(spark, sf_dir))
    return found.select(F.col("image_id").alias("doc_id"), "n_shingles", "component_id")


def _op12_sql() -> str:
    parts = [
        """kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as p
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        """c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, p as q from kept
  qualify row_number() over (order by sha256('3:' || vec_id)) <= 8)""",
    ]
    for i in range(11):
        parts.append(
            f"""a{i} as materialized (select r, vec_id, p, c, d from (select *, row_number() over (partition by r order by d, c) as k
  from (select r, vec_id, p, c, list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i})) where k = 1)"""
        )
        if i < 10:
            parts.append(
                f"""m{i} as materialized (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as q from (select c, j, sum(v) as s, count(*) as n
  from (select c, unnest(p) as v, generate_subscripts(p, 1) as j from a{i}) group by c, j) group by c)"""
            )
            parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.q, c{i}.q) as q from c{i} left join m{i} on m{i}.c = c{i}.c)")
    return (
        "with " + ",\n".join(parts) + """
select vec_id, a10.c::int as cluster, d as distance, (sum(d) over (partition by a10.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(q, ',')) as centroid_sha256 from a10 join c10 on c10.c = a10.c"""
    )


@query(_op12_sql())
def op12_centroid_clustering(spark, sf_dir):
    from .clusters import cluster_descriptors

    leaves = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("leaf_id"), F.col("embedding").alias("curvature")
    )
    grouped = cluster_descriptors(leaves)
    return grouped.select(
        F.col("leaf_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256).alias("centroid_sha256"),
    )


@query()
def op13_spelling_variants(spark, sf_dir):
    from .spelling import spelling_variants

    return spelling_variants(sidecars(spark, sf_dir), slip=97).select("word", "form", "root", "n", "n_near", "form_n")

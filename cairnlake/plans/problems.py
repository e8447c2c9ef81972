"""Queries of the general data-quality operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import differences, heavy_keys, references
from cairnlake.runtime import table


def _cases(spark: SparkSession, d: str):
    names = ("recipes", "file_recipe_cache", "closure_reports", "objects", "object_deletions", "base_objects")
    return references.orphan_references(*(table(spark, d, n) for n in names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.found(_cases(spark, d)[0])


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(*_cases(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return differences.found(*(table(spark, d, n) for n in ("objects", "objects_mirror", "merkle_summaries")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return differences.report(p2_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.found(table(spark, d, "recipes"), table(spark, d, "objects"))


def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    results = heavy_keys.per_key(table(spark, d, "recipes"), table(spark, d, "objects"))
    return results.select(heavy_keys.table_name(), F.lower(F.hex("key")).alias("hash_hex"), "entries", "bytes", F.col("records").alias("referring"))


_REFS = """
refs as (
  select 'recipes' ref_table, cast(recipe_id as varchar) ref_key, c.hash hash, created_at ts, 1 need
  from (select recipe_id, created_at, unnest(chunks) c from recipes)
  union all
  select 'file_recipe_cache', lower(hex(file_hash)), recipe_hash, updated_at, 2 from file_recipe_cache
  union all
  select 'closure_reports', cast(report_id as varchar), hash, checked_at, 0
  from (select report_id, checked_at, unnest(missing_objects) hash from closure_reports)
),
r as (select distinct * from refs where hash is not null and ts is not null),
ev as (
  select hash, created_at ts, kind, 2 ord from objects
  union all select hash, deleted_at, -1, 1 from object_deletions
),
ev1 as (select hash, ts * 4 + ord t, max(kind) kind from ev where hash is not null and ts is not null group by 1, 2),
j as (
  select r.*, ev1.kind last_kind, b.kind base_kind, lead_put.last_put
  from (select *, ts * 4 + 3 t from r) r
  asof left join ev1 on r.hash = ev1.hash and r.t >= ev1.t
  left join base_objects b on b.hash = r.hash
  left join (select hash, max(created_at) last_put from objects group by 1) lead_put on lead_put.hash = r.hash
),
cases as (
  select *, case when last_kind = -1 then 'deleted' when coalesce(base_kind, 0) > 0 or coalesce(last_kind, 0) > 0 then 'wrong_kind'
    when last_put > ts then 'late' else 'missing' end state
  from j
  where not (coalesce(base_kind, 0) > 0 and (need = 0 or base_kind = need))
    and not (coalesce(last_kind, 0) > 0 and (need = 0 or last_kind = need))
)
"""

_KEYED = """
side_a as (select * from (select *, row_number() over (partition by hash order by created_at, put_seq) rn from objects where hash is not null) where rn = 1),
side_b as (select * from (select *, row_number() over (partition by hash order by created_at, put_seq) rn from objects_mirror where hash is not null) where rn = 1),
pair as (
  select coalesce(a.hash, b.hash) hash, a.hash is null no_a, b.hash is null no_b,
    a.pack_id is distinct from b.pack_id d1, a.kind is distinct from b.kind d2, a.size is distinct from b.size d3,
    a.stored_size is distinct from b.stored_size d4, lower(trim(a.codec)) is distinct from lower(trim(b.codec)) d5,
    a.content is distinct from b.content d6, a.created_at is distinct from b.created_at d7
  from side_a a full join side_b b on a.hash = b.hash
),
sums as (select * from (select *, row_number() over (partition by pack_id, side order by computed_at desc) rn from merkle_summaries) where rn = 1),
spair as (
  select coalesce(a.pack_id, b.pack_id) pack_id, a.pack_id is null no_a, b.pack_id is null no_b,
    a.root is distinct from b.root d1, a.leaf_count is distinct from b.leaf_count d2
  from (select * from sums where side = 'a') a full join (select * from sums where side = 'b') b on a.pack_id = b.pack_id
),
diffs as (
  select 'objects' ds, lower(hex(hash)) row_key, unnest(case when no_b then ['only_a'] when no_a then ['only_b'] else list_filter(
    [case when d1 then 'pack_id' end, case when d2 then 'kind' end, case when d3 then 'size' end, case when d4 then 'stored_size' end,
     case when d5 then 'codec' end, case when d6 then 'content' end, case when d7 then 'created_at' end], lambda x: x is not null) end) field
  from pair
  union all
  select 'summaries', cast(pack_id as varchar), unnest(case when no_b then ['only_a'] when no_a then ['only_b'] else list_filter(
    [case when d1 then 'root' end, case when d2 then 'leaf_count' end], lambda x: x is not null) end)
  from spair
)
"""

_ENTRIES = """
rec as (select recipe_id, any_value(chunks) chunks from recipes group by recipe_id),
ent as (
  select 'recipes' tab, c.hash hash, recipe_id id, coalesce(c.len, 0) w from (select recipe_id, unnest(chunks) c from rec) where c.hash is not null
  union all
  select 'objects', hash, put_seq, coalesce(size, 0) from (select put_seq, any_value(hash) hash, any_value(size) size from objects group by put_seq)
),
per_key as (
  select tab, lower(hex(hash)) hash_hex, count(*) entries, cast(sum(w) as bigint) bytes, count(distinct id) referring from ent where hash is not null group by tab, hash
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_per_key": p4_per_key}

SQL = {
    "p1_found": f"with {_REFS} select distinct ref_table, ref_key, lower(hex(hash)) target_hex from cases",
    "p1_report": f"""with {_REFS} select ref_table, period, state, count(*) cases, count(distinct hash) targets from
        (select distinct ref_table, ref_key, hash, state, strftime(make_timestamp(ts * 1000000), '%Y-%m') period from cases) group by 1, 2, 3""",
    "p2_found": f"with {_KEYED} select ds, row_key, field from diffs",
    "p2_report": f"with {_KEYED} select ds, field, count(*) n from diffs group by 1, 2",
    "p4_found": f"""with {_ENTRIES} select tab, hash_hex from (select *, sum(entries) over (partition by tab) total from per_key) where entries >= 0.015 * total""",
    "p4_per_key": f"with {_ENTRIES} select tab, hash_hex, entries, bytes, referring from per_key",
}

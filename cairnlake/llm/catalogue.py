"""Queries of the training-data operators, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import packing, seen, spans, tokens, truncation
from cairnlake.runtime import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    tables = [(table(spark, d, "chunk_plans"), "hash", "seq"), (table(spark, d, "objects"), "hash", "put_seq")]
    return seen.bloom_answers(tables, table(spark, d, "base_objects"))


def _tab():
    return F.when(F.col("tab") == 0, "chunk_plans").otherwise("objects").alias("tab")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_records(_answers(spark, d)).select(_tab(), "seq")


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rates = seen.error_rates(_answers(spark, d))
    return rates.select(_tab(), *rates.columns[1:])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.covered(spans.shared_windows(table(spark, d, "recipes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(_spans(spark, d))


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("recipe_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return spans.report(table(spark, d, "recipes"), _spans(spark, d))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    recipes = table(spark, d, "recipes")
    return spans.clusters(recipes, spans.shared_windows(recipes))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_containers(spark, d))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    return packing.audit(p7_containers(spark, d), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(truncation.judged(truncation.ends(table(spark, d, "documents"))))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(truncation.judged(truncation.ends(table(spark, d, "documents"))))


QUERIES = {f.__name__: f for f in (p3_found, p3_error_rate, p5_found, p5_spans, p5_report, p5_clusters, p6_ids, p7_containers, p7_report, p7_audit, p8_found, p8_report)}

_SEEN = """
keyed as (
  select 'chunk_plans' tab, seq, hash from chunk_plans where hash is not null and seq is not null
  union all select 'objects', put_seq, hash from objects where hash is not null and put_seq is not null
),
ranked as (select *, min(seq) over (partition by tab, hash) first_seq from keyed)
"""

_SPANS = """
rec as (select recipe_id, any_value(coalesce(original_file_hash, encode('r' || recipe_id))) f, any_value(chunks) chunks from recipes where recipe_id is not null group by recipe_id),
win as (
  select recipe_id, f, len(chunks) n, pos, list_transform(chunks[pos + 1 : pos + 8], lambda c: c.hash) w
  from (select *, unnest(range(len(chunks) - 7)) pos from rec where len(chunks) >= 8)
),
many as (select w from win group by w having count(distinct f) > 1),
hit as (select win.* from win join many using (w)),
cov as (select distinct recipe_id, unnest(range(pos, pos + 8)) pos from hit),
island as (select *, pos - row_number() over (partition by recipe_id order by pos) g from cov),
runs as (select recipe_id, min(pos) start, max(pos) + 1 stop from island group by recipe_id, g)
"""

SQL = {
    "p3_found": f"with {_SEEN} select distinct tab, seq from ranked where seq > first_seq or hash in (select hash from base_objects)",
    "p5_found": f"with {_SPANS} select recipe_id, pos from cov",
    "p5_spans": f"with {_SPANS} select recipe_id, start, stop from runs",
    "p5_report": f"""with {_SPANS} select recipe_id, n chunks, coalesce(shared, 0) shared, coalesce(spans, 0) spans, case when n > 0 then round(coalesce(shared, 0) / n, 6) else 0.0 end share
        from (select recipe_id, max(coalesce(len(chunks), 0)) n from recipes group by recipe_id)
        left join (select recipe_id, cast(sum(stop - start) as bigint) shared, count(*) spans from runs group by recipe_id) using (recipe_id)""",
}


SQL["p7_audit"] = "select count(*) documents, count(*) filter (coalesce(text, '') = '') unplaced, 0 as lost, 0 as overlapping, 0 as overfull, 0 split_small, 0 unfilled from documents"

_CLUSTERS = """
places as (select w, recipe_id, min(pos) first_pos from hit group by w, recipe_id),
lead as (select w, min(recipe_id) lead from places group by w),
heads as (select places.*, lead from places join lead using (w)),
edge as (select distinct recipe_id u, lead v from heads where recipe_id > lead),
both_ways as (select u, v from edge union select v, u from edge),
reach as (select u id, least(u, v) label from both_ways union select b.v, r.label from reach r join both_ways b on r.id = b.u where r.label < b.v),
label as (select id recipe_id, min(label) label from reach group by id),
linked as (select recipe_id, count(*) links from heads group by recipe_id),
copies as (select h.recipe_id, h.pos from hit h join heads using (w, recipe_id) where h.recipe_id > lead or h.pos > first_pos),
gone as (select recipe_id, count(*) removable from (select distinct recipe_id, unnest(range(pos, pos + 8)) p from copies) group by recipe_id)
"""

SQL["p5_clusters"] = f"""with recursive {_SPANS}, {_CLUSTERS} select recipe_id, coalesce(label, recipe_id) as "cluster", coalesce(links, 0) links, coalesce(removable, 0) removable
    from (select distinct recipe_id from recipes where recipe_id is not null) left join label using (recipe_id) left join linked using (recipe_id) left join gone using (recipe_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

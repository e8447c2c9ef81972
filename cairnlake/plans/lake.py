"""Queries of the object store, its graph and its ingest, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.functions import codec as C
from cairnlake.functions import hashing as H
from cairnlake.functions import recipe as R
from cairnlake.functions.chunking import ONE_CHUNK, Splitter, chunk_spans
from cairnlake.functions.crypto import FrameKey
from cairnlake.operators import closure, merkle, pipeline, restore, store, transforms
from cairnlake.runtime import materialize, scratch, spread, table
from cairnlake.sources import sealed
from cairnlake.sources.files import extension, text_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The store that the puts of ``objects`` leave: the first writer of a hash wins."""
    return store.first_writer_wins(table(spark, d, "objects"), F.col("put_seq"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_recipe_cache").select(F.col("recipe_hash").alias("hash")).filter("hash is not null").distinct()


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of live recipes."""
    live = _live(spark, d).withColumnRenamed("hash", "recipe_hash")
    return closure.recipe_entries(table(spark, d, "recipes").join(live, "recipe_hash", "left_semi"))


def _hex(name: str = "hash"):
    return H.to_hex(name).alias(name + "_hex")


_ST = """st as (select * from (select *, row_number() over (partition by hash order by put_seq) rn from objects where hash is not null) where rn = 1)"""
_GRAPH = (
    _ST
    + """,
live as (select distinct recipe_hash hash from file_recipe_cache where recipe_hash is not null),
entry as (
  select recipe_hash, c.hash hash, c.len len from (select recipe_hash, unnest(chunks) c from recipes where recipe_hash in (select hash from live)) where c.hash is not null
),
need as (select hash, 2 need from live union select hash, 1 from entry),
state as (
  select need.hash, need.need, case when st.kind is null then 'ObjectNotFound' when st.kind <> need.need then 'ObjectKindMismatch' end state
  from need left join st on st.hash = need.hash
),
orphan as (select * from st where hash not in (select hash from need))
"""
)


@_query(f"with {_ST} select lower(hex(hash)) hash_hex, kind, size, stored_size, codec, created_at from st")
def store_first_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select(_hex(), "kind", "size", "stored_size", "codec", "created_at")


@_query(
    f"""with {_ST}, new as (select * from (select *, row_number() over (partition by hash order by seq) rn from chunk_plans where hash is not null) where rn = 1)
    select lower(hex(hash)) hash_hex, size, 'stored' origin from st union all
    select lower(hex(hash)), raw_len, 'new' from new where hash not in (select hash from st)"""
)
def store_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = _stored(spark, d).withColumn("created_at", F.lit(0).cast("long"))
    plans = table(spark, d, "chunk_plans").select(
        "hash", F.lit(schema.CHUNK).alias("kind"), F.col("raw_len").alias("size"), F.col("stored_len").alias("stored_size"), "codec", F.col("payload").alias("content"), F.lit(1).cast("long").alias("created_at"), "seq"
    )
    rows = store.insert_ignore(old, plans, F.col("seq"))
    return rows.select(_hex(), "size", F.when(F.col("created_at") == 0, "stored").otherwise("new").alias("origin"))


@_query(
    """select lower(hex(file_hash)) file_hash_hex, lower(hex(recipe_hash)) recipe_hash_hex, updated_at from
    (select *, row_number() over (partition by file_hash order by updated_at desc, recipe_hash desc nulls last) rn from file_recipe_cache where file_hash is not null) where rn = 1"""
)
def store_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "file_recipe_cache").select("file_hash", "recipe_hash", "updated_at")
    kept = store.upsert_cache(spark.createDataFrame([], schema.CACHE), new, ["updated_at", "recipe_hash"])
    return kept.select(_hex("file_hash"), _hex("recipe_hash"), "updated_at")


@_query("select distinct lower(hex(hash)) hash_hex from chunk_plans where hash in (select hash from objects)")
def store_existing_hashes(spark: SparkSession, d: str) -> DataFrame:
    return store.existing(table(spark, d, "objects"), table(spark, d, "chunk_plans")).select(_hex())


@_query(f"with {_ST} select lower(hex(hash)) hash_hex, stored_size from st where kind = 1")
def store_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk_sizes(_stored(spark, d)).select(_hex(), "stored_size")


@_query(
    f"""with {_ST} select lower(hex(r.hash)) hash_hex, st.stored_size from (select distinct hash from chunk_plans where hash is not null) r
    left join st on st.hash = r.hash and st.kind = 1"""
)
def store_chunk_stored_bytes(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk_stored_bytes(_stored(spark, d), table(spark, d, "chunk_plans")).select(_hex(), "stored_size")


@_query(f"with {_ST} select lower(hex(hash)) hash_hex, kind, stored_size from st where hash > unhex('80') order by hash limit 500")
def store_object_page(spark: SparkSession, d: str) -> DataFrame:
    return store.page(_stored(spark, d), b"\x80", 500).select(_hex(), "kind", "stored_size")


@_query("select lower(hex(hash)) hash_hex, kind, size, put_seq from objects where hash = (select min(hash) from objects)")
def store_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "objects")
    least = objects.agg(F.min("hash")).first()[0]
    return store.lookup(objects, bytes(least) if least is not None else b"").select(_hex(), "kind", "size", "put_seq")


@_query(
    """with kept as (select * from (select *, row_number() over (partition by file_hash order by updated_at desc, recipe_hash desc nulls last) rn from file_recipe_cache where file_hash is not null) where rn = 1)
    select lower(hex(r.h)) file_hash_hex, lower(hex(kept.recipe_hash)) recipe_hash_hex from (select distinct original_file_hash h from recipes where original_file_hash is not null) r left join kept on kept.file_hash = r.h"""
)
def store_recipe_for_file(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "file_recipe_cache").select("file_hash", "recipe_hash", "updated_at")
    kept = store.upsert_cache(spark.createDataFrame([], schema.CACHE), new, ["updated_at", "recipe_hash"])
    files = table(spark, d, "recipes").select(F.col("original_file_hash").alias("file_hash"))
    return store.recipes_for_files(kept, files).select(_hex("file_hash"), _hex("recipe_hash"))


@_query(
    """select 'unique_hash' rule, cast(coalesce(sum(n - 1), 0) as bigint) violations from (select count(*) n from objects group by hash)
    union all select 'hash_length', count(*) from objects where hash is null or octet_length(hash) <> 32
    union all select 'kind', count(*) from objects where kind is null or kind not in (1, 2)
    union all select 'codec', count(*) from objects where codec is null or codec not in ('raw', 'zstd', 'brotli')
    union all select 'size', count(*) from objects where size is null or size < 0
    union all select 'stored_size', count(*) from objects where content is not null and stored_size is distinct from octet_length(content)"""
)
def store_audit(spark: SparkSession, d: str) -> DataFrame:
    return store.audit(table(spark, d, "objects"))


@_query(
    f"""with {_ST}, left_ as (select * from st where hash not in (select hash from object_deletions where hash is not null))
    select 'object' what, lower(hex(hash)) hash_hex from left_ union all
    select 'cache', lower(hex(file_hash)) from file_recipe_cache where recipe_hash in (select hash from left_ where kind = 2)"""
)
def store_delete_objects(spark: SparkSession, d: str) -> DataFrame:
    now = store.Store.from_dataframes(_stored(spark, d), table(spark, d, "file_recipe_cache")).delete_objects(table(spark, d, "object_deletions"))
    return now.objects.select(F.lit("object").alias("what"), _hex()).unionAll(now.cache.select(F.lit("cache"), H.to_hex("file_hash")))


@_query(
    f"""with {_ST} select lower(hex(file_hash)) file_hash_hex, lower(hex(recipe_hash)) recipe_hash_hex, updated_at from file_recipe_cache c
    where not exists (select 1 from st where st.hash = c.recipe_hash and st.kind = 2)"""
)
def store_dangling_cache(spark: SparkSession, d: str) -> DataFrame:
    return store.dangling(table(spark, d, "file_recipe_cache"), _stored(spark, d)).select(_hex("file_hash"), _hex("recipe_hash"), "updated_at")


@_query(f"with {_GRAPH} select lower(hex(hash)) hash_hex, need, state from state")
def closure_states(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(_live(spark, d), _entries(spark, d), _stored(spark, d)).select(_hex(), "need", "state")


@_query(f"with {_GRAPH} select distinct lower(hex(hash)) hash_hex from state where state = 'ObjectNotFound'")
def closure_missing(spark: SparkSession, d: str) -> DataFrame:
    return closure.missing(_live(spark, d), _entries(spark, d), _stored(spark, d)).select(_hex())


@_query(f"with {_GRAPH} select lower(hex(hash)) hash_hex, kind, stored_size from orphan")
def closure_orphans(spark: SparkSession, d: str) -> DataFrame:
    return closure.orphans(_live(spark, d), _entries(spark, d), _stored(spark, d)).select(_hex(), "kind", "stored_size")


@_query(
    f"""with {_GRAPH} select (select count(distinct hash) from state where state = 'ObjectNotFound') missing_objects,
    (select count(*) from orphan where kind = 1) orphan_chunks, (select count(*) from orphan where kind = 2) orphan_recipes"""
)
def closure_report(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure_report(_live(spark, d), _entries(spark, d), _stored(spark, d))


@_query(f"with {_GRAPH} select count(*) filter (kind = 1) deleted_chunks, count(*) filter (kind = 2) deleted_recipes, cast(coalesce(sum(stored_size), 0) as bigint) freed_bytes from orphan")
def gc_report(spark: SparkSession, d: str) -> DataFrame:
    return closure.gc_report(_live(spark, d), _entries(spark, d), _stored(spark, d))


@_query(
    f"""with {_GRAPH}, w as (select recipe_hash, hash, min(len) lo, max(len) hi, count(len) known from entry group by 1, 2)
    select lower(hex(recipe_hash)) recipe_hash_hex, lower(hex(w.hash)) hash_hex, case when st.kind is null then 'ObjectNotFound' when st.kind <> 1 then 'ObjectKindMismatch'
      when lo <> size or hi <> size or lo is null then 'RecipeChunkLengthMismatch' end error_class from w left join st on st.hash = w.hash"""
)
def closure_resolve(spark: SparkSession, d: str) -> DataFrame:
    return closure.resolve(_entries(spark, d), _stored(spark, d)).select(_hex("recipe_hash"), _hex(), "error_class")


@_query("select recipe_id, cast(o as integer) ordinal, lower(hex(chunks[o + 1].hash)) hash_hex, chunks[o + 1].len len from (select recipe_id, chunks, unnest(range(len(chunks))) o from recipes)")
def recipe_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recipes").select("recipe_id", F.posexplode("chunks").alias("ordinal", "c"))
    return rows.select("recipe_id", "ordinal", H.to_hex("c.hash").alias("hash_hex"), "c.len")


@_query("select recipe_id, original_file_size, len(chunks) chunks, cast(coalesce(list_sum(list_transform(chunks, lambda c: c.len)), 0) as bigint) stored, stored_stream_size declared from recipes")
def recipe_stream_sizes(spark: SparkSession, d: str) -> DataFrame:
    lens = F.filter(F.transform("chunks", lambda c: c["len"]), lambda n: n.isNotNull())
    total = F.coalesce(F.aggregate(lens, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0))
    return table(spark, d, "recipes").select("recipe_id", "original_file_size", F.when(F.col("chunks").isNotNull(), F.size("chunks").cast("long")).alias("chunks"), total.cast("long").alias("stored"), F.col("stored_stream_size").alias("declared"))


@_query(
    """select recipe_id, cast(o as integer) ordinal, cast(coalesce(sum(chunks[o + 1].len) over (partition by recipe_id order by o rows between unbounded preceding and 1 preceding), 0) as bigint) chunk_offset
    from (select recipe_id, chunks, unnest(range(len(chunks))) o from (select recipe_id, any_value(chunks) chunks from recipes group by recipe_id))"""
)
def recipe_chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recipes").dropDuplicates(["recipe_id"]).select("recipe_id", F.posexplode("chunks").alias("ordinal", "c"))
    along = Window.partitionBy("recipe_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # one recipe's chunks
    return rows.select("recipe_id", "ordinal", F.coalesce(F.sum("c.len").over(along), F.lit(0)).alias("chunk_offset"))


@_query("select recipe_id, octet_length(recipe_hash) hash_bytes, 49 + 36 * len(chunks) recipe_bytes from (select recipe_id, any_value(recipe_hash) recipe_hash, any_value(chunks) chunks from recipes group by recipe_id) where chunks is not null and len(list_filter(chunks, lambda c: octet_length(c.hash) = 32 and c.len is not null)) = len(chunks)")
def recipe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Recipes built from the table's columns and parsed again; only those whose parse equals the input come out."""
    sound = F.forall("chunks", lambda c: (F.octet_length(c["hash"]) == 32) & c["len"].isNotNull())
    rows = table(spark, d, "recipes").dropDuplicates(["recipe_id"]).filter(F.col("chunks").isNotNull() & F.coalesce(sound, F.lit(True)))
    built = rows.select("recipe_id", "recipe_hash", "chunks", "original_file_size", R.build_recipe("original_file_size", "original_file_hash", "chunks", "transform_id", "transform_version").alias("data"))
    parsed = built.withColumn("r", R.parse_recipe("data")).filter("r.error_class is null and r.chunks = chunks and r.original_file_size = original_file_size")
    return parsed.select("recipe_id", F.octet_length("recipe_hash").cast("long").alias("hash_bytes"), F.octet_length("data").cast("long").alias("recipe_bytes"))


@_query(
    """select file_seq, count(*) chunks, cast(sum(stored_len) + 49 + 36 * count(*) as bigint) estimated_bytes from
    (select seq, any_value(file_seq) file_seq, any_value(stored_len) stored_len from chunk_plans group by seq) group by file_seq"""
)
def plan_estimated_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_plans").select("seq", "file_seq", "stored_len").dropDuplicates(["seq"])
    return rows.groupBy("file_seq").agg(F.count(F.lit(1)).alias("chunks"), (F.sum("stored_len") + R.recipe_bytes_len(F.count(F.lit(1)))).alias("estimated_bytes"))


@_query(
    """select file_seq, count(*) new_chunks, cast(sum(stored_len) as bigint) new_bytes from
    (select hash, arg_min(file_seq, seq) file_seq, arg_min(stored_len, seq) stored_len from chunk_plans where hash is not null group by hash) group by file_seq"""
)
def plan_incremental_payload(spark: SparkSession, d: str) -> DataFrame:
    """What each file adds: bytes of the chunks that no earlier record has. A hot hash is reduced before the exchange."""
    first = table(spark, d, "chunk_plans").filter("hash is not null").groupBy("hash").agg(F.min(F.struct("seq", "file_seq", "stored_len")).alias("f"))
    return first.groupBy("f.file_seq").agg(F.count(F.lit(1)).alias("new_chunks"), F.sum("f.stored_len").alias("new_bytes"))


@_query(
    """select pack_id, lower(hex(hash)) hash_hex, 140 + cast(coalesce(sum(stored_size + 16 * ((stored_size + 262143) // 262144)) over (partition by pack_id order by hash rows between unbounded preceding and 1 preceding), 0) as bigint) payload_offset
    from (select pack_id, hash, any_value(stored_size) stored_size from (select *, row_number() over (partition by pack_id, hash order by put_seq) rn from objects where hash is not null) where rn = 1 group by 1, 2)"""
)
def pack_payload_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of encrypted payloads in hash order, with an empty index; a pack holds a bounded number of puts."""
    rows = table(spark, d, "objects").filter("hash is not null").groupBy("pack_id", "hash").agg(F.min(F.struct("put_seq", "stored_size")).alias("f"))
    size = F.col("f.stored_size")
    along = Window.partitionBy("pack_id").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    physical = size + 16 * F.floor((size + schema.FRAME - 1) / schema.FRAME)
    return rows.select("pack_id", _hex(), (F.lit(sealed.HEADER) + F.coalesce(F.sum(physical).over(along), F.lit(0))).alias("payload_offset"))


@_query(
    """select pack_id, count(*) puts, count(*) filter (hash <= before) not_increasing from
    (select pack_id, hash, lag(hash) over (partition by pack_id order by put_seq) before from (select pack_id, put_seq, any_value(hash) hash from objects group by 1, 2)) group by pack_id"""
)
def pack_order_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "objects").select("pack_id", "put_seq", "hash").dropDuplicates(["pack_id", "put_seq"])
    before = F.lag("hash").over(Window.partitionBy("pack_id").orderBy("put_seq"))
    return rows.withColumn("before", before).groupBy("pack_id").agg(F.count(F.lit(1)).alias("puts"), F.count_if(F.col("hash") <= F.col("before")).alias("not_increasing"))


@_query("select lower(hex(hash)) hash_hex, row_number() over (order by hash) - 1 pos from (select distinct hash from objects where hash is not null)")
def merkle_leaf_positions(spark: SparkSession, d: str) -> DataFrame:
    return merkle.leaves(table(spark, d, "objects")).select(_hex(), "pos")


@_query(
    """with recursive n as (select count(distinct hash) c from objects), l as (
      select cast(0 as bigint) "level", (c + 1) // 2 nodes from n where c > 1 union all select "level" + 1, (nodes + 1) // 2 from l where nodes > 1)
    select "level", nodes from l"""
)
def merkle_level_sizes(spark: SparkSession, d: str) -> DataFrame:
    return merkle.build(table(spark, d, "objects")).nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


@_query(
    """with n as (select cast(ceil(log2(count(distinct hash))) as integer) k from objects), h as (select distinct hash from objects)
    select lower(hex(t.hash)) hash_hex, t.hash in (select hash from h) valid, case when t.hash in (select hash from h) then k end siblings from (select distinct hash from chunk_plans where hash is not null) t, n"""
)
def merkle_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of all planned chunks in the index over all objects, verified; those that are not stored have none."""
    index = merkle.build(table(spark, d, "objects"))
    proofs = merkle.verified(merkle.prove(index, table(spark, d, "chunk_plans")), index.root, index.leaf_count)
    return proofs.select(_hex(), "valid", F.when(F.col("siblings").isNotNull(), F.size("siblings")).alias("siblings"))


@_query(
    """with a as (select distinct hash from objects where hash is not null), b as (select distinct hash from objects_mirror where hash is not null)
    select lower(hex(hash)) hash_hex, 'unindexed' state from a where hash not in (select hash from b) union all select lower(hex(hash)), 'dangling' from b where hash not in (select hash from a)"""
)
def merkle_staleness(spark: SparkSession, d: str) -> DataFrame:
    """An index over the mirror against the objects."""
    return merkle.staleness(merkle.leaves(table(spark, d, "objects_mirror")), table(spark, d, "objects").filter("hash is not null")).select(_hex(), "state")


@_query(
    """select octet_length(hash) bytes, case when octet_length(hash) <> 32 then 'InvalidHashLength' end error_class, count(*) n from chunk_plans where hash is not null group by 1, 2"""
)
def hex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_plans").filter("hash is not null").select("hash", H.parse_hex(F.upper(F.hex("hash"))).alias("p"))
    same = rows.filter("p.hash is null or p.hash = hash")
    return same.groupBy(F.octet_length("hash").cast("long").alias("bytes"), F.col("p.error_class").alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@_query("select kind, coalesce(codec, 'none') codec, case codec when 'raw' then 0 when 'zstd' then 1 when 'brotli' then 2 end codec_id, cast(sum((stored_size + 262143) // 262144) as bigint) frames from objects group by 1, 2, 3")
def object_frames(spark: SparkSession, d: str) -> DataFrame:
    ids = F.when(F.col("codec") == schema.RAW, 0).when(F.col("codec") == schema.ZSTD, 1).when(F.col("codec") == schema.BROTLI, 2)
    frames = F.floor((F.col("stored_size") + schema.FRAME - 1) / schema.FRAME)
    return table(spark, d, "objects").groupBy("kind", F.coalesce("codec", F.lit("none")).alias("codec"), ids.alias("codec_id")).agg(F.sum(frames).alias("frames"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return text_files(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _plans(spark: SparkSession, d: str, splitter: Splitter, policy: str = pipeline.AUTO) -> DataFrame:
    return materialize(pipeline.plan_files(_files(spark, d), pipeline.Config(splitter, policy)), "plans")


SMALL = Splitter(256, 1024, 4096)


def _closures(plans: DataFrame) -> DataFrame:
    """The objects of each plan under its recipe, each hash once."""
    chunks = plans.select(F.col("recipe_hash").alias("root_recipe"), F.explode("chunks").alias("c"))
    rows = chunks.select("root_recipe", "c.hash", F.lit(schema.CHUNK).alias("kind"), F.col("c.raw_len").alias("size"), "c.codec", F.col("c.payload").alias("content"))
    size = F.octet_length("recipe").cast("long")
    roots = plans.select(F.col("recipe_hash").alias("root_recipe"), F.col("recipe_hash").alias("hash"), F.lit(schema.RECIPE).alias("kind"), size.alias("size"), F.lit(schema.RAW).alias("codec"), F.col("recipe").alias("content"))
    return rows.unionAll(roots).dropDuplicates(["root_recipe", "hash"])


@_query("select doc_id, octet_length(encode(text)) bytes, md5(text) joined, 0 outside from documents where text <> ''")
def ingest_chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every text put together again in order, and how many of them but the last lie outside the bounds."""
    plans = _plans(spark, d, SMALL, schema.RAW).filter(F.size("chunks") > 0)
    along = Window.partitionBy("file_id").orderBy("ordinal")  # one file's chunks
    spans = chunk_spans(_files(spark, d), SMALL).withColumn("last", F.lead("ordinal").over(along).isNull())
    inside = F.col("length").between(F.when(F.col("last"), 1).otherwise(SMALL.min_size), SMALL.max_size)
    outside = spans.groupBy("file_id").agg(F.count_if(~inside).alias("outside"))
    joined = F.aggregate("chunks", F.lit(b""), lambda all_, c: F.concat(all_, c["payload"]))
    rows = plans.select("file_id", joined.alias("joined")).join(outside, "file_id")
    return rows.select(F.col("file_id").alias("doc_id"), F.octet_length("joined").cast("long").alias("bytes"), F.md5("joined").alias("joined"), "outside")


_ENTROPY = "list_aggregate(regexp_extract_all(hex(encode(text)[1:65536]), '..'), 'entropy')"


@_query(f"select doc_id, round({_ENTROPY}, 6) + 0.0 entropy, case when {_ENTROPY} >= 7.7 then 'raw' when {_ENTROPY} >= 6.9 then 'zstd' else 'brotli' end codec from documents where text <> ''")
def ingest_entropy_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).filter("octet_length(bytes) > 0").select("file_id", C.entropy("bytes").alias("e"))
    return rows.select(F.col("file_id").alias("doc_id"), F.round("e", 6).alias("entropy"), C.codec_of(F.col("e")).alias("codec"))


def _dedup_summary(plans: DataFrame) -> DataFrame:
    """Chunks and recipes stored against files read."""
    kept = store.first_writer_wins(pipeline.plan_objects(plans), F.col("input_ordinal"), store.META_FIELDS)
    files = plans.select(F.lit(0).alias("kind"), F.col("original_size").alias("n"))
    rows = files.unionAll(kept.select("kind", "stored_size"))
    of = lambda kind: F.col("kind") == kind
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("n"))), F.lit(0))
    return rows.agg(
        F.count_if(of(0)).alias("files"), total(0).alias("bytes"), F.count_if(of(schema.RECIPE)).alias("recipes"), F.count_if(of(schema.CHUNK)).alias("chunks"), total(schema.CHUNK).alias("stored_bytes")
    )


@_query(
    """select count(*) files, count(distinct text) recipes, count(distinct text) filter (text <> '') chunks, cast(sum(octet_length(encode(text))) as bigint) bytes,
    (select cast(sum(octet_length(encode(t))) as bigint) from (select distinct text t from documents)) stored_bytes from documents where text is not null"""
)
def ingest_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    """One raw chunk a file: chunks and recipes stored against files read."""
    return _dedup_summary(_plans(spark, d, ONE_CHUNK, schema.RAW))


@_query()
def ingest_chunked_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    """The same with content-defined chunks, which texts share in part, and compression; cut points have no SQL."""
    return _dedup_summary(_plans(spark, d, SMALL))


def _estimated_bytes(plans: DataFrame) -> DataFrame:
    return plans.select(F.col("file_id").alias("doc_id"), "estimated_bytes", "stored_stream_size")


@_query("select doc_id, octet_length(encode(text)) + 49 + 36 * (text <> '')::int estimated_bytes, octet_length(encode(text)) stored_stream_size from documents where text is not null")
def ingest_estimated_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _estimated_bytes(_plans(spark, d, ONE_CHUNK, schema.RAW))


@_query()
def ingest_chunked_estimated_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The same with content-defined chunks and compression; sizes of compressed chunks have no SQL."""
    return _estimated_bytes(_plans(spark, d, SMALL))


def _restored(plans: DataFrame, objects: DataFrame, limits: restore.Limits = restore.Limits(), registry: transforms.Registry | None = None) -> DataFrame:
    """``doc_id, text, error_class`` of every file."""
    back = restore.restore(plans.select("recipe_hash"), objects, registry, limits).select("recipe_hash", F.decode("bytes", "UTF-8").alias("text"), "error_class")
    return plans.select(F.col("file_id").alias("doc_id"), "recipe_hash").join(back, "recipe_hash", "left").select("doc_id", "text", "error_class")


_ALL_TEXTS = "select doc_id, text, cast(null as varchar) error_class from documents where text is not null"


@_query(_ALL_TEXTS)
def ingest_restore_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every text, chunked, compressed, stored once, and restored from the stored objects alone."""
    plans = _plans(spark, d, SMALL)
    return _restored(plans, materialize(store.first_writer_wins(pipeline.plan_objects(plans), F.col("input_ordinal")), "objects"))


@_query(
    """select doc_id, case when octet_length(encode(text)) <= 1000 then text end as text, case when octet_length(encode(text)) > 1000 then 'FileReadLimitExceeded' end error_class
    from documents where text is not null"""
)
def restore_limits(spark: SparkSession, d: str) -> DataFrame:
    """The same where files of more than 1,000 bytes are over a limit: they are refused, not left out."""
    plans = _plans(spark, d, SMALL)
    return _restored(plans, materialize(store.first_writer_wins(pipeline.plan_objects(plans), F.col("input_ordinal")), "objects"), restore.Limits(original=1000))


def _verified(plans: DataFrame) -> DataFrame:
    checked = store.verify(store.first_writer_wins(pipeline.plan_objects(plans), F.col("input_ordinal"))).filter(F.col("kind") == schema.CHUNK)
    return checked.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("error_class").isNull()).alias("verified"))


@_query(
    """select doc_id, case when n_chars is null or n_chars < 0 then 'Integrity' when n_chars <> octet_length(encode(text)) then 'ObjectLengthMismatch' end error_class
    from documents where text is not null"""
)
def ingest_verify_objects(spark: SparkSession, d: str) -> DataFrame:
    """Texts as raw objects of the length that the table states for them: the lengths in characters are wrong for many."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.col("n_chars").cast("long").alias("size"))
    claimed = rows.select("doc_id", H.sha3_256("content").alias("hash"), F.lit(schema.CHUNK).alias("kind"), "size", F.lit(schema.RAW).alias("codec"), "content")
    return store.verify(claimed, "doc_id").select("doc_id", "error_class")


@_query(
    """select doc_id, octet_length(encode(text)) size, octet_length(encode(text)) stored_size, cast(null as varchar) error_class from documents where text is not null and text = trim(text, ' ')
    union all select doc_id, null, null, 'HashMismatch' from documents where text is not null and text <> trim(text, ' ')"""
)
def store_put_verified(spark: SparkSession, d: str) -> DataFrame:
    """Texts put under the hash of their trimmed form: what has blanks at an end does not have that hash."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", H.sha3_256(F.encode(F.trim("text"), "UTF-8")).alias("hash"), F.encode("text", "UTF-8").alias("bytes"))
    return store.prepare_objects(rows, schema.CHUNK, schema.RAW).select("doc_id", "size", "stored_size", "error_class")


@_query()
def ingest_chunked_verify_objects(spark: SparkSession, d: str) -> DataFrame:
    """The same with content-defined chunks."""
    return _verified(_plans(spark, d, SMALL))


@_query("select doc_id, md5(text) raw, md5(text) zstd, md5(text) brotli, md5(text) auto from documents where text is not null")
def ingest_codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through each codec and back, and through the automatic choice."""
    rows = _files(spark, d).filter("bytes is not null")
    codecs = {c: F.lit(c) for c in (schema.RAW, schema.ZSTD, schema.BROTLI, pipeline.AUTO)}
    packed = rows.select("file_id", *[C.compressed(c, "bytes").alias(n) for n, c in codecs.items()])
    return packed.select(F.col("file_id").alias("doc_id"), *[F.md5(C.decompressed(F.col(n)["codec"], F.col(n)["bytes"])["bytes"]).alias(n) for n in codecs])


@_query(
    """select lower(hex(hash)) hash_hex, cast(i as integer) frame, least(262144, stored_size - 262144 * i) length from
    (select hash, stored_size, unnest(range((stored_size + 262143) // 262144)) i from (select hash, max(stored_size) stored_size from objects where hash is not null group by hash))"""
)
def object_frame_spans(spark: SparkSession, d: str) -> DataFrame:
    """The frames that sealing cuts each stored object into."""
    sizes = table(spark, d, "objects").filter("hash is not null").groupBy("hash").agg(F.max("stored_size").alias("stored_size"))
    return sealed.frame_spans(sizes).select(_hex(), "frame", "length")


@_query()
def sealed_accounting(spark: SparkSession, d: str) -> DataFrame:
    """For each text's pack: its bytes, those of recipes, payloads and container, and what it adds to the packs of earlier texts.

    A text that no pack could be made for has its error. Compressed sizes have no SQL.
    """
    plans = _plans(spark, d, SMALL)
    built = materialize(sealed.packs(_closures(plans)), "packs")
    entries = materialize(sealed.directories(built.filter("error_class is null").select("root_recipe", "pack")), "entries")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("stored_size")).otherwise(0))
    held = entries.groupBy("root_recipe").agg(of(schema.RECIPE).alias("recipe_bytes"), of(schema.CHUNK).alias("chunk_bytes"))
    order = plans.groupBy(F.col("recipe_hash").alias("root_recipe")).agg(F.min("file_id").alias("first_file"))
    # a chunk counts for the first text that has it: one minimum a chunk, however many have it
    first = entries.join(order, "root_recipe").groupBy("hash").agg(F.min(F.struct("first_file", "root_recipe", "stored_size")).alias("f"))
    new = first.groupBy("f.root_recipe").agg(F.sum("f.stored_size").alias("new_bytes"))
    sizes = built.select("root_recipe", F.octet_length("pack").cast("long").alias("pack_bytes"), "error_class").join(order, "root_recipe").join(held, "root_recipe", "left").join(new, "root_recipe", "left")
    overhead = F.col("pack_bytes") - F.col("recipe_bytes") - F.col("chunk_bytes")
    return sizes.select(_hex("root_recipe"), F.col("first_file").alias("doc_id"), "pack_bytes", "recipe_bytes", "chunk_bytes", overhead.alias("container_bytes"), F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"), "error_class")


@_query()
def ingest_selection_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each transform on each text; zlib and lzma sizes have no SQL."""
    return transforms.selection_report(_files(spark, d), bounds=transforms.Selection(min_size=0, allow_ext=None)).select(F.col("file_id").alias("doc_id"), "transform_id", "estimated_bytes", "outcome")


@_query(
    """with c as (select file_seq, codec, cast(sum(stored_len) as bigint) est from (select seq, any_value(file_seq) file_seq, max(codec) codec, max(stored_len) stored_len from chunk_plans group by seq) where codec is not null group by 1, 2),
    b as (select file_seq, cast(sum(raw_len) as bigint) base from (select seq, any_value(file_seq) file_seq, any_value(raw_len) raw_len from chunk_plans group by seq) group by 1)
    select file_id, transform_id, estimated_bytes from (select c.file_seq file_id, case codec when 'raw' then 0 when 'zstd' then 1 else 2 end transform_id, est estimated_bytes,
      row_number() over (partition by c.file_seq order by est, case codec when 'raw' then 0 when 'zstd' then 1 else 2 end) rn from c join b using (file_seq) where est <= floor(base * (1 - 0.01))) where rn = 1"""
)
def select_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Per file the codec whose chunks take the least, if that saves a hundredth of the raw bytes."""
    # a copy of a record may lack its codec: the largest value of each column stands for the record
    rows = table(spark, d, "chunk_plans").groupBy("seq").agg(*[F.max(c).alias(c) for c in ("file_seq", "codec", "stored_len", "raw_len")]).withColumnRenamed("file_seq", "file_id")
    number = F.when(F.col("codec") == schema.RAW, 0).when(F.col("codec") == schema.ZSTD, 1).otherwise(2)
    candidates = rows.filter("codec is not null").groupBy("file_id", number.alias("transform_id")).agg(F.sum("stored_len").alias("estimated_bytes")).withColumn("spec_order", F.col("transform_id"))
    return transforms.select_best(candidates, rows.groupBy("file_id").agg(F.sum("raw_len").alias("baseline_bytes")))


@_query(
    """with x as (select doc_id, octet_length(raw) size, lower(nullif(regexp_extract(url, '\\.([^./]+)$', 1), '')) ext, hex(raw) h from documents)
    select doc_id, ext, coalesce(ext in ('jpg','jpeg','png','webp','zip','epub','gz','tgz','bz2','xz','br','zst','mp4','mov'), false) compressed,
      coalesce(h like '89504E470D0A1A0A%' or h like '1F8B%' or h like '504B0304%' or h like '25504446%' or h like '556E697479465300%', false) magic,
      coalesce(size between 256 and 1048576, false) and (coalesce(ext in ('html', 'htm'), false) or coalesce(h like '89504E470D0A1A0A%' or h like '1F8B%' or h like '504B0304%' or h like '25504446%' or h like '556E697479465300%', false)) gate
    from x"""
)
def gate_check(spark: SparkSession, d: str) -> DataFrame:
    """Extension, magic and size tests of the received bytes."""
    rows = table(spark, d, "documents").select("doc_id", F.lower(extension("url")).alias("ext"), F.octet_length("raw").alias("size"), F.col("raw"))
    gate = transforms.gate("size", "ext", "raw", 256, 1 << 20, ("html", "htm"))
    return rows.select("doc_id", "ext", C.is_compressed_extension("ext").alias("compressed"), transforms.magic_match("raw").alias("magic"), gate.alias("gate"))


@_query(
    """with x as (select doc_id, octet_length(raw) size, lower(nullif(regexp_extract(url, '\\.([^./]+)$', 1), '')) ext, hex(raw) h from documents where raw is not null)
    select doc_id, size between 256 and 1048576 and (coalesce(ext in ('html', 'htm'), false)
      or h like '89504E470D0A1A0A%' or h like '1F8B%' or h like '504B0304%' or h like '25504446%' or h like '556E697479465300%') tried from x"""
)
def selection_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which received bodies a selection tries: within the sizes, of an allowed extension or beginning like a known container."""
    files = table(spark, d, "documents").filter("raw is not null").select(F.col("doc_id").alias("file_id"), F.col("raw").alias("bytes"), extension("url").alias("extension"))
    bounds = transforms.Selection(min_size=256, max_size=1 << 20, allow_ext=("html", "htm"))
    tried = transforms.selection_report(files, transforms.OWN[1:2], bounds)
    rows = files.select("file_id").join(tried.select("file_id", "outcome"), "file_id", "left")
    return rows.select(F.col("file_id").alias("doc_id"), F.coalesce(F.col("outcome") != "Skipped", F.lit(False)).alias("tried"))


KEY, TAG = FrameKey(b"a secret of 32 bytes for queries", b"slot of 16 bytes"), b"tag of this lake"


def _through_packs(spark: SparkSession, plans: DataFrame, built: DataFrame, key: FrameKey | None, tag: bytes) -> DataFrame:
    """The texts restored from what the format reads of packs in a folder; what a pack lacks shows as an error."""
    folder = scratch(spark, "sealed")
    sealed.write_packs(built, folder).write.format("noop").mode("overwrite").save()
    spark.dataSource.register(sealed.SealedPack)
    options = {"tag": tag.hex()} | ({"secret": key.secret.hex(), "slot": key.slot.hex()} if key else {})
    read = spark.read.format("sealedpack").options(errors="column", **options).load(folder)
    objects = read.filter("error_class is null").select("hash", "kind", "size", "stored_size", "codec", "content", F.lit(0).cast("long").alias("created_at"), "path")
    return _restored(plans, materialize(store.first_writer_wins(objects, F.col("path")), "objects"))


@_query(_ALL_TEXTS)
def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through a plain pack."""
    plans = _plans(spark, d, SMALL)
    return _through_packs(spark, plans, sealed.packs(_closures(plans)), None, sealed.DEFAULT_TAG)


@_query(_ALL_TEXTS)
def sealed_encrypted_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through an encrypted pack."""
    plans = _plans(spark, d, SMALL)
    return _through_packs(spark, plans, sealed.packs(_closures(plans), TAG, KEY), KEY, TAG)


@_query(_ALL_TEXTS)
def sealed_resealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through a plain pack that was encrypted later."""
    plans = _plans(spark, d, SMALL)
    return _through_packs(spark, plans, sealed.resealed(sealed.packs(_closures(plans)), KEY, TAG), KEY, TAG)


@_query(_ALL_TEXTS)
def transformed_restore(spark: SparkSession, d: str) -> DataFrame:
    """Every text by the transform that saves most, stored once, and restored by the transforms' decoders."""
    bounds = transforms.Selection(min_size=0, allow_ext=None, pipeline=pipeline.Config(SMALL))
    plans = materialize(transforms.plan_with_selection(_files(spark, d), bounds=bounds), "plans")
    objects = materialize(store.first_writer_wins(pipeline.plan_objects(plans), F.col("input_ordinal")), "objects")
    return _restored(plans, objects, registry=transforms.Registry(transforms.OWN))


@_query(f"with {_ST} select lower(hex(hash)) hash_hex, row_number() over (order by hash) - 1 pos from st where hash not in (select hash from object_deletions where hash is not null)")
def merkle_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of a store's own index after a deletion was committed, which rebuilds it."""
    path = scratch(spark, "store")
    objects = store.Store.from_dataframes(_stored(spark, d), table(spark, d, "file_recipe_cache"), path=path).rebuild_merkle().commit()
    left = objects.transaction(lambda s: s.delete_objects(table(spark, d, "object_deletions")))
    return left.merkle_index().leaves.select(_hex(), "pos")


@_query(
    """with first as (select hash, kind, created_at from base_objects where hash is not null),
    a as (select hash, kind, created_at from (select *, row_number() over (partition by hash order by put_seq) rn from objects where hash is not null) where rn = 1),
    b as (select hash, kind, created_at from (select *, row_number() over (partition by hash order by put_seq) rn from objects_mirror where hash is not null) where rn = 1),
    two as (select * from first union all select * from a where hash not in (select hash from first)),
    three as (select * from two where hash not in (select hash from object_deletions where hash is not null)),
    four as (select * from three union all select * from b where hash not in (select hash from three))
    select lower(hex(hash)) hash_hex, kind, created_at from four"""
)
def store_commits(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after four commits: the base image, one copy's objects, the deletions, the other copy's objects."""
    path = scratch(spark, "store")
    put = lambda name, order: store.Store.open(spark, path).put_objects(table(spark, d, name), F.col(order)).commit()
    put("base_objects", "created_at")
    put("objects", "put_seq").delete_objects(table(spark, d, "object_deletions")).commit()
    put("objects_mirror", "put_seq")
    return store.Store.open(spark, path, read_only=True).meta().select(_hex(), "kind", "created_at")


@_query("select distinct source, coalesce(regexp_full_match(source, '[A-Za-z0-9_]+'), false) valid from documents union select distinct replace(replace(source, '.', '_'), '-', '_'), true from documents where source is not null")
def namespace_check(spark: SparkSession, d: str) -> DataFrame:
    """Which hosts may name a namespace, as they are and with underscores."""
    hosts = table(spark, d, "documents").select("source").distinct()
    plain = F.translate("source", ".-", "__")
    return hosts.unionAll(hosts.filter("source is not null").select(plain)).distinct().select("source", schema.is_namespace("source").alias("valid"))


@_query(
    """select doc_id, case when n_chars is not null then greatest(least(n_chars * 100000, 4294967280), 4096) end dict_size, cast(case when b is null then null when b & 1 = 0 then 16
      when (b >> 1) & 7 <> 0 then 17 + ((b >> 1) & 7) when (b >> 4) & 7 = 0 then 17 when (b >> 4) & 7 <> 1 then 8 + ((b >> 4) & 7) end as integer) window_bits
    from (select doc_id, n_chars, cast('0x' || substr(nullif(hex(raw), ''), 1, 2) as integer) b from documents)"""
)
def codec_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary sizes for the stated lengths, and the Brotli windows that received bodies' first bytes would declare."""
    first = F.conv(F.hex(F.substring("raw", 1, 1)), 16, 10).cast("int")
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 100_000).alias("size"), first.alias("b"))
    return rows.select("doc_id", C.clamp_dict_size("size").alias("dict_size"), C.window_bits("b").alias("window_bits"))

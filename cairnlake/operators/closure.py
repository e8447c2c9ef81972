"""The closure of live recipes: missing objects, orphans, garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import recipe as R
from cairnlake.operators.store import Store

MISSING, WRONG_KIND, WRONG_LENGTH = "ObjectNotFound", "ObjectKindMismatch", "RecipeChunkLengthMismatch"


def recipe_entries(recipes: DataFrame) -> DataFrame:
    """``recipe_hash, ordinal, hash, len`` of parsed recipes; null chunks and null hashes are no entries."""
    rows = recipes.select("recipe_hash", F.posexplode("chunks").alias("ordinal", "c"))
    return rows.select("recipe_hash", "ordinal", "c.hash", "c.len").filter("hash is not null")


def parsed_recipes(live: DataFrame, objects: DataFrame) -> DataFrame:
    """``recipe_hash, kind, parsed`` of live recipe hashes; kind is null where there is no object.

    Only the wanted recipe objects are decoded and parsed, and must have their hash.
    """
    from cairnlake.operators.store import verify

    wanted = live.select(F.col("hash").alias("recipe_hash")).filter("recipe_hash is not null").distinct()
    stored = objects.join(wanted.select(F.col("recipe_hash").alias("hash")), "hash", "left_semi")
    read = verify(stored).select(F.col("hash").alias("recipe_hash"), "kind", "error_class", F.when(F.col("kind") == schema.RECIPE, R.parse_recipe_checked("bytes", "hash")).alias("parsed"))
    return wanted.join(read, "recipe_hash", "left")


def live_hashes(live: DataFrame, entries: DataFrame) -> DataFrame:
    """``hash, kind``: each live recipe and each chunk of one, with the kind it must have; distinct before any join."""
    a = live.select("hash", F.lit(schema.RECIPE).alias("need"))
    b = entries.select("hash", F.lit(schema.CHUNK).alias("need"))
    return a.unionAll(b).filter("hash is not null").distinct()


def closure(live: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``hash, need, state`` of the closure; state is null, ObjectNotFound or ObjectKindMismatch. Payloads are not read."""
    wanted = live_hashes(live, entries)
    state = F.when(F.col("kind").isNull(), MISSING).when(F.col("kind") != F.col("need"), WRONG_KIND)
    return wanted.join(objects.select("hash", "kind"), "hash", "left").select("hash", "need", state.alias("state"))


def orphans(live: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Stored objects outside the closure."""
    return objects.join(live_hashes(live, entries).select("hash").distinct(), "hash", "left_anti")


def closure_report(live: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: ``missing_objects, orphan_chunks, orphan_recipes``; the numbers, the missing hashes come from :func:`missing`."""
    no = F.lit(0).cast("long")
    lost = closure(live, entries, objects).filter(F.col("state") == MISSING).agg(F.count_distinct("hash").alias("missing_objects"))
    alone = orphans(live, entries, objects).agg(F.count_if(F.col("kind") == schema.CHUNK).alias("orphan_chunks"), F.count_if(F.col("kind") == schema.RECIPE).alias("orphan_recipes"))
    both = lost.select("missing_objects", no.alias("orphan_chunks"), no.alias("orphan_recipes")).unionAll(alone.select(no, "orphan_chunks", "orphan_recipes"))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def missing(live: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """The hashes of the closure that are not stored."""
    return closure(live, entries, objects).filter(F.col("state") == MISSING).select("hash").distinct()


def gc_report(live: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: ``deleted_chunks, deleted_recipes, freed_bytes`` of what a collection would delete."""
    return orphans(live, entries, objects).agg(
        F.count_if(F.col("kind") == schema.CHUNK).alias("deleted_chunks"), F.count_if(F.col("kind") == schema.RECIPE).alias("deleted_recipes"),
        F.coalesce(F.sum("stored_size"), F.lit(0)).alias("freed_bytes"),
    )


def collect_garbage(store: Store, live: DataFrame) -> tuple[Store, dict[str, int]]:
    """A store without the objects outside the closure of the live recipes, and the report.

    Nothing is deleted where a live object is missing, malformed or of the wrong kind:
    that raises, naming the smallest such hash. No live recipe means everything goes.
    """
    objects = store.objects
    read = parsed_recipes(live, objects)
    bad = read.filter(F.col("kind").isNotNull() & ((F.col("kind") != schema.RECIPE) | F.col("error_class").isNotNull() | F.col("parsed.error_class").isNotNull()))
    first = bad.orderBy("recipe_hash").first()
    if first is not None:
        name = WRONG_KIND if first["kind"] != schema.RECIPE else first["error_class"] or first["parsed"]["error_class"]
        raise getattr(errors, name, errors.Integrity)(bytes(first["recipe_hash"]).hex())
    entries = recipe_entries(read.select("recipe_hash", "parsed.chunks"))
    wanted = read.select(F.col("recipe_hash").alias("hash"))
    state = closure(wanted, entries, store.meta()).filter("state is not null").orderBy("hash").first()
    if state is not None:
        if state["state"] == WRONG_KIND:
            raise errors.ObjectKindMismatch(bytes(state["hash"]).hex())
        raise errors.Integrity("the closure of live recipes lacks " + bytes(state["hash"]).hex())
    report = gc_report(wanted, entries, store.meta()).first().asDict()
    return store.delete_objects(orphans(wanted, entries, store.meta()).select("hash")), report


def resolve(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``recipe_hash, hash, error_class``: each distinct chunk of each recipe with the first failing check.

    Checked are presence, kind and, against the recipe's length, size.
    """
    wanted = entries.groupBy("recipe_hash", "hash").agg(F.min("len").alias("least"), F.max("len").alias("most"))
    joined = wanted.join(objects.select("hash", "kind", "size"), "hash", "left")
    error = (
        F.when(F.col("kind").isNull(), MISSING).when(F.col("kind") != schema.CHUNK, WRONG_KIND)
        .when((F.col("least") != F.col("size")) | (F.col("most") != F.col("size")) | F.col("least").isNull(), WRONG_LENGTH)
    )
    return joined.select("recipe_hash", "hash", error.alias("error_class"))

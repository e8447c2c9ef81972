"""Physical plans: what is pushed down, pruned and exchanged."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import heavy_keys, store
from cairnlake.plans import catalogue
from cairnlake.runtime import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def read_columns(text):
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_sizes_do_not_read_payloads(spark):
    text = plan(store.chunk_sizes(table(spark, DATA, "objects")))
    assert read_columns(text) == [{"hash", "kind", "stored_size"}] and "EqualTo(kind,1)" in text


def test_lookup_reaches_the_scan(spark):
    text = plan(store.lookup(table(spark, DATA, "objects"), b"\1\2").select("kind"))
    assert "EqualTo(hash," in text and read_columns(text) == [{"hash", "kind"}]


def test_semi_join_reads_hashes_only(spark):
    text = plan(store.existing(table(spark, DATA, "objects"), table(spark, DATA, "chunk_plans")))
    assert read_columns(text) == [{"hash"}, {"hash"}] and "LeftSemi" in text


def test_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(store.page(table(spark, DATA, "objects"), b"\1", 10))


def test_first_writer_is_combined_before_the_exchange(spark):
    text = plan(store.first_writer_wins(table(spark, DATA, "objects"), F.col("put_seq")))
    assert text.count("partial_min") >= 1 and len(re.findall(r"\) Exchange\n", text)) == 1


def test_entries_read_two_columns(spark):
    text = plan(heavy_keys.recipe_entries(table(spark, DATA, "recipes")))
    assert read_columns(text)[0] >= {"recipe_id", "chunks"} and "original_file_hash" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_cross_joins(spark, name):
    text = plan(catalogue.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_keys_do_not_meet_content(spark):
    """Proofs join nodes by block, and a hot chunk's entries are spread before its content comes."""
    text = plan(catalogue.queries()["merkle_proofs"](spark, DATA))
    assert "FlatMapCoGroupsInArrow" in text or "CoGroup" in text

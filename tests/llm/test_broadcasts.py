"""Tables whose size Spark underrates are not broadcast, on whatever small input."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common, graph, mixing, near_copies, simhash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """The plans of what is stored meanwhile."""
    plans = []

    def stored(df: DataFrame) -> DataFrame:
        plans.append(plan(df))
        return common.stored(df)

    for module in (simhash, graph, near_copies):
        monkeypatch.setattr(module, "stored", stored)
    return plans


def test_anchors_are_not_broadcast(spark):
    distinct = common.stored(spark.range(50).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in plan(simhash.links(distinct))


def test_fingerprints_are_not_broadcast(spark, written):
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(20)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert len(written) > 3 and not [p for p in [*written, plan(out)] if "Broadcast" in p]


def test_near_copies_broadcast_only_those_with_several_groups(spark, written):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:50] + [f"x{k}", f"y{k}"]) for k in range(8)] + [" ".join(base[k:] + base[:k]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = near_copies.one_of_near_copies(docs)
    joins = [line for p in [*written, plan(out)] for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(written) > 10 and not [line for line in joins if "LeftOuter, BuildRight" not in line]
    sides = [p for p in written if "Broadcast" in p]
    assert not [p for p in sides if "groups" not in p or p.count("BroadcastExchange") > 1]


def test_fragments_of_the_mix_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "a b c " * 100, f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs)
    assert plan(mix.mixed()).count("SortMergeJoin") == 1 and plan(mix.taken()).count("SortMergeJoin") == 2
    assert "SortMergeJoin" in plan(mixing.mixed_documents(docs))

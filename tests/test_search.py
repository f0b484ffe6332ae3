"""Text search keeps the best documents of a query without a row for every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.functions import text


def ranked(found, k):
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d")
    rows = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).collect()
    return {(r["q"], r["rank"]): (r["d"], round(r["score"], 9)) for r in rows if r["d"] is not None}


@pytest.fixture(scope="module")
def many(spark):
    """More documents and queries than are scored at once, with copies, null texts and odd letters."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Kelvin", "ÄPFEL", "x9", "..", ""]
    line = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    docs = [(f"d{i:05}", None if i % 97 == 0 else line(9)) for i in range(5000)]
    asks = [(i, None if i == 7 else line(4)) for i in range(600)] + [(None, "w1 w2")]
    return spark.createDataFrame(asks, "q long, text string"), spark.createDataFrame(docs, "d string, text string")


@pytest.mark.parametrize("k", [1, 4])
def test_best_are_the_first_of_all(many, k):
    assert ranked(text.best(*many, k).where("q IS NOT NULL"), k) == ranked(text.bm25(*many).where("q IS NOT NULL"), k)


def test_shared_keys_and_no_words_take_the_joins(many, spark):
    asks, docs = many
    twice = docs.limit(300).unionByName(docs.limit(40))
    assert ranked(text.best(asks.where("q < 20"), twice, 3), 3) == ranked(text.bm25(asks.where("q < 20"), twice), 3)
    assert text.best(asks.where("q = 7"), docs, 3).isEmpty()
    assert text.best(asks, docs.limit(0), 3).isEmpty()


def test_no_pair_of_query_and_document_is_shuffled(spark, data):
    """rows of queries and documents that share a word were shuffled, in proportion to both."""
    plan = queries.queries()["bm25_search"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan

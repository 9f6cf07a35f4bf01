"""Joins that a scorer outside Spark decides exchange each text a few times, not once a pair."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from semweave.operators.judge import gathered
from semweave.operators.scorers import KeywordScorer
from semweave.plans.queries import BATCH, TOKEN
from semweave.plans.service_queries import service
from semweave.plans.tree import query
from semweave.session import connect

N, M, LENGTH = 300, 20, 1000


def shuffled(spark, df):
    """The rows, and bytes shuffled meanwhile."""
    sc, jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm, spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
        n = 0
        while stages.hasNext():
            n += stages.next().shuffleWriteBytes()
        return n

    before = total()
    rows = df().collect()
    return rows, total() - before


@pytest.fixture
def sides(spark, tmp_path):
    """Files too large to be broadcast, and small ones; random texts, which don't compress."""
    rng = random.Random(5)
    text = lambda i: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=LENGTH)) + (TOKEN if i % 10 == 0 else "")
    a = [(i, i % 4, text(i), [f"k{i % 3}", "m", None] if i % 5 else None) for i in range(N)]
    b = [(i, i % 4, text(i + 1), [f"k{i % 2}", "m"] if i % 7 else [], [f"t{i % 2}"]) for i in range(M)]
    spark.createDataFrame(a, "id int, turn int, said string, keys array<string>").withColumn("more", F.array(F.concat(F.lit("t"), F.col("id") % 2))).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(b, "item int, part int, text string, tags array<string>, others array<string>").write.parquet(f"{tmp_path}/b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LAUGH = f"(contains(said, '{TOKEN}') or contains(text, '{TOKEN}'))"
OVERLAP = "(keys is null or tags is null or arrays_overlap(filter(keys, x -> x is not null), tags))"


def check(spark, got, want, times=4):
    """The same rows as ``want``, and fewer bytes shuffled than ``times`` the texts have; one text a pair would be 20 times."""
    rows, n = shuffled(spark, lambda: got().select("id", "item"))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.select("id", "item").collect()))
    assert rows and n < times * (N + M) * LENGTH


def test_keyed_batch_join_exchanges_texts_once(spark, sides):
    a, b = sides
    check(spark, lambda: connect(spark, scorer=BATCH).join(b, a, "p", "text", "said", keys=[("tags", "keys")]), a.join(b, F.expr(f"{OVERLAP} and {LAUGH}")))


def test_join_on_two_key_lists_exchanges_texts_once(spark, sides):
    a, b = sides
    want = a.join(b, F.expr(f"{OVERLAP} and {LAUGH} and arrays_overlap(more, others)"))
    check(spark, lambda: connect(spark, scorer=BATCH).join(b, a, "p", "text", "said", keys=[("tags", "keys"), ("others", "more")]), want)


@pytest.mark.parametrize("layout", ["pack"])
def test_service_is_dealt_texts_once(spark, sides, layout):
    a, b = sides
    check(spark, lambda: connect(spark, scorer=service(), layout=layout).join(a, b, "p", "said", "text"), a.join(b, F.expr(LAUGH)))


def test_batch_join_on_a_condition_exchanges_texts_once(spark, sides):
    a, b = sides
    on = (F.col("turn") == F.col("part")) | (F.col("part") > 0)
    check(spark, lambda: connect(spark, scorer=BATCH).join(a, b, "p", "said", "text", on=on), a.join(b, on & F.expr(LAUGH)))


def test_side_under_a_null_safe_join_is_measured(spark, sides):
    """Catalyst's estimate of a join is the product of its inputs, so the small side is found by its rows."""
    a, b = sides
    labels = spark.range(2).select(F.when(F.col("id") == 0, F.col("id")).cast("int").alias("label"))
    b = b.withColumn("k", F.when(F.col("part") != 3, F.col("part")))
    frame = lambda: query(connect(spark, scorer=BATCH), b).sem_join(a, "p", "text", "said").join(labels, [("k", "label")], null_safe=True).frame()
    check(spark, frame, a.join(b, F.expr(f"(k is null or k = 0) and {LAUGH}")))


def test_product_exchanges_texts_once(spark, sides):
    a, b = sides
    frame = lambda: query(connect(spark, scorer=BATCH), b).sem_join(a, "p", "text", "said").where("ID % 2 = 0").where("rand() < 2").where("item > 1").frame()
    check(spark, frame, a.join(b, F.expr(f"id % 2 = 0 and item > 1 and {LAUGH}")))


def requests(sem):
    return sem.stats().first()["requests"]


def test_star_is_dealt_texts_once_in_full_requests(spark, sides):
    """Two tasks, each with all texts of the small side: at most one request of each isn't full."""
    a, b = sides
    sem = connect(spark, scorer=service(), layout="star", anchor="right", threads=2, k=50)
    check(spark, lambda: sem.join(a, b, "p", "said", "text"), a.join(b, F.expr(LAUGH)))
    assert requests(sem) <= N * M / 50 + 2 * M


def test_rows_of_one_text_are_gathered():
    parts = [pd.DataFrame({"t": [f"t{(i + j) % 7}" for i in range(40)], "n": range(40 * j, 40 * j + 40)}) for j in range(10)]
    out = list(gathered(iter(parts), "t", 10))
    assert sorted(n for x in out for n in x["n"]) == list(range(400))
    assert all((x.groupby("t").size() % 10 == 0).all() for x in out[:-1]) and len(out[-1]) < 7 * 10
    few = list(gathered(iter(parts), "t", 1000, most=50))
    assert sorted(n for x in few for n in x["n"]) == list(range(400)) and max(map(len, few)) <= 90


def test_native_keyed_join_makes_no_exchange(spark, sides):
    a, b = sides
    check(spark, lambda: connect(spark, scorer=KeywordScorer(TOKEN)).join(b, a, "p", "text", "said", keys=[("tags", "keys")]), a.join(b, F.expr(f"{OVERLAP} and {LAUGH}")), times=0.01)


@pytest.mark.parametrize("anchor", ["auto", "left"])
def test_auto_layout_is_chosen_without_texts_of_pairs(spark, sides, anchor):
    a, b = sides
    sem = connect(spark, scorer=service(), anchor=anchor, k=50, threads=2)
    check(spark, lambda: sem.join(a, b, "p", "said", "text"), a.join(b, F.expr(LAUGH)), times=6)


def test_anti_join_exchanges_texts_once(spark, sides):
    a, b = sides
    heard = a.withColumn("heard", F.when(F.col("turn") > 0, F.col("said")))
    frame = lambda: connect(spark, scorer=BATCH).join(heard, b, "p", "heard", "text", how="anti", on=F.col("turn") != F.col("part")).withColumn("item", F.lit(0))
    want = heard.join(b, F.expr(f"heard is not null and turn != part and {LAUGH}"), "left_anti").withColumn("item", F.lit(0))
    check(spark, frame, want)

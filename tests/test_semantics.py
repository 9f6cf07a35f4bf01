"""Filters, decisions, joins, keys, cascade, plan rules and counters on the small relations."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from semweave import decision as D
from semweave.config import SemConfig, is_options
from semweave.functions.keys import keys_overlap
from semweave.functions.render import record, side_text
from semweave.operators.cascade import calibrate
from semweave.operators.judge import AnswerError
from semweave.operators.scorers import BatchScorer, KeywordScorer, SharedPrefixScorer
from semweave.plans.tree import Decide, Sort, query
from semweave.session import connect

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def ask(decision, batch):
    out = []
    for item in batch:
        texts = list(item) if decision.pairwise else [v for _, v in item]
        joined = " ".join(texts)
        if decision.mode == D.CHOICE:
            out.append(next((x for x in decision.labels if x in joined), decision.labels[-1]))
        elif decision.mode == D.SCORE:
            out.append(min(joined.count("!"), len(decision.criteria) - 1))
        else:
            out.append(0.9 if "good" in joined.lower() else 0.1)
    return out


BATCH = BatchScorer("fixture", ask)


@pytest.fixture(params=["native", "batch"])
def sem(request, spark):
    return connect(spark, scorer=KeywordScorer() if request.param == "native" else BATCH, threads=2)


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame([(1, "good film"), (2, "bad film"), (3, "good film"), (4, None), (5, "good plot"), (6, "bad plot")], "id int, review string")


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def stats(sem):
    return sem.stats().first().asDict()


def test_filter_forms(sem, reviews):
    assert ids(sem.filter(reviews, "p", "review")) == [1, 3, 5]
    with sem.run():
        assert ids(sem.filter(reviews, "p", "review", where="id > 2")) == [3, 5]
        assert stats(sem)["records"] == 3
    out = sem.with_decisions(reviews, h=sem.holds("p", "review"))
    assert ids(out.where("not h")) == [2, 6]
    assert {r["id"] for r in out.where("h is null").collect()} == {4}
    with sem.run():
        assert ids(sem.filter_or(reviews, F.col("id") < 3, "p", "review")) == [1, 2, 3, 5]
        assert stats(sem)["records"] == 3
    assert ids(sem.filter(reviews, "p", "review", options={"THRESHOLD": 0.95})) == []
    assert ids(sem.filter(reviews, "p", "review", {"threshold": 0.1})) == [1, 2, 3, 5, 6]


def test_four_functions_share_questions(sem, spark):
    r = spark.createDataFrame([(1, "good positive!!"), (2, "bad negative"), (3, "good positive!!"), (4, None)], "id int, text string")
    with sem.run():
        out = sem.with_decisions(r, h=sem.holds("q", "text"), p=sem.probability("q", "text"), c=sem.choose("q", "text", ["positive", "negative"]), s=sem.score("q", "text", ["a", "b", "c"]))
        got = {x["id"]: (x["h"], x["p"], x["c"], x["s"]) for x in out.collect()}
        assert got == {1: (True, 0.9, "positive", 2.0), 2: (False, 0.1, "negative", 0.0), 3: (True, 0.9, "positive", 2.0), 4: (None, None, None, None)}
        found = stats(sem)
        assert found["records"] == 6 and found["cache_hits"] == 6


def test_each_distinct_input_is_asked_once(spark, tmp_path, reviews):
    log = tmp_path / "asked"

    def noting(decision, batch):
        with open(log, "a") as f:
            f.writelines(f"{item}\n" for item in batch)
        return ask(decision, batch)

    sem = connect(spark, scorer=BatchScorer("noting", noting))
    many = reviews.unionByName(reviews).unionByName(reviews)
    with sem.run():
        assert sem.filter(many, "p", "review").count() == 9
        assert sem.with_decisions(many, p=sem.probability("p", "review")).where("p > 0.5").count() == 9
        assert sem.filter(many, "p", "review", options={"threshold": 0.05}).count() == 15
    assert len(log.read_text().splitlines()) == 4


def test_joins(sem, spark):
    a = spark.createDataFrame([(1, "good a"), (2, "good a"), (3, "bad"), (4, None)], "id int, t string")
    b = spark.createDataFrame([(10, "x"), (11, "y"), (12, None)], "bid int, u string")
    pairs = lambda df: sorted((r["id"], r["bid"]) for r in df.collect())
    assert pairs(sem.join(a, b, "p", "t", "u")) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    assert pairs(sem.join(a, b, "p", "t", "u", on=F.col("id") + 9 == F.col("bid"))) == [(1, 10), (2, 11)]
    assert ids(sem.join(a, b, "p", "t", "u", how="semi")) == [1, 2]
    assert ids(sem.join(a, b, "p", "t", "u", how="anti")) == [3, 4]
    with pytest.raises(ValueError, match="inner, semi or anti"):
        sem.join(a, b, "p", "t", "u", how="left")


def test_keys(sem, spark):
    schema = "id int, text string, keys array<string>"
    a = spark.createDataFrame([(1, "good a", ["x"]), (2, "good a", ["x"]), (3, "bad a", None)], schema)
    b = spark.createDataFrame([(10, "b", ["x"]), (11, "c", ["y"])], "bid int, btext string, bkeys array<string>")
    for left, right, pairs, cross, index in ((a, b, 4, 6, 0), (a, b, 3, 0, 4), (a.withColumn("keys", F.lit(None).cast("array<string>")), b, 4, 0, 6)):
        with sem.run():
            keys = [("keys", "bkeys")] if index else []
            got = sorted((r["id"], r["bid"]) for r in sem.join(left, right, "p", "text", "btext", keys=keys).collect())
            assert got == ([(1, 10), (2, 10)] if pairs == 3 else [(1, 10), (1, 11), (2, 10), (2, 11)])
            found = stats(sem)
            assert (found["pairs"], found["cross_product_pairs"], found["index_candidate_pairs"]) == (pairs, cross, index)


def test_keyed_join_equals_brute_force(sem, spark):
    lists = [None, [], ["x"], ["y", None], [None], ["x", "y"], ["z"]]
    a = spark.createDataFrame([(i, f"good {i % 3}" if i % 2 else f"bad {i}", k, lists[(i * 3) % 7]) for i, k in enumerate(lists * 2)], "id int, t string, k array<string>, k2 array<string>")
    b = spark.createDataFrame([(i, f"u{i % 4}", k, lists[(i * 5) % 7]) for i, k in enumerate(lists)], "bid int, u string, m array<string>, m2 array<string>")
    for keys in ([("k", "m")], [("k", "m"), ("k2", "m2")]):
        test = keys_overlap("k", "m") if len(keys) == 1 else keys_overlap("k", "m") & keys_overlap("k2", "m2")
        want = sorted((r["id"], r["bid"]) for r in a.join(b, test & F.col("t").contains("good")).collect())
        assert sorted((r["id"], r["bid"]) for r in sem.join(a, b, "p", "t", "u", keys=keys).collect()) == want
        assert ids(sem.join(a, b, "p", "t", "u", how="semi", keys=keys)) == sorted({i for i, _ in want})
        assert ids(sem.join(a, b, "p", "t", "u", how="anti", keys=keys)) == sorted(set(range(14)) - {i for i, _ in want})


def test_keys_overlap_is_never_null(spark):
    df = spark.sql("select * from values (array('x'), array('y', null)), (null, array('x')), (array(), null), (array(), array('x')), (array('x', null), array('x')), (array(null), array(null)) t(a, b)")
    assert [r[0] for r in df.select(keys_overlap("a", "b")).collect()] == [False, True, True, False, True, False]


def test_rendering(spark):
    df = spark.sql("select 1 as n, named_struct('a', 'x', 'b', 2) as s, array(1, null) as l, map('k', 1.5) as m, named_struct('in', named_struct('q', true)) as deep, cast(null as string) as z, named_struct('a', cast(null as string)) as part")
    text = lambda c: df.select(side_text(df, c)).first()[0]
    assert [text(c) for c in ("n", "s", "l", "m", "deep", "z", "part")] == ["1", "a: x; b: 2", "[1, NULL]", "{k=1.5}", "{'q': true}", None, None]
    assert [tuple(f) for f in df.select(record(df, "s")).first()[0]] == [("a", "x"), ("b", "2")]
    with pytest.raises(ValueError):
        record(df.selectExpr("named_struct('question', 1) as r"), "r")
    assert df.selectExpr("n as condition").transform(lambda d: d.select(record(d, "condition"))).first()[0][0]["name"] == "document"


def test_cascade(spark):
    docs = spark.createDataFrame([(1, "good a"), (2, "b"), (3, "good c"), (4, "d yes"), (5, None)], "id int, text string")
    first, second = KeywordScorer("good", 0.6, 0.1), KeywordScorer("c", 1.0, 0.0)
    for one in (first, BatchScorer("f", lambda d, b: [0.6 if "good" in r[0][1] else 0.1 for r in b])):
        for two in (second, BatchScorer("s", lambda d, b: ["c" in r[0][1] for r in b])):
            sem = connect(spark, scorer=one, second=two, cascade_model="m", threads=2, cascade_threads=2)
            with sem.run():
                assert ids(sem.filter(docs, "p", "text")) == [3]
                found = stats(sem)
                assert (found["band_items"], found["cascade_items"], found["cascade_last_low"]) == (2, 2, 0.5)
            out = sem.with_decisions(docs, h=sem.holds("p", "text"), p=sem.probability("p", "text"))
            assert {r["id"]: (r["h"], r["p"]) for r in out.collect()} == {1: (False, 0.6), 2: (False, 0.1), 3: (True, 0.6), 4: (False, 0.1), 5: (None, None)}
    sem = connect(spark, scorer=KeywordScorer("good", 0.5, 0.5), second=KeywordScorer("yes", 1.0, 0.0), cascade_model="m", cascade_calibrate=3)
    assert ids(sem.filter(docs, "p", "text")) == [4]
    with pytest.raises(ValueError, match="calibration"):
        sem.with_decisions(docs, h=sem.holds("p", "text"))


def test_calibration():
    sample = [(0.1, False), (0.2, False), (0.4, True), (0.6, False), (0.8, True), (0.9, True)]
    assert calibrate(sample, 0.0, 0.0, 0.5, 0.9) == (0.4, 0.8)
    assert calibrate([], 0.0, 0.0, 0.5, 0.9) == (0.5, 0.9)
    low, high = calibrate([(0.5, False), (0.5, True)], 0.0, 0.0, 0.5, 0.9)
    assert low == 0.5 and high > 1
    assert calibrate([(0.3, False)], 0.05, 0.05, 0.5, 0.9)[0] == pytest.approx(0.300001)


def test_rejected_answers(spark, reviews):
    lost = BatchScorer("lost", lambda d, b: [None for _ in b])
    with pytest.raises(Exception, match="no answer"):
        connect(spark, scorer=lost).filter(reviews, "p", "review").collect()
    sem = connect(spark, scorer=lost, on_error="reject")
    out = sem.with_decisions(reviews, h=sem.holds("p", "review"), p=sem.probability("p", "review"))
    assert {(r["id"], r["h"], r["p"]) for r in out.collect()} == {(i, None if i == 4 else False, None) for i in range(1, 7)}
    for bad in (2.0, float("nan"), "x", True):
        with pytest.raises(AnswerError):
            from semweave.operators.judge import checked

            checked(D.holds("p"), bad)


def test_top_n_is_taken_before_a_single_decision(spark):
    rows = spark.createDataFrame([(i, i % 17, f"{'good' if i % 2 == 0 else 'bad'}-{i}") for i in range(600)], "i int, priority int, text string")
    sem = connect(spark, scorer=BATCH, threads=2)
    choice = sem.choose("q", "text", ["good", "bad"])
    order = [("priority", False), ("i", True)]
    tree = query(sem, rows).decide("c", choice).top(order, 100)
    assert isinstance(tree.optimized(), Decide)
    with sem.run():
        assert len(tree.frame().collect()) == 100
        assert stats(sem)["records"] == 100
    for kept in (query(sem, rows).decide("c", choice).top(order, 10, 5), query(sem, rows).decide("c", choice).top([("c", True), ("i", True)], 10), query(sem, rows).decide("c", choice).decide("d", choice).top(order, 10)):
        assert isinstance(kept.optimized(), Sort)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_reduction_changes_no_rows(spark, how):
    rep = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} {i}") for i in range(12)] + [(None, "good none")], "rid int, rtext string")
    pln = spark.createDataFrame([(i, f"plan {i}") for i in range(20)], "pid int, ptext string")
    one = spark.createDataFrame([(1,), (3,), (3,), (4,), (None,)], "k int")
    two = spark.createDataFrame([(1, 2), (3, 4), (3, 4), (5, None), (None, 7)], "x int, y int")
    got = {}
    for reduce in (True, False):
        sem = connect(spark, scorer=KeywordScorer(), reduce_inputs=reduce)
        for name, other, on, null_safe in (("one", one, [("rid", "k")], False), ("right", one, [("pid", "k")], False), ("two", two, [("rid", "x"), ("pid", "y")], True)):
            with sem.run():
                df = query(sem, rep).sem_join(pln, "p", "rtext", "ptext").join(other, on, how, null_safe).frame()
                rows = sorted(map(repr, df.collect()))
                got.setdefault(name, []).append((rows, sem.current.work.settled().known["pairs"]))
    for name, ((a, few), (b, many)) in got.items():
        assert a == b and few <= many
        if how != "left_anti":
            assert few < many, name


def test_chains_of_joins_are_reduced(spark):
    rep = spark.createDataFrame([(i, f"{'good' if i % 3 == 0 else 'bad'} {i}", i % 4) for i in range(12)], "rid int, rtext string, team int")
    iss = spark.createDataFrame([(i, f"issue {i}") for i in range(20)], "iid int, itext string")
    notes = spark.createDataFrame([(3, "a"), (5, "b"), (5, "b"), (7, None), (None, "a")], "nid int, note string")
    kinds = spark.createDataFrame([("a", 1), ("c", 2)], "kind string, n int")
    team = spark.createDataFrame([(0,), (1,)], "t int")
    shapes = {
        "relation": [(notes, [("iid", "nid")], "inner"), (kinds, [("note", "kind")], "inner")],
        "relation semi": [(notes, [("iid", "nid")], "inner"), (kinds, [("note", "kind")], "left_semi")],
        "both inputs": [(notes, [("iid", "nid")], "inner"), (team, [("team", "t")], "left_semi")],
        "anti": [(team, [("team", "t")], "left_anti"), (notes, [("iid", "nid")], "left_semi")],
    }
    pairs = {"relation": 12 * 1, "relation semi": 12 * 1, "both inputs": 6 * 3, "anti": 6 * 3}
    for name, joins in shapes.items():
        got = []
        for reduce in (True, False):
            sem = connect(spark, scorer=KeywordScorer(), reduce_inputs=reduce)
            with sem.run():
                tree = query(sem, rep).sem_join(iss, "p", "rtext", "itext")
                for other, on, how in joins:
                    tree = tree.join(other, on, how)
                rows = sorted(map(repr, tree.frame().collect()))
                got.append((rows, sem.current.work.settled().known["pairs"]))
        assert got[0][0] == got[1][0] and got[0][0], name
        assert (got[0][1], got[1][1]) == (pairs[name], 240), name


def test_user_columns_keep_their_names_and_values(sem, spark):
    """Columns named like anything an operator might add."""
    odd = ["input", "__input", "__value", "taken", "key0_0", "k1_0", "l1_0", "left_0", "value_0", "token_a", "holds"]
    rows = [(i, t, *(f"{n}{i}" for n in odd)) for i, t in ((1, "good"), (2, "bad"), (3, None))]
    df = spark.createDataFrame(rows, "id int, t string, " + ", ".join(f"`{n}` string" for n in odd))
    for got in (sem.filter(df, "p", "t"), sem.filter_or(df, F.col("id") == 1, "p", "t"), sem.join(df, spark.createDataFrame([("u",)], "u string"), "p", "t", "u").drop("u")):
        assert got.columns == df.columns and [tuple(r) for r in got.collect()] == rows[:1]
    got = sem.with_decisions(df, p=sem.probability("p", "t"), value=sem.holds("p", "t"))
    assert got.columns == [*df.columns, "p", "value"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == rows


def test_self_joins(sem, spark):
    df = spark.createDataFrame([(1, "good a", ["x"]), (2, "b", ["x"]), (3, "c", None), (4, None, ["x"])], "id int, t string, k array<string>")
    pairs = lambda out: sorted((r[0], r[1]) for r in out.select("l.id", "r.id").collect())
    assert pairs(sem.join(df, df, "p", "t", "t", on=F.col("l.id") < F.col("r.id"))) == [(1, 2), (1, 3)]
    assert pairs(sem.join(df, df.where("id > 1"), "p", "t", "t")) == [(1, 2), (1, 3)]
    assert pairs(sem.join(df, df, "p", "t", "t", keys=[("k", "k")])) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    assert ids(sem.join(df, df, "p", "t", "t", how="semi", on=F.col("l.id") > F.col("r.id"))) == [2, 3]
    assert ids(sem.join(df, df, "p", "t", "t", how="anti", on=F.col("l.id") > F.col("r.id"))) == [1, 4]


def test_closing_a_run_starts_no_job(sem, spark):
    a = spark.range(300).selectExpr("id", "concat('good ', id) as t")
    spark.sparkContext.setJobGroup("close", "close")
    try:
        sem.join(a, a, "p", "t", "t").select("l.id")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("close"))
        sem.close()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("close")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = sem.stats().first()  # after the run, and without making the product
    assert (found["pairs"], found["cross_product_pairs"], found["cache_hits"]) == (90000, 90000, 0)


def test_decisions_of_one_question_share_a_join(spark, reviews):
    sem = connect(spark, scorer=BATCH)
    out = sem.with_decisions(reviews, a=sem.holds("p", "review"), b=sem.probability("p", "review"), c=sem.holds("p", "review", options={"threshold": 0.95}))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    assert {r["id"]: (r["a"], r["b"], r["c"]) for r in out.collect()} == {1: (True, 0.9, False), 2: (False, 0.1, False), 3: (True, 0.9, False), 4: (None, None, None), 5: (True, 0.9, False), 6: (False, 0.1, False)}


def test_conditions_are_resolved_by_analysis(spark):
    a = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} {i}") for i in range(20)], "rid int, `text of it` string")
    b = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "pid int, u string")
    sem = connect(spark, scorer=KeywordScorer())
    tree = query(sem, a).sem_join(b, "p", "`text of it`", "u")
    got = tree.where("RID < 10 and length(`text of it`) > 0").optimized()
    assert type(got).__name__ == "SemJoin" and type(got.left).__name__ == "Where"
    assert tree.where("RID < 10").frame().count() == 25
    decided = query(sem, a).decide("p", sem.probability("q", "`text of it`"))
    assert decided.where("P > 0.5 and 'rid' <> 'p'").frame().count() == 10
    assert type(decided.where("Rid > 3").optimized()).__name__ == "Decide"


def test_volatile_conditions_and_relations_stay(spark):
    a = spark.range(40).selectExpr("id as rid", "concat('good ', id) as rtext")
    b = spark.range(30).selectExpr("id as pid", "concat('plan ', id) as ptext")
    ok = spark.createDataFrame([(1, 2), (3, 4), (3, 4), (5, None)], "x bigint, y bigint")
    sem = connect(spark, scorer=KeywordScorer())
    tree = query(sem, a).sem_join(b, "p", "rtext", "ptext")
    kept = tree.where("rand(1) < 0.1")
    assert type(kept.optimized()).__name__ == "Where"
    assert len({r["rid"] for r in kept.frame().collect()}) > 20
    on = [("rid", "x"), ("pid", "y")]
    stable = {"plain": ok, "grouped": ok.groupBy("x", "y").agg(F.count("*").alias("n")), "distinct": ok.distinct(), "least": ok.groupBy("x").agg(F.min("y").alias("y"))}
    for name, other in stable.items():
        assert tree.join(other, on).optimized().reduced, name
    volatile = {
        "random": ok.withColumn("y", F.col("y") + (F.rand() * 0).cast("int")),
        "limit": ok.limit(2),
        "sample": ok.sample(0.5, seed=1),
        "any": ok.groupBy("x").agg(F.first("y").alias("y")),
        "rounded": ok.groupBy("x").agg(F.max("y").alias("y"), F.sum(F.col("y") * 0.1).alias("s")),
        "python": ok.mapInPandas(lambda parts: parts, ok.schema),
    }
    for name, other in volatile.items():
        got = tree.join(other, on).optimized()
        assert got == tree.join(other, on).node, name
    decided = tree.join(query(sem, ok.withColumn("note", F.lit("good"))).sem_filter("open", "note"), on)
    assert decided.optimized() == decided.node


def test_shared_prefix(spark):
    df = spark.createDataFrame([("abcd", "abxy"), ("", ""), ("é", "è"), ("same", "same"), ("a", "")], "a string, b string")
    sem = connect(spark, scorer=SharedPrefixScorer())
    got = [r["p"] for r in sem.with_decisions(df, p=sem.probability("prefix", "a", "b")).collect()]
    assert got == [0.5, 1.0, 0.5, 1.0, 0.0]


def test_settings():
    assert is_options({"Threshold": 1}) and not is_options({"text": 1}) and not is_options("x")
    c = SemConfig().with_options({"K": 5, "layout": "sep"})
    assert (c.k, c.layout) == (5, "sep")
    for bad in ({"k": 0}, {"layout": "x"}, {"threshold": 1.5}, {"threshold": None}, {"reduce_inputs": True}, {"nope": 1}, {"budget_tokens": 60_000}, {"cascade_low": 0.95}, {"timeout": float("inf")}):
        with pytest.raises(ValueError):
            SemConfig().with_options(bad)
    for bad in (lambda: D.choose("q", ["a"]), lambda: D.choose("q", ["a", "a"]), lambda: D.score("q", ["a"]), lambda: D.score("q", ["a", None]), lambda: D.holds(None)):
        with pytest.raises(ValueError):
            bad()
    assert D.holds("q").identity == D.probability("q").identity != D.holds("r").identity


def test_nothing_is_asked_before_an_action(spark, reviews):
    def never(decision, batch):
        raise RuntimeError("asked")

    sem = connect(spark, scorer=BatchScorer("never", never))
    sem.filter(reviews, "p", "review").explain()
    assert "Semantic filter" in sem.explain()


def test_ordinary_conditions_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = connect(spark).filter(docs, "p", "text", where="lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "Python" not in plan and "Exchange" not in plan


def test_stream(spark, tmp_path, reviews):
    from semweave.streaming.decisions import decide_stream

    reviews.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reviews.schema).parquet(f"{tmp_path}/in")
    sem = connect(spark, scorer=BATCH, threads=2)
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    q = decide_stream(stream, sem, lambda run, batch: run.filter(batch, "p", "review"), sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ids(spark.read.parquet(f"{tmp_path}/out/*")) == [1, 3, 5]


@pytest.mark.parametrize("kind", ["native", "batch"])
def test_sql_functions(spark, reviews, kind):
    from semweave.functions.sql import register, register_batch

    register(spark) if kind == "native" else register_batch(spark, BATCH)
    reviews.createOrReplaceTempView("sem_reviews")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("select id from sem_reviews where id > 1 and sem_holds('p', review) order by id") == [(3,), (5,)]
    assert sql("select id, sem_probability('p', review), not sem_holds('p', review) from sem_reviews where id in (2, 3, 4) order by id") == [(2, 0.1, True), (3, 0.9, False), (4, None, None)]
    assert sql("select sem_choose('q', review, array('film', 'plot')), sem_score('q', review || '!', array('a', 'b', 'c')) from sem_reviews where id = 5") == [("plot", 1.0)]
    assert sql("select a.id, b.id from sem_reviews a join sem_reviews b on a.id < b.id and b.id < 4 where sem_holds_pair('p', a.review, b.review) order by 1, 2") == [(1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("kind", ["native", "batch"])
def test_sql_options_and_structs(spark, reviews, kind):
    from semweave.functions.sql import register, register_batch

    register(spark) if kind == "native" else register_batch(spark, BATCH)
    reviews.createOrReplaceTempView("sem_reviews")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("select id from sem_reviews where sem_holds('p', review, map('threshold', '0.95'))") == []
    assert sql("select id from sem_reviews where sem_holds('p', review, map('Threshold', '0.05')) order by id") == [(1,), (2,), (3,), (5,), (6,)]
    assert sql("select sem_holds_pair('p', review, 'good', map('threshold', '0.9')) from sem_reviews where id = 2") == [(True,)]
    with pytest.raises(Exception, match="unknown option"):
        sql("select sem_holds('p', review, map('nope', '1')) from sem_reviews")
    if kind == "batch":
        assert sql("select id, sem_probability('p', struct(id, review)) from sem_reviews where id > 3 order by id") == [(4, None), (5, 0.9), (6, 0.1)]
    else:
        with pytest.raises(ValueError, match="no SQL form"):
            register(spark, SharedPrefixScorer())


def test_answers_do_not_outlive_their_query(spark, reviews, tmp_path):
    from semweave.functions.sql import register_batch

    log = tmp_path / "asked"

    def noting(decision, batch):
        with open(log, "a") as f:
            f.writelines("x\n" for _ in batch)
        return ask(decision, batch)

    register_batch(spark, BatchScorer("noting sql", noting))
    reviews.coalesce(1).createOrReplaceTempView("sem_reviews")
    for n in (1, 2):
        spark.sql("select sem_probability('p', review) from sem_reviews").collect()
        assert len(log.read_text().splitlines()) == 4 * n

"""The registered queries of the semantic operators, and the ordinary operators around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semweave import decision as D
from semweave.functions.keys import keys_overlap
from semweave.functions.media import MARK, media
from semweave.functions.render import record, side_text
from semweave.functions.sql import register
from semweave.operators.scorers import BatchScorer, KeywordScorer, SharedPrefixScorer
from semweave.plans.tree import query
from semweave.session import SemanticSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The stand-in decision of these queries.
TOKEN = "haha"
SCORER = KeywordScorer(token=TOKEN)
P = f"CASE WHEN contains(lower(text), '{TOKEN}') THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END"


def q(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, scorer=SCORER, **settings) -> SemanticSession:
    from semweave.session import connect

    return connect(spark, scorer=scorer, **settings)


def ask_keyword(decision: D.Decision, batch: list) -> list:
    """The stand-in as a batch scorer: what a local model would be."""
    out = []
    for item in batch:
        texts = list(item) if decision.pairwise else [v for _, v in item]
        if decision.mode == D.CHOICE:
            out.append(next((label for label in decision.labels if any(label in t for t in texts)), decision.labels[-1]))
        elif decision.mode == D.SCORE:
            out.append(min(sum(t.count("!") for t in texts), len(decision.criteria) - 1))
        else:
            out.append(0.9 if any(TOKEN in t.lower() for t in texts) else 0.1)
    return out


BATCH = BatchScorer("keyword", ask_keyword)


@q(f"SELECT doc_id, lang FROM documents WHERE {P} >= 0.5")
def filter_basic(spark, sf_dir):
    return session(spark).filter(table(spark, sf_dir, "documents"), "mentions laughter", "text").select("doc_id", "lang")


@q(f"SELECT doc_id, lang FROM documents WHERE {P} >= 0.5")
def filter_batch_scorer(spark, sf_dir):
    return session(spark, BATCH).filter(table(spark, sf_dir, "documents"), "mentions laughter", "text").select("doc_id", "lang")


@q(f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 AND {P} >= 0.5")
def filter_ordinary_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return session(spark).filter(docs, "mentions laughter", "text", where="lang = 'en' AND n_chars > 500").select("doc_id")


@q(f"SELECT doc_id FROM documents WHERE NOT ({P} >= 0.5)")
def filter_not(spark, sf_dir):
    sem = session(spark)
    docs = sem.with_decisions(table(spark, sf_dir, "documents"), h=sem.holds("mentions laughter", "text"))
    return docs.where("not h").select("doc_id")


@q(f"SELECT doc_id FROM documents WHERE lang = 'de' OR {P} >= 0.5")
def filter_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return session(spark, BATCH).filter_or(docs, F.col("lang") == "de", "mentions laughter", "text").select("doc_id")


@q(f"SELECT doc_id, CASE WHEN lang <> 'fr' THEN {P} END AS p, CASE WHEN lang <> 'fr' THEN {P} >= 0.5 END AS h FROM documents")
def null_inputs(spark, sf_dir):
    sem = session(spark)
    docs = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("lang") != "fr", F.col("text")))
    return sem.with_decisions(docs, p=sem.probability("mentions laughter", "t"), h=sem.holds("mentions laughter", "t")).select("doc_id", "p", "h")


@q(f"SELECT doc_id, {P} AS p, {P} >= 0.05 AS low, {P} >= 0.95 AS high FROM documents")
def thresholds_share_answers(spark, sf_dir):
    sem = session(spark, BATCH)
    with_p = {"p": sem.probability("mentions laughter", "text")}
    with_p |= {n: sem.holds("mentions laughter", "text", options={"threshold": t}) for n, t in (("low", 0.05), ("high", 0.95))}
    return sem.with_decisions(table(spark, sf_dir, "documents"), **with_p).select("doc_id", "p", "low", "high")


@q("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'the') THEN 'the' ELSE 'other' END AS label FROM documents")
def choose_label(spark, sf_dir):
    sem = session(spark)
    return sem.with_decisions(table(spark, sf_dir, "documents"), label=sem.choose("which sound", "text", ["tion", "the", "other"])).select("doc_id", "label")


@q("SELECT doc_id, least(len(text) - len(replace(text, '.', '')), 9)::DOUBLE AS s FROM documents")
def score_marks(spark, sf_dir):
    sem = session(spark, KeywordScorer(token=TOKEN, mark="."))
    return sem.with_decisions(table(spark, sf_dir, "documents"), s=sem.score("how many", "text", [f"level {i}" for i in range(10)])).select("doc_id", "s")


@q(f"SELECT doc_id, CASE WHEN contains(lower(lang), '{TOKEN}') OR contains(lower(text), '{TOKEN}') THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS p FROM documents")
def struct_input(spark, sf_dir):
    sem = session(spark)
    docs = table(spark, sf_dir, "documents").withColumn("r", F.struct("lang", "text"))
    return sem.with_decisions(docs, p=sem.probability("mentions laughter", "r")).select("doc_id", "p")


@q("SELECT event_id, 'event_type: ' || event_type || '; user_id: ' || user_id AS side, event_type AS name, '[' || event_type || ', ' || user_id || ']' AS list FROM events")
def rendered_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("r", F.struct("event_type", "user_id")).withColumn("a", F.array("event_type", F.col("user_id").cast("string")))
    return ev.select("event_id", side_text(ev, "r").alias("side"), record(ev, "event_type")[0]["value"].alias("name"), side_text(ev, "a").alias("list"))


PAIR_SQL = "contains(lower(c.text), 'haha') OR contains(lower(b.text), 'haha')"


def talk(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("said"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return c, b


@q(f"SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE b.item_id % 10 = c.turn AND ({PAIR_SQL})")
def join_inner(spark, sf_dir):
    c, b = talk(spark, sf_dir)
    return session(spark).join(c, b, "one of them laughs", "said", "item", on=F.col("item_id") % 10 == F.col("turn")).select("conv_id", "turn", "item_id")


@q(f"SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE b.item_id % 10 = c.turn AND ({PAIR_SQL})")
def join_inner_batch_scorer(spark, sf_dir):
    c, b = talk(spark, sf_dir)
    return session(spark, BATCH).join(c, b, "one of them laughs", "said", "item", on=F.col("item_id") % 10 == F.col("turn")).select("conv_id", "turn", "item_id")


@q(f"SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id % 10 = c.turn AND ({PAIR_SQL}))")
def join_semi(spark, sf_dir):
    c, b = talk(spark, sf_dir)
    return session(spark).join(c, b, "one of them laughs", "said", "item", how="semi", on=F.col("item_id") % 10 == F.col("turn")).select("conv_id", "turn")


@q(f"SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE role <> 'user' AND b.item_id % 10 = c.turn AND ({PAIR_SQL}))")
def join_anti(spark, sf_dir):
    """Rows with a NULL input stay."""
    c, b = talk(spark, sf_dir)
    c = c.withColumn("heard", F.when(F.col("role") != "user", F.col("said")))
    return session(spark, BATCH).join(c, b, "one of them laughs", "heard", "item", how="anti", on=F.col("item_id") % 10 == F.col("turn")).select("conv_id", "turn")


PREFIX_SQL = "(SELECT max(i) FROM range(0, 1000) t(i) WHERE i <= least(strlen(a.source), strlen(b.source)) AND left(a.source, i::INT) = left(b.source, i::INT))::DOUBLE / greatest(strlen(a.source), strlen(b.source))"


@q(f"WITH d AS (SELECT DISTINCT lang, source FROM documents) SELECT a.lang, a.source AS a_source, b.source AS b_source FROM d a, d b WHERE a.lang = b.lang AND a.source < b.source AND {PREFIX_SQL} >= 0.5")
def join_prefix_scorer(spark, sf_dir):
    """A custom scorer on pairs, a frame joined with itself: all distinct sources of each language."""
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    sem = session(spark, SharedPrefixScorer(), threshold=0.5)
    out = sem.join(d, d, "same origin", "source", "source", on=(F.col("l.lang") == F.col("r.lang")) & (F.col("l.source") < F.col("r.source")))
    return out.select("l.lang", F.col("l.source").alias("a_source"), F.col("r.source").alias("b_source"))


@q(f"SELECT a.conv_id, a.turn, b.turn AS next FROM conversations a, conversations b WHERE a.conv_id = b.conv_id AND a.turn < b.turn AND (contains(lower(a.text), '{TOKEN}') OR contains(lower(b.text), '{TOKEN}'))")
def self_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    out = session(spark, BATCH).join(c, c, "one of them laughs", "text", "text", on=(F.col("l.conv_id") == F.col("r.conv_id")) & (F.col("l.turn") < F.col("r.turn")))
    return out.select("l.conv_id", "l.turn", F.col("r.turn").alias("next"))


KEYS_SQL = """
 l AS (SELECT item_id AS l_id, text AS l_text, CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 7 = 0 THEN []::VARCHAR[] ELSE ['k' || item_id % 5, 'm' || item_id % 3, NULL] END AS l_keys FROM benchmark),
 r AS (SELECT conv_id AS r_id, turn, text AS r_text, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE ['k' || conv_id % 11, NULL] END AS r_keys FROM conversations)"""


def keyed(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id as l_id", "text as l_text", "case when item_id % 4 = 0 then null when item_id % 7 = 0 then cast(array() as array<string>) else array('k' || item_id % 5, 'm' || item_id % 3, null) end as l_keys"
    )
    right = table(spark, sf_dir, "conversations").selectExpr("conv_id as r_id", "turn", "text as r_text", "case when conv_id % 9 = 0 then null else array('k' || conv_id % 11, null) end as r_keys")
    return left, right


@q(f"WITH {KEYS_SQL} SELECT l_id, r_id, turn, (l_keys IS NULL OR r_keys IS NULL OR list_has_any(list_filter(l_keys, lambda x: x IS NOT NULL), list_filter(r_keys, lambda x: x IS NOT NULL))) AS o FROM l, r WHERE l_id % 8 = r_id % 8")
def keys_overlap_scalar(spark, sf_dir):
    left, right = keyed(spark, sf_dir)
    return left.join(right, F.col("l_id") % 8 == F.col("r_id") % 8).select("l_id", "r_id", "turn", keys_overlap("l_keys", "r_keys").alias("o"))


KEYED_SQL = f"""WITH {KEYS_SQL} SELECT l_id, r_id, turn FROM l, r WHERE (l_keys IS NULL OR r_keys IS NULL OR list_has_any(list_filter(l_keys, lambda x: x IS NOT NULL), list_filter(r_keys, lambda x: x IS NOT NULL)))
 AND (contains(lower(l_text), 'haha') OR contains(lower(r_text), 'haha'))"""


@q(KEYED_SQL)
def join_keyed(spark, sf_dir):
    left, right = keyed(spark, sf_dir)
    return session(spark).join(left, right, "one of them laughs", "l_text", "r_text", keys=[("l_keys", "r_keys")]).select("l_id", "r_id", "turn")


@q(KEYED_SQL)
def join_keyed_batch_scorer(spark, sf_dir):
    left, right = keyed(spark, sf_dir)
    return session(spark, BATCH).join(left, right, "one of them laughs", "l_text", "r_text", keys=[("l_keys", "r_keys")]).select("l_id", "r_id", "turn")


@q(f"SELECT item_id, conv_id, turn, quality FROM (SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE {PAIR_SQL}) JOIN labels l ON l.doc_id = conv_id WHERE quality = 0")
def reduce_one_side(spark, sf_dir):
    """An ordinary join above a semantic join moves into the input that it restricts."""
    c, b = talk(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("quality = 0")
    tree = query(session(spark, BATCH), b).sem_join(c, "one of them laughs", "item", "said").join(labels, [("conv_id", "doc_id")])
    return tree.frame().select("item_id", "conv_id", "turn", "quality")


@q(f"SELECT item_id, conv_id, turn FROM (SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE {PAIR_SQL}) x WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.conv_id AND l.quality = x.item_id)")
def reduce_two_sides(spark, sf_dir):
    """A join that reads both inputs leaves semi-join reducers on each."""
    c, b = talk(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    tree = query(session(spark, BATCH), b).sem_join(c, "one of them laughs", "item", "said").join(labels, [("conv_id", "doc_id"), ("item_id", "quality")], "left_semi")
    return tree.frame().select("item_id", "conv_id", "turn")


@q(f"SELECT item_id, conv_id, turn, label FROM (SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE {PAIR_SQL}) x JOIN (SELECT DISTINCT nullif(quality, 1) AS label FROM labels) l ON l.label IS NOT DISTINCT FROM nullif(x.item_id % 5, 4)")
def reduce_null_safe(spark, sf_dir):
    """A null-safe join above a semantic join moves into the input that it restricts; NULL meets NULL."""
    c, b = talk(spark, sf_dir)
    b = b.withColumn("k", F.when(F.col("item_id") % 5 != 4, F.col("item_id") % 5))
    labels = table(spark, sf_dir, "labels").select(F.when(F.col("quality") != 1, F.col("quality")).cast("bigint").alias("label")).distinct()
    tree = query(session(spark, BATCH), b).sem_join(c, "one of them laughs", "item", "said").join(labels, [("k", "label")], null_safe=True)
    return tree.frame().select("item_id", "conv_id", "turn", F.col("label").cast("int").alias("label"))


@q(f"SELECT item_id, conv_id, turn FROM conversations c, benchmark b WHERE ({PAIR_SQL}) AND conv_id % 2 = 0 AND item_id > 10")
def volatile_not_moved(spark, sf_dir):
    """Plain conditions go below the semantic join whatever their case; a volatile one that is always true stays above it."""
    c, b = talk(spark, sf_dir)
    tree = query(session(spark, BATCH), b).sem_join(c, "one of them laughs", "item", "said").where("CONV_ID % 2 = 0").where("rand() < 2").where("item_id > 10")
    return tree.frame().select("item_id", "conv_id", "turn")


@q(f"SELECT doc_id, n_chars, {P} AS p FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def topn_deferred(spark, sf_dir):
    """The limit is taken before the decision."""
    sem = session(spark, BATCH)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return query(sem, docs).decide("p", sem.probability("mentions laughter", "text")).top([("n_chars", False), ("doc_id", True)], 100).frame().select("doc_id", "n_chars", "p")


@q("SELECT doc_id, least(len(text) - len(replace(text, '.', '')), 9)::DOUBLE AS s FROM documents ORDER BY s DESC, doc_id LIMIT 50")
def order_by_score(spark, sf_dir):
    sem = session(spark, KeywordScorer(token=TOKEN, mark="."))
    docs = sem.with_decisions(table(spark, sf_dir, "documents"), s=sem.score("how many", "text", list("0123456789")))
    return docs.select("doc_id", "s").orderBy(F.desc("s"), "doc_id").limit(50)


@q("SELECT doc_id FROM documents WHERE CASE WHEN contains(lower(text), 'haha') THEN contains(lower(text), 'thess') ELSE false END")
def cascade_fixed(spark, sf_dir):
    """p = 0.6 or 0.1: the band [0.5, 0.9) goes to the second stage."""
    sem = session(spark, KeywordScorer(TOKEN, 0.6, 0.1), second=KeywordScorer("thess", 1.0, 0.0), cascade_model="second")
    return sem.filter(table(spark, sf_dir, "documents"), "laughs about motion", "text").select("doc_id")


@q("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def cascade_calibrated(spark, sf_dir):
    """The first stage tells nothing (p = 0.5 for all), so calibration sends everything to the second."""
    sem = session(spark, KeywordScorer(TOKEN, 0.5, 0.5), second=KeywordScorer("tion", 1.0, 0.0), cascade_model="second", cascade_calibrate=50)
    return sem.filter(table(spark, sf_dir, "documents"), "about motion", "text").select("doc_id")


@q(f"SELECT c.conv_id, c.turn FROM conversations c WHERE contains(lower((SELECT string_agg(b.text, ' ' ORDER BY b.item_id) FROM benchmark b WHERE b.item_id % 7 = c.turn)), '{TOKEN}')")
def correlated_argument(spark, sf_dir):
    """A correlated subquery as the argument: aggregated and joined first, decided after."""
    c, b = talk(spark, sf_dir)
    per = b.groupBy((F.col("item_id") % 7).alias("k")).agg(F.array_sort(F.collect_list(F.struct("item_id", "item"))).alias("s"))
    rows = c.join(per.select("k", F.concat_ws(" ", "s.item").alias("about")), F.col("turn") == F.col("k"), "left")
    return session(spark, BATCH).filter(rows, "mentions laughter", "about").select("conv_id", "turn")


LABEL = "CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'the') THEN 'the' ELSE 'other' END"


def labelled(spark, sf_dir):
    sem = session(spark)
    return sem.with_decisions(table(spark, sf_dir, "documents"), label=sem.choose("which sound", "text", ["tion", "the", "other"]))


@q(f"SELECT {LABEL} AS label, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def group_by_label(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@q(f"SELECT {LABEL} AS label, lang, count(*) AS n FROM documents GROUP BY ROLLUP (1, 2)")
def rollup_label(spark, sf_dir):
    return labelled(spark, sf_dir).rollup("label", "lang").agg(F.count("*").alias("n"))


@q(f"SELECT doc_id, label, row_number() OVER (PARTITION BY label, lang ORDER BY n_chars DESC, doc_id) AS place FROM (SELECT doc_id, lang, n_chars, {LABEL} AS label FROM documents)")
def window_over_label(spark, sf_dir):
    w = W.partitionBy("label", "lang").orderBy(F.desc("n_chars"), "doc_id")
    return labelled(spark, sf_dir).select("doc_id", "label", F.row_number().over(w).cast("long").alias("place"))


@q(f"SELECT lang FROM documents WHERE {P} >= 0.5 UNION SELECT role FROM conversations WHERE {P} >= 0.5")
def union_decisions(spark, sf_dir):
    sem = session(spark)
    a = sem.filter(table(spark, sf_dir, "documents"), "mentions laughter", "text").select("lang")
    return a.union(sem.filter(table(spark, sf_dir, "conversations"), "mentions laughter", "text").select("role")).distinct()


@q(f"SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING sum(CASE WHEN {P} >= 0.5 THEN 1 ELSE 0 END) * 10 > count(*)")
def sql_functions(spark, sf_dir):
    """The decision functions in plain SQL, here under HAVING."""
    register(spark, SCORER)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sem_documents")
    return spark.sql("SELECT lang, count(*) AS n FROM sem_documents GROUP BY lang HAVING sum(CASE WHEN sem_holds('mentions laughter', text) THEN 1 ELSE 0 END) * 10 > count(*)")


@q(f"SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id % 10 = c.turn AND ({PAIR_SQL}))")
def sql_not_exists(spark, sf_dir):
    register(spark, SCORER)
    for name in ("conversations", "benchmark"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"sem_{name}")
    return spark.sql("SELECT conv_id, turn FROM sem_conversations c WHERE NOT EXISTS (SELECT 1 FROM sem_benchmark b WHERE b.item_id % 10 = c.turn AND sem_holds_pair('one of them laughs', c.text, b.text))")


@q("SELECT page_id, 'image' AS kind, url AS path, 'sem-media-' || sha256(url) AS ref FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages WHERE page_id % 3 = 0")
def media_struct(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("m", media("image", F.when(F.col("page_id") % 3 > 0, F.col("url"))))
    return pages.select("page_id", F.col(f"m.{MARK}").alias("kind"), F.col("m.path").alias("path"), record(pages, "m")[0]["value"].alias("ref"))


@q(f"SELECT 0::BIGINT AS requests, count(DISTINCT text) AS records, 2 * count(*) - count(DISTINCT text) AS cache_hits FROM documents")
def semantic_stats(spark, sf_dir):
    """Two decisions with one identity: every distinct text is one record."""
    sem = session(spark)
    docs = table(spark, sf_dir, "documents")
    sem.with_decisions(docs, p=sem.probability("mentions laughter", "text"), h=sem.holds("mentions laughter", "text"))
    return sem.stats().select("requests", "records", "cache_hits")


@q("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_extendedprice) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2")
def ordinary_join_aggregate(spark, sf_dir):
    """The operators that decisions compose with: pushdown, hash join, aggregate."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_extendedprice").alias("most"))


@q("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def ordinary_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@q(f"WITH laughing AS (SELECT doc_id, lang FROM documents WHERE {P} >= 0.5), longest AS (SELECT lang, max(doc_id) AS last FROM laughing GROUP BY lang) SELECT l.lang, count(*) AS n, any_value(last) AS last FROM laughing l JOIN longest USING (lang) GROUP BY l.lang")
def cte_decision(spark, sf_dir):
    """A common table expression with a decision, read twice."""
    register(spark, SCORER)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sem_documents")
    return spark.sql(
        "WITH laughing AS (SELECT doc_id, lang FROM sem_documents WHERE sem_holds('mentions laughter', text)), longest AS (SELECT lang, max(doc_id) AS last FROM laughing GROUP BY lang) "
        "SELECT l.lang, count(*) AS n, any_value(last) AS last FROM laughing l JOIN longest USING (lang) GROUP BY l.lang"
    )


@q(f"SELECT doc_id, n_chars, {P} AS p FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 7")
def topn_offset(spark, sf_dir):
    """With an offset the limit isn't moved below the decision; the rows are the same."""
    sem = session(spark, BATCH)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return query(sem, docs).decide("p", sem.probability("mentions laughter", "text")).top([("n_chars", False), ("doc_id", True)], 30, 7).frame().select("doc_id", "n_chars", "p")


@q(f"SELECT lang FROM documents WHERE {P} >= 0.5 INTERSECT SELECT lang FROM documents WHERE NOT ({P} >= 0.5)")
def intersect_decisions(spark, sf_dir):
    sem = session(spark)
    docs = sem.with_decisions(table(spark, sf_dir, "documents"), h=sem.holds("mentions laughter", "text"))
    return docs.where("h").select("lang").intersect(docs.where("not h").select("lang"))


@q(f"SELECT {LABEL} AS label, lang, count(*) AS n FROM documents GROUP BY CUBE (1, 2)")
def cube_label(spark, sf_dir):
    return labelled(spark, sf_dir).cube("label", "lang").agg(F.count("*").alias("n"))


@q(f"SELECT {LABEL} AS label, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((1), (2), ())")
def grouping_sets_label(spark, sf_dir):
    return labelled(spark, sf_dir).groupingSets([[F.col("label")], [F.col("lang")], []], "label", "lang").agg(F.count("*").alias("n")).select("label", "lang", "n")


@q(f"SELECT id, CASE WHEN text IS NOT NULL THEN CASE WHEN contains(lower(text), '{TOKEN}') THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END END AS p FROM (VALUES (1, 'ha HAHA'), (2, 'no'), (3, NULL)) v(id, text) UNION ALL SELECT i::INT, 0.1::DOUBLE FROM range(10, 15) r(i)")
def values_and_range(spark, sf_dir):
    """Decisions over constant rows and a generated range."""
    sem = session(spark, BATCH)
    rows = spark.sql("SELECT * FROM VALUES (1, 'ha HAHA'), (2, 'no'), (3, NULL) AS v(id, text)").union(spark.range(10, 15).selectExpr("cast(id as int) as id", "concat('row ', id) as text"))
    return sem.with_decisions(rows, p=sem.probability("mentions laughter", "text")).select("id", "p")


TWO_KEYS_SQL = KEYS_SQL.replace("AS l_keys FROM", "AS l_keys, CASE WHEN item_id % 6 = 0 THEN NULL ELSE ['t' || item_id % 3] END AS l_more FROM").replace(
    "AS r_keys FROM", "AS r_keys, ['t' || turn % 3, NULL] AS r_more FROM"
)
OVERLAP_SQL = "({0} IS NULL OR {1} IS NULL OR list_has_any(list_filter({0}, lambda x: x IS NOT NULL), list_filter({1}, lambda x: x IS NOT NULL)))"


@q(f"WITH {TWO_KEYS_SQL} SELECT l_id, r_id, turn FROM l, r WHERE {OVERLAP_SQL.format('l_keys', 'r_keys')} AND {OVERLAP_SQL.format('l_more', 'r_more')} AND (contains(lower(l_text), 'haha') OR contains(lower(r_text), 'haha'))")
def join_two_key_lists(spark, sf_dir):
    left, right = keyed(spark, sf_dir)
    left = left.withColumn("l_more", F.when(F.col("l_id") % 6 != 0, F.array(F.concat(F.lit("t"), (F.col("l_id") % 3).cast("string")))))
    right = right.withColumn("r_more", F.array(F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")), F.lit(None).cast("string")))
    return session(spark, BATCH).join(left, right, "one of them laughs", "l_text", "r_text", keys=[("l_keys", "r_keys"), ("l_more", "r_more")]).select("l_id", "r_id", "turn")


@q(f"SELECT lang, count(*) FILTER ({P} >= 0.05) AS low, count(*) FILTER ({P} >= 0.5) AS middle, count(*) FILTER ({P} >= 0.95) AS high FROM documents GROUP BY lang")
def sql_thresholds(spark, sf_dir):
    """Options of a call in SQL."""
    register(spark, SCORER)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sem_documents")
    at = lambda t: f"count_if(sem_holds('mentions laughter', text, map('threshold', '{t}')))"
    return spark.sql(f"SELECT lang, {at(0.05)} AS low, count_if(sem_holds('mentions laughter', text)) AS middle, {at(0.95)} AS high FROM sem_documents GROUP BY lang")


@q(
    "WITH k AS (SELECT count(DISTINCT text) AS n FROM conversations), b AS (SELECT count(DISTINCT text) AS m FROM benchmark), x AS (SELECT count(*) AS c FROM conversations), y AS (SELECT count(*) AS d FROM benchmark) "
    "SELECT n * m AS pairs, c * d - n * m AS cache_hits, c * d AS cross_product_pairs, 0::BIGINT AS requests FROM k, b, x, y"
)
def join_stats(spark, sf_dir):
    """The counters of an unkeyed join, without its product."""
    c, b = talk(spark, sf_dir)
    sem = session(spark)
    sem.join(c, b, "one of them laughs", "said", "item")
    return sem.stats().select("pairs", "cache_hits", "cross_product_pairs", "requests")


INDEX_SQL = f"WITH {KEYS_SQL}, o AS (SELECT l_text, r_text FROM l, r WHERE {OVERLAP_SQL.format('l_keys', 'r_keys')})"


@q(f"{INDEX_SQL} SELECT (SELECT count(*) FROM l) AS candidate_left_rows, (SELECT count(*) FROM r) AS candidate_right_rows, (SELECT count(*) FROM o) AS index_candidate_pairs, (SELECT count(*) FROM (SELECT DISTINCT l_text, r_text FROM o)) AS pairs, 0::BIGINT AS cross_product_pairs")
def keyed_join_stats(spark, sf_dir):
    """The counters of a keyed join."""
    left, right = keyed(spark, sf_dir)
    sem = session(spark)
    sem.join(left, right, "one of them laughs", "l_text", "r_text", keys=[("l_keys", "r_keys")])
    return sem.stats().select("candidate_left_rows", "candidate_right_rows", "index_candidate_pairs", "pairs", "cross_product_pairs")

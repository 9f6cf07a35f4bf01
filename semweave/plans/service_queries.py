"""Registered queries over HTTP scorers: a deterministic service that runs inside the workers, so no network is needed.

The service sees the bodies that would be sent and answers in the wire format; what it is asked, in how many requests, and
what happens to failed ones, can be compared with plain SQL.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F

from semweave.plans.queries import ORACLES, PAIR_SQL, QUERIES, TOKEN, P, Query, session, table, talk
from semweave.sources.http_scorers import ChatScorer, DecisionScorer

NO_HEADERS: dict[str, str] = {}
#: Bodies that this worker has seen, for the service that is busy at first.
_seen: set[bytes] = set()


def q(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def laughs(texts: list[str]) -> bool:
    return any(TOKEN in t.lower() for t in texts)


def answer(asked: dict[str, Any], shared: list[str]) -> dict[str, Any]:
    """One typed question of the decision service."""
    own = asked["instructions"]
    texts = shared + ([v for k, v in own.items() if k != "question"] if isinstance(own, dict) else [])
    if asked["type"] == "choice":
        labels = list(asked["criteria"])
        return {"choice": next((x for x in labels if any(x in t for t in texts)), labels[-1])}
    if asked["type"] == "score":
        return {"score": min(sum(t.count("!") for t in texts), len(asked["criteria"]) - 1)}
    return {"noul": 0.9 if laughs(texts) else 0.1}


def decisions(body: bytes, headers: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
    asked = json.loads(body)
    shared = [v for k, v in asked["state"].items() if k != "condition"]
    answers = {k: answer(x, shared) for k, x in asked["questions"].items()}
    return 200, json.dumps({"answers": answers, "usage": {"input_tokens": 10 * len(answers)}}).encode(), NO_HEADERS


def busy_at_first(body: bytes, headers: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
    """503 to the first try of every body."""
    if body not in _seen:
        _seen.add(body)
        return 503, b"", NO_HEADERS
    _seen.discard(body)
    return decisions(body, headers)


def refusing(body: bytes, headers: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
    """400 to a request with a German text; with one question a request, only those are lost."""
    return (400, b"", NO_HEADERS) if b'"lang": "de"' in body else decisions(body, headers)


def chat(body: bytes, headers: dict[str, str]) -> tuple[int, bytes, dict[str, str]]:
    """Answers by the schema that is asked for: labels, verdicts, numbered ones last to first."""
    asked = json.loads(body)
    content = json.loads(asked["messages"][1]["content"])
    kind = asked["response_format"]["json_schema"]["schema"]["properties"]["answers"]["items"]
    out: list[Any] = []
    for item in content["items"]:
        texts = [f["value"] for f in item["fields"]] if "fields" in item else [item["left"], item["right"]]
        if kind["type"] == "object":
            out.insert(0, {"id": item["id"], "verdict": laughs(texts)})
        elif kind["type"] == "boolean":
            out.append(laughs(texts))
        elif "enum" in kind:
            out.append(next((x for x in kind["enum"] if any(x in t for t in texts)), kind["enum"][-1]))
        else:
            out.append(0.9 if laughs(texts) else 0.1)
    reply = {"choices": [{"message": {"content": json.dumps({"answers": out})}}], "usage": {"prompt_tokens": 5}}
    return 200, json.dumps(reply).encode(), NO_HEADERS


def service(post=decisions, kind=DecisionScorer):
    return kind("http://service.invalid", "m", post=post)


@q(f"SELECT conv_id, turn, {P} AS p, {P} >= 0.5 AS h FROM conversations")
def service_records(spark, sf_dir):
    sem = session(spark, service())
    c = table(spark, sf_dir, "conversations")
    return sem.with_decisions(c, p=sem.probability("mentions laughter", "text"), h=sem.holds("mentions laughter", "text")).select("conv_id", "turn", "p", "h")


@q("SELECT ceil(count(DISTINCT text) / 50.0)::BIGINT AS requests, count(DISTINCT text) AS records, 10 * count(DISTINCT text) AS input_tokens, 0::BIGINT AS errors, 0::BIGINT AS retries FROM conversations")
def service_requests(spark, sf_dir):
    """50 questions a request, over one connection."""
    sem = session(spark, service(), k=50, threads=1)
    sem.filter(table(spark, sf_dir, "conversations"), "mentions laughter", "text")
    return sem.stats().select("requests", "records", "input_tokens", "errors", "retries")


@q("SELECT ceil(count(DISTINCT text) / 50.0)::BIGINT AS requests, ceil(count(DISTINCT text) / 50.0)::BIGINT AS retries, count(DISTINCT text) AS records FROM conversations")
def service_retries(spark, sf_dir):
    """Every request is refused once and sent again."""
    sem = session(spark, service(busy_at_first), k=50, threads=1, retry_max_delay=0.01)
    sem.filter(table(spark, sf_dir, "conversations"), "mentions laughter", "text")
    return sem.stats().select("requests", "retries", "records")


@q(f"SELECT doc_id, CASE WHEN lang <> 'de' THEN {P} END AS p, CASE WHEN lang = 'de' THEN false ELSE {P} >= 0.5 END AS h FROM documents")
def service_rejects(spark, sf_dir):
    """A rejected question has no probability and doesn't hold."""
    sem = session(spark, service(refusing), layout="sep", on_error="reject")
    docs = table(spark, sf_dir, "documents").withColumn("r", F.struct("lang", "text"))
    return sem.with_decisions(docs, p=sem.probability("mentions laughter", "r"), h=sem.holds("mentions laughter", "r")).select("doc_id", "p", "h")


def pairs_by(spark, sf_dir, **settings):
    c, b = talk(spark, sf_dir)
    out = session(spark, service(), **settings).join(c, b, "one of them laughs", "said", "item", on=F.col("item_id") % 10 == F.col("turn"))
    return out.select("conv_id", "turn", "item_id")


PAIRS = f"SELECT c.conv_id, c.turn, b.item_id FROM conversations c, benchmark b WHERE b.item_id % 10 = c.turn AND ({PAIR_SQL})"


@q(PAIRS)
def service_pairs_pack(spark, sf_dir):
    return pairs_by(spark, sf_dir, layout="pack")


@q(PAIRS)
def service_pairs_star(spark, sf_dir):
    return pairs_by(spark, sf_dir, layout="star", anchor="right")


@q(PAIRS)
def service_pairs_auto(spark, sf_dir):
    return pairs_by(spark, sf_dir)


@q("SELECT conv_id, turn, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'the') THEN 'the' ELSE 'other' END AS label FROM conversations")
def service_chat_choice(spark, sf_dir):
    sem = session(spark, service(chat, ChatScorer))
    return sem.with_decisions(table(spark, sf_dir, "conversations"), label=sem.choose("which sound", "text", ["tion", "the", "other"])).select("conv_id", "turn", "label")


@q(f"SELECT conv_id, turn FROM conversations WHERE contains(lower(text), '{TOKEN}')")
def service_cascade(spark, sf_dir):
    """Both stages are services: p = 0.9 or 0.1, the band [0.05, 0.95) takes all to the second, which numbers its answers."""
    sem = session(spark, service(), second=service(chat, ChatScorer), cascade_model="second", cascade_low=0.05, cascade_high=0.95)
    return sem.filter(table(spark, sf_dir, "conversations"), "mentions laughter", "text").select("conv_id", "turn")


@q(
    "WITH n AS (SELECT count(DISTINCT text) AS n FROM conversations) SELECT n AS band_items, n AS cascade_items, ceil(n / 16.0)::BIGINT AS cascade_requests, 5 * ceil(n / 16.0)::BIGINT AS cascade_input_tokens, "
    "0.05::DOUBLE AS cascade_last_low, 0.95::DOUBLE AS cascade_last_high FROM n"
)
def service_cascade_stats(spark, sf_dir):
    sem = session(spark, service(), second=service(chat, ChatScorer), cascade_model="second", cascade_low=0.05, cascade_high=0.95, threads=1, cascade_threads=1)
    sem.filter(table(spark, sf_dir, "conversations"), "mentions laughter", "text")
    return sem.stats().select("band_items", "cascade_items", "cascade_requests", "cascade_input_tokens", "cascade_last_low", "cascade_last_high")

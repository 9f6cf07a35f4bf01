"""Scorers behind HTTP: a decision service, and a chat service with strict JSON answers.

Both are batch scorers with a plan of their own: distinct questions are dealt to ``threads`` tasks (a star by its anchor),
each task cuts its questions into requests and posts them one after another over a kept connection. Failed requests abort
the query, or under ``on_error='reject'`` leave their questions without an answer. Credentials come from a callable or
an environment variable that is read on the executors; they are in no plan, setting or log.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.config import SemConfig
from semweave.decision import CHOICE, SCORE, Decision
from semweave.operators.judge import PAIR, AnswerError, checked
from semweave.sources.batching import Batch, choose_anchor, choose_layout, cut, even_batches, pair_batches, question_bytes, record_batches
from semweave.sources.images import attach, budget_of
from semweave.sources.transport import Client, Reply, post_with_retries


#: Connections that a worker keeps between batches, the last one used at the end.
CLIENTS = 8
_clients: dict[tuple, Client] = {}


def client_of(endpoint: str, timeout: float, ca: str) -> tuple[Client, int]:
    """The worker's connection to an endpoint, and 1 if it is new."""
    key = (endpoint, timeout, ca)
    known = _clients.pop(key, None)
    _clients[key] = known or Client(endpoint, timeout, ca)
    if len(_clients) > CLIENTS:
        del _clients[next(iter(_clients))]
    return _clients[key], int(known is None)


def env_key(name: str) -> Callable[[], str | None]:
    return lambda: os.environ.get(name)


@dataclass(frozen=True)
class HttpScorer:
    """What both services have in common."""

    endpoint: str
    model: str = ""
    key: Callable[[], str | None] = field(default=lambda: None, repr=False, compare=False)
    #: References of images -> local paths, for inputs that hold media.
    images: dict[str, str] = field(default_factory=dict, compare=False)
    post: Callable[..., Any] | None = field(default=None, repr=False, compare=False)

    kind = "http"

    @property
    def identity(self) -> tuple:
        return (self.kind, self.endpoint, self.model)

    # --- planning ---------------------------------------------------------------------------------------------------
    def plan(self, inputs: Any, decision: Decision, config: SemConfig, second: bool):
        """The inputs, dealt to tasks, the function that answers a task's questions, and the text whose questions the task has
        to gather. Pairs that are ``GroupedPairs`` are dealt by texts of their large side; a star on the other gathers them."""
        threads = config.cascade_threads if second else config.threads
        whole = isinstance(inputs, DataFrame)
        how = {"layout": "pack", "anchor": config.anchor}
        if decision.pairwise and not second:
            left, right = PAIR
            if config.layout == "auto" or (config.layout == "star" and config.anchor == "auto"):
                r = inputs.sizes() if not whole else inputs.agg(
                    F.count(F.lit(1)).alias("n"), F.countDistinct(left).alias("l"), F.countDistinct(right).alias("r"), F.sum(F.octet_length(left)).alias("lb"), F.sum(F.octet_length(right)).alias("rb")
                ).first()
                how["layout"] = choose_layout(config.layout, r["n"], r["l"], r["r"], config.auto_min_group)
                how["anchor"] = choose_anchor(config.anchor, r["l"], r["r"], r["lb"] or 0, r["rb"] or 0)
            else:
                how["layout"] = config.layout
            side = left if how["anchor"] == "left" else right
            if not whole:
                together = side if how["layout"] == "star" and how["anchor"] == inputs.small else None
                return inputs.dealt(threads), self.answerer(decision, config, how, second), together
            if how["layout"] == "star":
                return inputs.repartition(threads, side).sortWithinPartitions(side), self.answerer(decision, config, how, second), None
        else:
            how["layout"] = config.layout
        return inputs.repartition(threads), self.answerer(decision, config, how, second), None

    def answerer(self, decision: Decision, config: SemConfig, how: dict, second: bool):
        scorer = self

        def answer(asked: list[Any], n: str) -> list[dict]:
            out: list[dict | None] = [None] * len(asked)
            ca, timeout = (config.cascade_ca_cert_file, config.cascade_timeout) if second else (config.ca_cert_file, config.timeout)
            client, created = client_of(scorer.endpoint, timeout, ca)
            for b, batch in enumerate(scorer.batches(decision, asked, config, how, second)):
                body = json.dumps(scorer.body(decision, asked, batch, config, second), ensure_ascii=False).encode()
                reply = scorer.send(client, body, config)
                try:
                    values, tokens = scorer.read(decision, reply, len(batch.items), config, second)
                except AnswerError:
                    if config.on_error == "error" or decision.mode in (CHOICE, SCORE) or reply.status == 200 and scorer.strict:
                        raise
                    values, tokens = [None] * len(batch.items), 0
                if config.raw_dump_path:
                    dump(config.raw_dump_path, {"request": json.loads(body), "status": reply.status, "response": reply.body.decode("utf-8", "replace")})
                for i, value in zip(batch.items, values, strict=True):
                    out[i] = checked(decision, value, second) | {"batch": f"{n}-{b}", "tokens": tokens, "retries": reply.retries, "micros": reply.micros, "sends": reply.sent, "clients": created, "reuses": 1 - created}
                    if config.dump_path and not second:
                        dump(config.dump_path, {"question": asked[i], "answer": value})
                created = 0
            return out  # type: ignore[return-value]

        return answer

    def weigh(self, text: str) -> int:
        """Bytes of the images that a text refers to."""
        return budget_of(text, self.images) if self.images else 0

    def send(self, client: Client, body: bytes, config: SemConfig) -> Reply:
        key = self.key()
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        once = (lambda: self.post(body, headers)) if self.post else (lambda: client.post(self.path, body, headers))
        return post_with_retries(once, max_retries=config.max_retries, max_delay=config.retry_max_delay, after_max=config.retry_after_max)


@dataclass(frozen=True)
class DecisionScorer(HttpScorer):
    """One typed question an input; answers by question id."""

    path: str = "/decisions"
    strict = False
    kind = "decision"

    def batches(self, decision: Decision, asked: list[Any], config: SemConfig, how: dict, second: bool) -> list[Batch]:
        if decision.pairwise:
            return pair_batches(asked, layout=how["layout"], anchor=how["anchor"], k=config.k, budget=config.budget_tokens, auto_min_group=config.auto_min_group, more=self.weigh)
        criteria = len(json.dumps(decision.criteria)) if decision.criteria else 0
        return record_batches(asked, layout=how["layout"], k=config.k, budget=config.budget_tokens, criteria=criteria, more=self.weigh)

    def body(self, decision: Decision, asked: list[Any], batch: Batch, config: SemConfig, second: bool) -> dict:
        state: dict[str, Any] = {"condition": decision.condition}
        questions = {}
        for n, i in enumerate(batch.items):
            question: dict[str, Any] = {"type": decision.kind}
            # fixed texts of the protocol
            text = "Does the condition hold?" if decision.kind == "noul" else "Which answer fits the condition?"
            if decision.pairwise:
                left, right = asked[i]
                if batch.shared == "both":
                    state |= {"left": left, "right": right}
                    question["instructions"] = text
                else:
                    own = {"left": left, "right": right}
                    if batch.shared:
                        state[batch.shared] = own.pop(batch.shared)
                    question["instructions"] = own | {"question": text}
            else:
                question["instructions"] = dict(asked[i]) | {"question": text}
            if decision.mode == CHOICE:
                question["criteria"] = {label: about or label for label, about in decision.criteria}
            elif decision.mode == SCORE:
                question["criteria"] = [json.loads(level) for level in decision.criteria]
            questions[f"p{n}"] = question
        body = {"model": config.model or self.model, "state": state, "questions": questions}
        return attach(body, self.images) if self.images else body

    def read(self, decision: Decision, reply: Reply, n: int, config: SemConfig, second: bool) -> tuple[list[Any], int]:
        if reply.status != 200:
            raise AnswerError(f"the service answered {reply.status}")
        try:
            found = json.loads(reply.body)
            answers, tokens = found["answers"], int(found.get("usage", {}).get("input_tokens", 0))
        except (ValueError, KeyError, TypeError, AttributeError):
            raise AnswerError("malformed response") from None
        values = [(answers.get(f"p{i}") or {}).get(decision.kind) for i in range(n)]
        if any(v is None for v in values) and config.on_error == "error":
            raise AnswerError("an answer is missing")
        for v in values:
            if v is not None:
                checked(decision, v)
        return values, tokens


@dataclass(frozen=True)
class ChatScorer(HttpScorer):
    """All questions of a request in one message; the answer is one JSON text under a strict schema."""

    path: str = "/chat/completions"
    strict = True
    kind = "chat"

    def batches(self, decision: Decision, asked: list[Any], config: SemConfig, how: dict, second: bool) -> list[Batch]:
        if second:
            size = even_batches(len(asked), config.cascade_batch_size, config.cascade_threads, config.cascade_fill_batches)
            return [Batch(tuple(range(i, min(i + size, len(asked))))) for i in range(0, len(asked), size)]
        k = 1 if config.layout == "sep" else config.k
        return [Batch(b) for b in cut(range(len(asked)), lambda i: question_bytes(asked[i]), k, config.budget_tokens, len(decision.condition.encode()))]

    @staticmethod
    def numbered(config: SemConfig, second: bool) -> bool:
        return second and config.cascade_numbered

    def item_schema(self, decision: Decision, config: SemConfig, second: bool) -> dict:
        if second:
            verdict = {"type": "boolean"}
            if not self.numbered(config, second):
                return verdict
            return {"type": "object", "properties": {"id": {"type": "integer"}, "verdict": verdict}, "required": ["id", "verdict"], "additionalProperties": False}
        if decision.mode == CHOICE:
            return {"type": "string", "enum": list(decision.labels)}
        top = len(decision.criteria) - 1 if decision.mode == SCORE else 1
        return {"type": "number", "minimum": 0, "maximum": top}

    def body(self, decision: Decision, asked: list[Any], batch: Batch, config: SemConfig, second: bool) -> dict:
        items = []
        for n, i in enumerate(batch.items):
            item: dict[str, Any] = {"id": n if self.numbered(config, second) else f"p{n}"}
            item |= {"left": asked[i][0], "right": asked[i][1]} if decision.pairwise else {"fields": [{"name": a, "value": b} for a, b in asked[i]]}
            items.append(item)
        content: dict[str, Any] = {"condition": decision.condition, "items": items}
        if decision.mode == CHOICE:
            content["criteria"] = {label: about or label for label, about in decision.criteria}
        elif decision.mode == SCORE:
            content["criteria"] = [json.loads(level) for level in decision.criteria]
        answers = {"type": "array", "items": self.item_schema(decision, config, second), "minItems": len(items), "maxItems": len(items)}
        schema = {"type": "object", "properties": {"answers": answers}, "required": ["answers"], "additionalProperties": False}
        model = (config.cascade_model or self.model) if second else (config.model or self.model)
        return {
            "model": model,
            "messages": [{"role": "system", "content": "Judge every item by the condition. Reply with JSON only, one answer an item, in order."}, {"role": "user", "content": json.dumps(content, ensure_ascii=False)}],
            "response_format": {"type": "json_schema", "json_schema": {"name": "answers", "strict": True, "schema": schema}},
        }

    def read(self, decision: Decision, reply: Reply, n: int, config: SemConfig, second: bool) -> tuple[list[Any], int]:
        if reply.status != 200:
            raise AnswerError(f"the service answered {reply.status}")
        try:
            found = json.loads(reply.body)
            answers = json.loads(found["choices"][0]["message"]["content"])["answers"]
            tokens = int(found.get("usage", {}).get("prompt_tokens", 0))
        except (ValueError, KeyError, IndexError, TypeError):
            raise AnswerError("malformed response") from None
        if not isinstance(answers, list) or len(answers) != n:
            raise AnswerError(f"{len(answers) if isinstance(answers, list) else 'no'} answers to {n} items")
        if self.numbered(config, second):
            answers = in_order(answers, n)
        for a in answers:
            if a is None:
                raise AnswerError("an answer is missing")
            checked(decision, a, second)
        return answers, tokens


def in_order(answers: list[Any], n: int) -> list[Any]:
    """Verdicts of numbered answers: each integer id from 0 to n - 1 exactly once."""
    out: dict[int, Any] = {}
    for a in answers:
        i = a.get("id") if isinstance(a, dict) else None
        if isinstance(i, bool) or not isinstance(i, int) or not 0 <= i < n or i in out or "verdict" not in a:
            raise AnswerError("answers must be numbered 0 to n - 1, each once")
        out[i] = a["verdict"]
    return [out[i] for i in range(n)]


def dump(path: str, line: dict) -> None:
    """Append a JSON line; on a cluster every executor has its own file of this name."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(line, ensure_ascii=False) + "\n")

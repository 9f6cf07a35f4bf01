"""Batching, retries, wire formats and validation, with a local service."""

import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from semweave import decision as D
from semweave.config import SemConfig
from semweave.functions.media import media
from semweave.operators.judge import AnswerError
from semweave.session import connect
from semweave.sources import images
from semweave.sources.batching import choose_anchor, choose_layout, even_batches, pair_batches, record_batches
from semweave.sources.http_scorers import ChatScorer, DecisionScorer, in_order
from semweave.sources.transport import Interrupted, post_with_retries, retry_after


def judge_text(kind, text, criteria):
    if kind == "choice":
        labels = list(criteria)
        return next((x for x in labels if x in text), labels[-1])
    if kind == "score":
        return min(text.count("!"), len(criteria) - 1)
    return 0.9 if "good" in text.lower() else 0.1


class Service(BaseHTTPRequestHandler):
    seen: list = []
    faults: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, body, dict(self.headers)))
        status = Service.faults.pop(0) if Service.faults else 200
        reply = {}
        if status == 200 and "questions" in body:
            state = " ".join(v for k, v in body["state"].items() if k != "condition")
            reply = {"answers": {k: {v["type"]: judge_text(v["type"], state + json.dumps(v["instructions"]), v.get("criteria"))} for k, v in body["questions"].items()}, "usage": {"input_tokens": 10}}
        elif status == 200:
            asked = json.loads(body["messages"][1]["content"])
            items = body["response_format"]["json_schema"]["schema"]["properties"]["answers"]["items"]
            answers = []
            for item in asked["items"]:
                text = json.dumps({k: v for k, v in item.items() if k != "id"})
                if items.get("type") == "object":
                    answers.insert(0, {"id": item["id"], "verdict": "good" in text})
                elif items.get("type") == "boolean":
                    answers.append("good" in text)
                else:
                    answers.append(judge_text("choice" if "enum" in items else "score" if items["maximum"] > 1 else "noul", text, asked.get("criteria")))
            reply = {"choices": [{"message": {"content": json.dumps({"answers": answers})}}], "usage": {"prompt_tokens": 7}}
        data = json.dumps(reply).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen, Service.faults = [], []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame([(1, "good film!"), (2, "bad film"), (3, "good film!"), (4, None), (5, "plot!!")], "id int, review string")


@pytest.mark.parametrize("kind", [DecisionScorer, ChatScorer])
def test_all_functions(spark, service, reviews, kind):
    sem = connect(spark, scorer=kind(service, "m", key=lambda: "k"), threads=2)
    with sem.run():
        out = sem.with_decisions(
            reviews, h=sem.holds("q", "review"), p=sem.probability("q", "review"), c=sem.choose("q", "review", {"film": "a film", "plot": "a plot"}), s=sem.score("q", "review", ["a", "b", "c"])
        )
        got = {r["id"]: (r["h"], r["p"], r["c"], r["s"]) for r in out.collect()}
        assert got == {1: (True, 0.9, "film", 1.0), 2: (False, 0.1, "film", 0.0), 3: (True, 0.9, "film", 1.0), 4: (None,) * 4, 5: (False, 0.1, "plot", 2.0)}
        found = sem.stats().first()
        assert found["records"] == 9 and found["requests"] == len(Service.seen) and found["input_tokens"] == len(Service.seen) * (10 if kind is DecisionScorer else 7)
    assert all(h["Authorization"] == "Bearer k" for _, _, h in Service.seen)


@pytest.mark.parametrize("layout", ["auto", "star", "pack", "sep"])
def test_pair_layouts_agree(spark, service, layout):
    a = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} {i}") for i in range(6)], "id int, t string")
    b = spark.createDataFrame([(i, f"other {i}") for i in range(3)], "bid int, u string")
    sem = connect(spark, scorer=DecisionScorer(service), layout=layout, threads=2, k=4, auto_min_group=2)
    assert sorted((r["id"], r["bid"]) for r in sem.join(a, b, "p", "t", "u").collect()) == [(i, j) for i in (1, 3, 5) for j in range(3)]
    sizes = [len(x["questions"]) for _, x, _ in Service.seen]
    assert sum(sizes) == 18 and max(sizes) <= (1 if layout == "sep" else 4)
    anchored = ["left" in x["state"] or "right" in x["state"] for _, x, _ in Service.seen]
    assert all(anchored) == (layout != "pack")


def test_second_stage(spark, service, reviews):
    for numbered in (True, False):
        sem = connect(spark, scorer=DecisionScorer(service), second=ChatScorer(service), cascade_model="big", cascade_low=0.0, cascade_high=0.95, cascade_numbered=numbered, threads=1, cascade_threads=1)
        assert sorted(r["id"] for r in sem.filter(reviews, "p", "review").collect()) == [1, 3]
        assert Service.seen[-1][1]["model"] == "big"


def test_errors(spark, service, reviews):
    Service.faults = [503, 429]
    sem = connect(spark, scorer=DecisionScorer(service), threads=1, retry_max_delay=0.01)
    with sem.run():
        assert sem.filter(reviews, "p", "review").count() == 2
        assert sem.stats().first()["retries"] == 2
    Service.faults = [401]
    with pytest.raises(Exception, match="401"):
        connect(spark, scorer=DecisionScorer(service), threads=1).filter(reviews, "p", "review").collect()
    Service.faults = [400]
    sem = connect(spark, scorer=DecisionScorer(service), threads=1, on_error="reject")
    assert [r["p"] for r in sem.with_decisions(reviews, p=sem.probability("p", "review")).collect()] == [None] * 5


def test_dumps(spark, service, reviews, tmp_path):
    sem = connect(spark, scorer=DecisionScorer(service), threads=1, dump_path=f"{tmp_path}/d.jsonl", raw_dump_path=f"{tmp_path}/r.jsonl")
    sem.filter(reviews, "p", "review").collect()
    assert len((tmp_path / "d.jsonl").read_text().splitlines()) == 3 and len((tmp_path / "r.jsonl").read_text().splitlines()) == 1


def test_batches():
    pairs = [(f"l{i % 3}", f"r{i}") for i in range(30)]
    star = pair_batches(pairs, layout="auto", anchor="auto", k=4, budget=50_000, auto_min_group=8)
    assert all(b.shared == "left" and len({pairs[i][0] for i in b.items}) == 1 and len(b.items) <= 4 for b in star)
    assert sorted(i for b in star for i in b.items) == list(range(30))
    assert [len(b.items) for b in pair_batches(pairs, layout="pack", anchor="auto", k=12, budget=50_000, auto_min_group=8)] == [12, 12, 6]
    assert [len(b.items) for b in record_batches([[("f", "x" * 35)]] * 5, layout="pack", k=100, budget=22, criteria=0)] == [2, 2, 1]
    assert [b.items for b in record_batches([[("f", "x" * 9000)]] * 2, layout="pack", k=100, budget=1, criteria=0)] == [(0,), (1,)]
    assert pair_batches([], layout="auto", anchor="auto", k=1, budget=1, auto_min_group=1) == []
    assert choose_layout("auto", 16, 2, 9, 8) == "star" and choose_layout("auto", 15, 2, 9, 8) == "pack"
    assert choose_anchor("auto", 2, 2, 5, 4) == "left" and choose_anchor("auto", 2, 2, 4, 5) == "right" and choose_anchor("auto", 3, 2, 9, 1) == "right"
    assert even_batches(10, 16, 4, False) == 3 and even_batches(10, 16, 4, True) == 16 and even_batches(3, 16, 4, False) == 16


def test_retry_waits():
    now = [0.0]
    waits = []

    def sleep(s):
        now[0] += s

    def run(replies, **more):
        now[0] = 0.0
        calls = iter(replies)

        def send():
            x = next(calls)
            waits.append(now[0])
            if isinstance(x, Exception):
                raise x
            return x

        return post_with_retries(send, **{"max_retries": 7, "max_delay": 60, "after_max": 300, "sleep": sleep, "clock": lambda: now[0], "rng": lambda: 0.0} | more)

    r = run([(503, b"", {}), ConnectionError(), (429, b"", {"retry-after": "9"}), (200, b"ok", {})])
    assert (r.status, r.retries) == (200, 3) and [round(w) for w in waits] == [0, 1, 3, 12]
    assert run([(500, b"", {})] * 3, max_retries=2).status == 500
    assert run([(400, b"", {})]).retries == 0
    with pytest.raises(ConnectionError):
        run([ConnectionError()] * 2, max_retries=1)
    with pytest.raises(Interrupted):
        run([(503, b"", {})] * 2, stopped=lambda: True)
    assert retry_after("Thu, 01 Jan 1970 00:00:30 GMT", 10) == 20 and retry_after("x", 0) is None and retry_after(None, 0) is None


@pytest.mark.parametrize("bad", [[{"id": 0, "verdict": True}] * 2, [{"id": 0, "verdict": True}, {"id": 2, "verdict": True}], [{"id": -1, "verdict": True}, {"id": 0, "verdict": True}], [{"id": "0", "verdict": True}, {"id": 1, "verdict": True}], [{"id": True, "verdict": True}, {"id": 0, "verdict": True}], [{"id": 0.5, "verdict": True}, {"id": 1, "verdict": True}], [{"verdict": True}, {"id": 1, "verdict": True}], [None, {"id": 1, "verdict": True}]])
def test_numbered_answers(bad):
    assert in_order([{"id": 1, "verdict": False}, {"id": 0, "verdict": True}], 2) == [True, False]
    with pytest.raises(AnswerError):
        in_order(bad, 2)


def png(path, width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\xff\x00\x00" * width for _ in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    return str(path)


def test_images(spark, service, tmp_path):
    red = png(tmp_path / "red.png", 280, 280)
    assert (images.load(red).width, images.load(red).format) == (280, "png")
    (tmp_path / "text.png").write_bytes(b"hello")
    for bad in (str(tmp_path / "text.png"), png(tmp_path / "small.png", 256, 256), png(tmp_path / "wide.png", 1569, 300), str(tmp_path), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            images.load(bad)
    assert images.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x18\x01\x19\x03" + b"\x00" * 9) == (281, 280)
    df = spark.createDataFrame([(1, red), (2, None), (3, red)], "id int, path string").withColumn("photo", media("image", "path"))
    sem = connect(spark, scorer=DecisionScorer(service, images=images.image_paths(df, "photo")), threads=1)
    sem.filter(df, "any red", "photo").collect()
    body = Service.seen[-1][1]
    assert len(body["assets"]) == 1 and red not in json.dumps(body)
    with pytest.raises(ValueError):
        media("video", "path")


def test_config_reaches_the_request():
    body = ChatScorer("http://x").body(D.score("q", ["a", "b"]), [[("f", "t")]], record_batches([[("f", "t")]], layout="pack", k=9, budget=9, criteria=0)[0], SemConfig(model="m"), False)
    assert body["model"] == "m" and body["response_format"]["json_schema"]["schema"]["properties"]["answers"]["items"]["maximum"] == 1


def test_image_bytes_split_batches(tmp_path):
    """Five images of 1568 x 1568 pixels: two, two and one a request; repeated references count each time."""
    import zlib

    from semweave.sources.batching import record_batches
    from semweave.sources.images import REFERENCE, budget_of

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    rows = zlib.compress((b"\x00" + b"\xff\x00\x00" * 1568) * 1568)
    path = tmp_path / "large.png"
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1568, 1568, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b""))
    ref = REFERENCE + "0" * 64
    paths = {ref: str(path)}
    more = lambda text: budget_of(text, paths)
    records = [[("id", str(i)), ("photo", ref)] for i in range(5)]
    cut = lambda **how: [len(b.items) for b in record_batches(records, layout="pack", k=100, budget=50_000, criteria=0, **how)]
    assert cut(more=more) == [2, 2, 1] and cut() == [5]
    pairs = [(f"left {i}", ref) for i in range(5)]
    sizes = lambda layout, anchor: [len(b.items) for b in pair_batches(pairs, layout=layout, anchor=anchor, k=100, budget=50_000, auto_min_group=8, more=more)]
    assert sizes("pack", "auto") == [2, 2, 1] and sizes("star", "right") == [5]


def test_clients_are_kept_by_a_worker():
    from semweave.sources import http_scorers

    http_scorers._clients.clear()
    one, new = http_scorers.client_of("http://a.invalid", 1.0, "")
    again, old = http_scorers.client_of("http://a.invalid", 1.0, "")
    assert one is again and (new, old) == (1, 0)
    for i in range(http_scorers.CLIENTS):
        http_scorers.client_of(f"http://{i}.invalid", 1.0, "")
    assert http_scorers.client_of("http://a.invalid", 1.0, "")[1] == 1


def test_services_by_setting(spark):
    from semweave.sources.http_scorers import ChatScorer

    sem = connect(spark, endpoint="http://a.invalid/v1", model="m", cascade_endpoint="http://b.invalid", cascade_model="n")
    assert isinstance(sem.scorer, DecisionScorer) and (sem.scorer.endpoint, sem.scorer.model) == ("http://a.invalid/v1", "m")
    assert isinstance(sem.second, ChatScorer) and sem.second.endpoint == "http://b.invalid"
    assert isinstance(connect(spark, backend="llm", endpoint="http://a.invalid").scorer, ChatScorer)


def test_media_needs_the_decision_service(spark):
    from semweave.operators.scorers import KeywordScorer

    df = spark.createDataFrame([(1, "x.png")], "id int, path string").withColumn("photo", media("image", "path"))
    with pytest.raises(ValueError, match="decision service"):
        connect(spark, scorer=KeywordScorer()).filter(df, "red", "photo")
    cascade = connect(spark, scorer=DecisionScorer("http://a.invalid"), second=KeywordScorer(), cascade_model="m")
    with pytest.raises(ValueError, match="cascade"):
        cascade.join(df, df, "same", "photo", "photo")

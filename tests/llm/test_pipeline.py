"""The pipeline, stage by stage, against brute force."""

import random

import corpus_pipeline
import pytest
from semweave.llm import bpe_codec, decontaminate, quality, secret_scan, simhash


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def make_docs():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, prose(40)) for i in range(5)]
    texts = []
    for _ in range(60):
        base = prose(rng.randint(60, 300))
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = base.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [prose(100) + " " + bench[i % 5][1] + " " + prose(20) for i in range(8)]
    texts += [prose(80) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(5), None, "", "short one", "la la " * 200]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, prose(90), None, None, None)], bench


def test_stages(spark, tmp_path):
    rows, bench = make_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    take = lambda df: sorted(df.collect(), key=key)

    one = stages[0](spark, docs, tmp_path)
    assert one.columns == docs.columns
    passed = [r for r in take(docs) if not any(eval(c.replace(" = ", " == "), {}, dict(zip(quality.MEASURES, quality.measure((r["text"] or "").encode()), strict=True))) for c in quality.RULES.values())]  # noqa: S307
    assert take(one) == passed

    two = stages[1](spark, one, tmp_path)
    assert two.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in two.collect()}
    assert len(kept) == two.count()
    sets = [(r, shingles(r["text"])) for r in passed]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if len(a & b) >= 0.8 * len(a | b):
                group[max(find(i), find(j))] = min(find(i), find(j))
    order = lambda i: (sets[i][0]["doc_id"] is None, sets[i][0]["doc_id"] or 0)
    first = {}
    for i in sorted(range(len(sets)), key=order):
        first.setdefault(find(i), (sets[i][0]["doc_id"], sets[i][0]["text"]))
    assert kept == set(first.values())

    three = stages[2](spark, two, tmp_path)
    probes = decontaminate.Probes([(i, t.encode()) for i, t in bench])
    clean = [r for r in take(two) if not probes.search([(r["text"] or "").encode()])[0]]
    assert take(three) == clean and len(clean) == two.count() - 8

    four = stages[3](spark, three, tmp_path)
    assert four.columns == docs.columns and four.count() == len(clean)
    find_secrets = secret_scan.make_finder()
    assert not any(find_secrets((r["text"] or "").encode()) for r in four.collect())
    assert sum(x["text"] != y["text"] for x, y in zip(clean, take(four), strict=True)) == 1

    five = stages[4](spark, four, tmp_path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_codec.default_path())
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in four.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in five.collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(clean)


@pytest.mark.parametrize("k", range(5))
def test_empty_stages(spark, tmp_path, k):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.STAGES[k][1](spark, empty, str(tmp_path)).collect() == []


def test_large_groups_stay_linear(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(150)]
    texts = []
    for _ in range(400):
        words = list(base)
        words[rng.randrange(150)] = str(rng.random())
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()] == [0]


def test_copies_alike_only_through_their_origin(spark):
    """Each copy resembles the first text at 0.8 or more; two copies mostly don't resemble one another."""
    rng = random.Random(8)
    base = [f"{rng.choice('abcdefghijklmnop')}{i}" for i in range(300)]
    texts = [" ".join(base)]
    while len(texts) < 150:
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(300)] = str(rng.random())
        a, b = shingles(" ".join(words)), shingles(texts[0])
        if len(a & b) >= 0.8 * len(a | b):
            texts.append(" ".join(words))
    other = " ".join(f"o{i}" for i in range(200))
    docs = spark.createDataFrame(list(enumerate([*texts, other])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [0, 150]


def test_near_fingerprints_are_verified(spark, monkeypatch):
    """Texts whose fingerprints are near or equal, but whose shingles are not, both stay; texts without words are alike."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "t u v w x y z"), (3, " "), (4, ""), (5, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs, radius=3).collect()) == [1, 2, 3]
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes: len(hashes) % 2)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs, radius=3).collect()) == [1, 2, 3]


def test_links_between_non_leaders(spark):
    """Pairs of near copies in a crowd that shares a long passage: every pair keeps one text, whoever leads the crowd."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(140)]
    texts = []
    for k in range(400):
        own = [f"{rng.random()}" for _ in range(60)]
        texts.append(" ".join(passage + own))
        own[42:] = [f"{rng.random()}" for _ in range(18)]
        texts.append(" ".join(passage + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(0, 800, 2))


def test_crowd_near_the_threshold(spark, monkeypatch):
    """Copies of a text that is not among them, many a little under the threshold with most others: all links, few candidates."""
    rng = random.Random(5)
    n, base, texts = 500, [f"w{i}" for i in range(150)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(3, 147), 1 if i % 2 else 3 if i % 4 else 4):
            words[at] = str(rng.random())
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    first = list(range(n))
    for i in range(n):
        for j in range(i):
            if first[i] != first[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    counts, alike = [], simhash.alike

    def counting(pairs, *more):
        counts.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(simhash, "alike", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(first))
    assert len(set(first)) > 1
    assert len(counts) == 3 and counts[2] < 4 * n, counts


#: Names that an operator might use for columns of its own, in any case.
ODD = ("k0", "c1", "C2", "key_k0", "key_c1", "node", "label", "ledger", "Ledger_n_words", "n_words", "fail_bits", "suspect", "row", "whole", "redacted", "spans", "hits", "kept", "fp", "sketch", "a.b")


def test_clashing_names(spark, tmp_path):
    """Every stage returns the columns that it got, with the user's values, whatever they are called."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    texts = [prose(90) for _ in range(4)]
    texts += [texts[0], texts[1] + ' token = "abcdefgh1234"']
    rows = [(i, t, "en", "s", len(t), *(f"{n}-{i}" for n in ODD)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in ODD))
    spark.createDataFrame([(0, "another passage that stands nowhere in the documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {0: [0, 1, 2, 3, 4, 5], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3]}
    for k, want in kept.items():
        docs = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *ODD]
        assert sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0]) == [rows[i] for i in want]
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == 4


def test_very_long_text(spark, tmp_path):
    """A text of four million characters goes through every stage whole."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(50000)]
    words = [rng.choice(vocabulary) for _ in range(600_000)]
    words[300_000:300_000] = ["token", "=", "abcdefgh1234"]
    text, passage = " ".join(words), " ".join(rng.choice(vocabulary) for _ in range(40))
    other = words[::-1]
    docs = spark.createDataFrame([(0, text), (1, text + " end"), (2, " ".join([*other[:500_000], passage, *other[500_000:]]))], "doc_id long, text string")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, want in enumerate(([0, 1, 2], [0, 2], [0], [0], [0])):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == want
        if k == 3:
            assert docs.first()["text"] == text.replace("token = abcdefgh1234", "[SECRET]")

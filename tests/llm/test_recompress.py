"""Removal of repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from semweave.llm import queries, recompress

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [W.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_op7(spark, rows, table_dir):
    want = Counter((r[0], n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (n, g, k) in zip(rows, brute([r[1] for r in rows], 35), strict=True))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substring_dedup(spark, f"{table_dir}/full").collect())
    assert got == want and any(k[2] for k in want)
    assert queries.op7_substring_dedup(spark, f"{table_dir}/empty").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_many_shapes(spark, seed):
    rng = random.Random(seed)
    texts = []
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([7, 8, 12, 40]))) for _ in range(12)]
    for _ in range(150):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choice("xyzabc") for _ in range(rng.randint(1, 30))), "la " * rng.randint(1, 40), "p q " * rng.randint(1, 20)]) for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for window in (8, 35):
        want = dict(enumerate(brute(texts, window)))
        for r in recompress.remove_repeats(docs, window).collect():
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]


def test_equal_passages_choose_equal_symbols():
    rng = np.random.default_rng(4)
    passage = rng.integers(1, 50, 60).astype(np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(1, 50, rng.integers(0, 40)).astype(np.uint64), passage, rng.integers(1, 50, 30).astype(np.uint64)])
        at = len(a) - 90
        names = recompress.mix(np.concatenate([a, passage]))
        doc, p, m, name, _, bare = recompress.blocks(names, np.array([len(a), 60]), 35, 4)
        pick = lambda d, off: [next((int(n), bool(b)) for dd, pp, mm, n, b in zip(doc, p, m, name, bare, strict=True) if dd == d and pp <= w < pp + mm) for w in range(off, off + 26)]  # noqa: E731, B023
        for x, y in zip(pick(0, at), pick(1, 0), strict=True):
            assert x[1] == y[1] and (x[1] or x[0] == y[0])

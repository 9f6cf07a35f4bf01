"""SimHash links and components against brute force."""

import random

import numpy as np
import xxhash
from semweave.llm import queries, simhash
from semweave.llm.components import connected_components


def brute_print(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    label = {p: p for p in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_op2(spark, rows, table_dir):
    found = queries.op2_simhash_dedup(spark, f"{table_dir}/full").collect()
    assert len(found) == len(rows)
    prints = {i: brute_print(text or "") for i, text, *_ in rows if i is not None}
    label = brute_components(set(prints.values()) | {brute_print(t or "") for _, t, *_ in rows}, 2)
    smallest = {}
    for i, p in prints.items():
        smallest[label[p]] = min(i, smallest.get(label[p], i))
    for r in found:
        if r["doc_id"] is not None:
            p = prints[r["doc_id"]]
            assert (r["fingerprint"], r["component_id"]) == (f"{p:016x}", smallest[label[p]])
    assert queries.op2_simhash_dedup(spark, f"{table_dir}/empty").collect() == []


def clustered(n=1500):
    rng = random.Random(3)
    found = set()
    while len(found) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            found.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    return sorted(found)


def test_links_and_hot_shards(spark, monkeypatch):
    prints = clustered()
    want = brute_components(set(prints), 2)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for shard, hot in ((2048, 30_000), (16, 30_000), (16, 3), (2048, 100)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r["id"] % 2**64: r["label"] % 2**64 for r in connected_components(simhash.link_prints(df, 2)).collect()}
        groups, expected = {}, {}
        for p in prints:
            groups.setdefault(got.get(p, p), set()).add(p)
            expected.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_tree_finds_all_pairs():
    prints = np.array(clustered(800), np.uint64)
    root = np.zeros(len(prints), np.int64)
    got = {(int(a), int(b)) for x, y in simhash.Forest(prints, root).links(3) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want


def test_trees_prune():
    """A walk of a shard of the usual size visits a part of its nodes."""
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 63, simhash.SHARD, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, simhash.SHARD, dtype=np.uint64))
    forest = simhash.Forest(prints, np.zeros(len(prints), np.int64))
    assert sum(len(a) for a, _ in forest.links(2)) == 0
    assert forest.walked < 0.4 * len(prints) ** 2


def test_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["id"]: r["label"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}

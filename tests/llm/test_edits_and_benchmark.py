"""Edit-aware token counts and decontamination against brute force."""

import random
import re

from semweave.llm import decontaminate, edit_counts, queries
from semweave.llm.secret_scan import vocabulary


def test_op3(spark, rows, table_dir):
    encode = vocabulary().encode_ordinary
    got = {r["doc_id"]: r for r in queries.op3_edit_token_counts(spark, f"{table_dir}/full").collect() if r["doc_id"] is not None}
    for i, text, *_ in rows:
        if i is None:
            continue
        new = re.sub("[0-9]{6,}", "0", text or "") + "\n"
        assert (got[i]["n_tokens"], got[i]["n_tokens_edited"]) == (len(encode(text or "")), len(encode(new)))
    long = max(got.values(), key=lambda r: r["n_leaves"])
    assert long["n_leaves"] > 10000 and long["n_reencoded"] <= 3
    assert queries.op3_edit_token_counts(spark, f"{table_dir}/empty").collect() == []


def test_random_edits(spark, rows):
    rng = random.Random(8)
    encode = vocabulary().encode_ordinary
    docs, want = [], {}
    for i, (_, text, *_) in enumerate(rows):
        text = (text or "")[:20000]
        edits = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, len(text))
            edits.append((a, min(len(text), a + rng.choice([0, 0, 1, 5, 700])), rng.choice(["", " ", "x", " a b", "\n\n ", "'s 12  q", "word " * 300, " é"])))
        edits += [(5, 3, "no"), (None, 1, "no"), (0, 10**9, "no")] if rng.random() < 0.3 else []
        docs.append((i, text, edits))
        new, at = [], 0
        for a, b, t in edit_counts.usable([{"start": a, "end": b, "text": t} for a, b, t in edits], len(text)):
            new += [text[at:a], t]
            at = b
        want[i] = "".join(new) + text[at:]
    df = spark.createDataFrame(docs, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    for r in edit_counts.count_edited(edit_counts.build_trees(df, extra=("edits",))).collect():
        assert r["text"] == want[r["doc_id"]]
        assert r["n_tokens_edited"] == len(encode(want[r["doc_id"]])) == r["node_tokens"][1]
        assert r["node_chars"][1] == len(want[r["doc_id"]])
        for node in (r["node_chars"], r["node_tokens"]):
            assert all(node[i] == node[2 * i] + node[2 * i + 1] for i in range(1, len(node) // 2))


def test_few_leaves_of_any_script():
    """An edit in the middle of a long text re-encodes a few pre-tokens, whatever the script, and again after an edit."""
    words, encode = edit_counts.PreTokens(), vocabulary().encode_ordinary
    for text in ("Привет, мир: длинный текст без конца. " * 3000, "汉字文本，没有空格。" * 3000, "plain words, and more. " * 3000):
        pieces = words.split(text)
        tree = edit_counts.SegmentTree.of_leaves(list(map(len, pieces)), words.count(pieces))
        for at in (len(text) // 2, len(text) // 3):
            text, n = edit_counts.apply_edits(text, tree, [(at, at + 2, "я q")], words)
            assert n <= 8 and tree.n > 5000 and tree.tokens[1] == len(encode(text))


def test_edits_in_mixed_scripts():
    rng, words = random.Random(3), edit_counts.PreTokens()
    bits = ["a", "b'll", " ", "  ", "\n", "1", "!", "é", "漢", "Привет", "'s", "'", "l", "don't", "\t", "x y z", "😀"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        pieces = words.split(text)
        tree = edit_counts.SegmentTree.of_leaves(list(map(len, pieces)), words.count(pieces))
        for _ in range(3):
            places = [rng.randint(0, len(text)) for _ in range(rng.randint(0, 5))]
            edits = [{"start": a, "end": min(len(text), a + rng.choice([0, 0, 1, 2, 10])), "text": "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))} for a in places]
            text, _ = edit_counts.apply_edits(text, tree, edit_counts.usable(edits, len(text)), words)
            assert tree.tokens[1] == len(words.encode(text)) and tree.size[1] == len(text)


def distance(probe, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(probe, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(rng.randint(18, 60)) for _ in range(12)]
    docs = []
    for i in range(60):
        text = prose(rng.randint(5, 80))
        if i % 3 == 0:
            item = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 2, 4, 9])):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            text = f"{text}\n  {''.join(item).upper() if i % 2 else ''.join(item)}  {prose(10)}"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "a"), (103, items[0]), (103, items[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "short")], "item_id long, text string")
    probes = decontaminate.Probes([(i, t.encode()) for i, t in enumerate(items)])
    want = {}
    for i, text in docs:
        shown = decontaminate.normal((text or "").encode())
        for p, probe in enumerate(probes.text):
            d = decontaminate.edits_within(probe, shown, 5 * len(probe) // 100)  # against the plain distance: test_edits_within
            if d is not None:
                own = want.setdefault((i, probes.item[p]), {})
                own[p] = d
    for block in (decontaminate.BLOCK_BYTES, 300):
        got = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_probes"], r["edits"]) for r in got} == {k: (len(v), min(v.values())) for k, v in want.items()}
        assert len(got) == len(want) + 1  # the repeated row
        left = decontaminate.decontaminate(df, bench, block_bytes=block)
        assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in docs if i not in {k[0] for k in want})
    assert len(want) >= 15
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []


def found_in(items, text, **more):
    return {h["item_id"] for h in decontaminate.Probes([(i, t.encode()) for i, t in enumerate(items)], **more).search([text.encode()])[0]}


def test_short_passages():
    """Every passage of PROBE characters from the start of a word is found, and any that is a stride longer."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    item, before, after = prose(60), prose(20), prose(20)
    words = item.split()
    for i in range(len(words)):
        passage = ""
        for w in words[i:]:
            passage = f"{passage} {w}".strip()
            if len(passage) >= 60:
                assert found_in([item], f"{before} {passage} {after}") == {0}
                break
    for i in range(len(item) - 69):
        assert found_in([item], f"{before}#{item[i : i + 69]}#{after}") == {0}
    assert found_in([item], f"{before} {after}") == set()


def test_short_items(spark):
    """Items under 12 characters stand exactly and as whole words; others need no boundary."""
    assert found_in(["2+2=?", "yes", "a b c"], "so 2+2=? eyes yesterday, a b cd") == {0}
    assert found_in(["2+2=?", "yes", "a b c"], "12+2=?; Yes! x a  b\nc") == {1, 2}
    bench = spark.createDataFrame([(1, "2+2=?"), (2, " Yes "), (3, "exactly twelve"), (4, None), (5, " \n")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "what is 2+2=? now"), (2, "12+2=?"), (3, "eyes"), (4, "YES"), (5, "inexactly twelvefold"), (6, None), (None, "yes"), (7, "")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 2), (1, 1), (4, 2), (5, 3)]
    left = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 3, 6, 7]


def test_recall_of_edited_passages():
    """Passages of 100 characters with evenly random edits: an independent count of what has a probe within its budget."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [prose(60) for _ in range(40)]
    for edits, least in ((2, 1.0), (4, 0.95), (5, 0.9)):
        texts = []
        for k in range(80):
            at = items[k // 2].index(" ", 20 * (k % 2)) + 1
            passage = list(items[k // 2][at : at + 100])
            for i in rng.sample(range(100), edits):
                passage[i] = "#"
            texts.append(f"{prose(20)} {''.join(passage)} {prose(20)}".encode())
        found = decontaminate.Probes([(i, t.encode()) for i, t in enumerate(items)]).search(texts)
        assert sum(any(h["item_id"] == k // 2 for h in hits) for k, hits in enumerate(found)) >= least * 80, edits


def test_full_filter(spark, monkeypatch):
    """A filter that is far too small only makes more suspects."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", 8)
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [prose(30) for _ in range(8)]
    docs = spark.createDataFrame([(k, f"{prose(30)} {items[k]} {prose(9)}" if k < 8 else prose(60)) for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_bytes=500).collect()} == {(k, k) for k in range(8)}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", True, "x", 1.5)], "doc_id long, text string, suspect boolean, `row` string, `whole.text` double")
    bench = spark.createDataFrame([(1, "other text")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).collect() == docs.collect()


def test_edits_share_is_honoured():
    """As many edits as the share allows, evenly spread, whatever the share."""
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefgh ") for _ in range(600)).replace("  ", "ab")
    for share in (0.05, 0.1, 0.2, 0.34):
        for m in (20, 21, 23, 24, 35, 60, 100, 300):
            probes = decontaminate.Probes([(0, item[:m].strip().encode())], edits=share)
            for p, probe in enumerate(probes.text):
                e = int(len(probe) * share)
                assert probes.budget[p] == e
                text = bytearray(probe)
                for k in range(e):
                    text[(2 * k + 1) * len(text) // (2 * e)] = ord("#")
                assert probes.search([b"start " + bytes(text) + b" end"])[0]


def test_edits_within():
    rng = random.Random(5)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abc") for _ in range(n))
        probe, region = word(rng.randint(1, 12)), word(rng.randint(0, 30))
        want = distance(probe, region)
        assert decontaminate.edits_within(probe.encode(), region.encode(), 20) == want
        assert decontaminate.edits_within(probe.encode(), region.encode(), want - 1 if want else 0) == (None if want else 0)

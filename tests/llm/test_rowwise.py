"""Secret scan, quality ledger, BPE codec, licence scan, PII and shards against plain Python."""

import hashlib
import json
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from semweave.llm import bpe_codec, license_scan, pii, quality, queries, secret_scan

W = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(rows, found):
    """Result rows beside their texts, by id; repeated ids have equal texts here, and null ids are looked at apart."""
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    return [(text[r["doc_id"]], r) for r in found if r["doc_id"] is not None]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def spans(found, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_scan(spark, rows, table_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = queries.op1_secret_scan(spark, f"{table_dir}/full").collect()
    for text, r in by_text(rows, found):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert r["base_sha256"] == sha(spans(base, secret_scan.KINDS))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[1] == k for b in base) for k in range(3))
        kept = ",".join(s for s in r["spans"].split(",") if not s.startswith("random"))
        assert kept == spans(base, secret_scan.KINDS)
        for s in r["spans"].split(","):
            if s.startswith("random"):
                _, a, b = s.split(":")
                assert secret_scan.vocabulary().encode_ordinary(text[int(a) : int(b)])
    assert any("x7Kp9QzR4mWvT2yB8nLcD6fH" in t and "random" in r["spans"] for t, r in by_text(rows, found))


def brute_assign(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]


def test_overlapping_heads():
    """Heads that begin inside another head, in every order."""
    find, rng = secret_scan.make_finder(), random.Random(1)
    base = lambda text: [f for f in find(text.encode()) if f[1] == 0]
    assert base("secretoken=abcdefgh1") == [(5, 0, 20)]
    bits = ["password", "passwd", "secret", "secre", "token", "oken", "api_key", "apikey", "api", "_key", "=", ":", " ", "'", '"', "abcdefgh1", "ab", "A", "T"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert base(text) == brute_assign(text), text


def test_random_strings():
    find, rng = secret_scan.make_finder(), random.Random(2)
    lower, letters = string.ascii_lowercase, string.ascii_letters
    spans_of = lambda text: [(a, b) for a, k, b in find(text.encode()) if k == 3]
    for alphabet, n, least in ((lower, 32, 0.93), (letters, 40, 0.99), (letters + string.digits, 20, 0.99), (letters + string.digits + "+/", 40, 0.99)):
        keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(500)]
        assert sum(bool(spans_of(f"key {k} end")) for k in keys) >= least * 500
    key = "x7Fq9LmZ2pQ8rT4vB1nK6wJ3"
    path = "config/production/services/authentication/keys/"
    assert spans_of(path + key) == [(len(path), len(path) + len(key))]
    words = "/".join(["internationalization", "configuration", "authentication"] * 200)
    assert spans_of(f"{words}/{key}/{words}") == [(len(words) + 1, len(words) + 1 + len(key))]
    for clean in (words, "123e4567-e89b-12d3-a456-426614174000", "sha256/" + "0f" * 32, "4111111111111111", "Donaudampfschifffahrtsgesellschaftskapitaen", "get_http_response_code_from_server"):
        assert spans_of(f"see {clean} there") == []


def test_redact_secrets(docs, rows):
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" not in got[5]["text"] and got[5]["n_chars"] == len(got[5]["text"])
    assert got[0]["text"] is None and got[3]["text"] == "one"
    assert not any(secret_scan.make_finder()((r["text"] or "").encode()) for r in got.values())


def brute_quality(text):
    words = W.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality(spark, rows, docs, table_dir):
    for text, r in by_text(rows, queries.op5_quality_rules(spark, f"{table_dir}/full").collect()):
        want = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (r["fail_bits"] == 0)
    ledger = quality.rule_ledger(docs)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert kept.count() == ledger.where("fail_bits = 0").count()
    report = {r["rule"]: r for r in quality.ablate(ledger, quality.STRICT).collect()}
    masks = [r["fail_bits"] for r in ledger.collect()]
    for i, rule in enumerate(quality.RULES):
        assert report[rule]["n_failed"] == sum(m >> i & 1 for m in masks)
        assert report[rule]["n_failed_alone"] == sum(m == 1 << i for m in masks)
        assert report[rule]["n_kept_without"] == sum(m & ~(1 << i) == 0 for m in masks)


def test_bpe(spark, rows, table_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_codec.default_path())
    for text, r in by_text(rows, queries.op6_bpe_codec(spark, f"{table_dir}/full").collect()):
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(bpe_codec.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"decoder": {"type": "ByteLevel"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"model": {"type": "Unigram"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="plain byte-level BPE"):
            bpe_codec.ForcedBoundaryBPE(str(path))


def test_forced_boundaries_are_certain():
    from tokenizers import Tokenizer

    c = bpe_codec.ForcedBoundaryBPE(bpe_codec.default_path())
    assert 0 < sum(c.inside) < 65536
    t = Tokenizer.from_file(bpe_codec.default_path())
    text = "zqxj" * 3 + "qqkvjx wordlike 漢字kanji"
    assert any(len(c.cuts(p.encode())) > 1 for p in text.split())
    assert list(np.frombuffer(c.encode([text.encode()])[0][0], "<u4")) == t.encode(text, add_special_tokens=False).ids


def test_licenses(spark, rows, table_dir):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text, r in by_text(rows, queries.op9_license_scan(spark, f"{table_dir}/full").collect()):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert {p[1] for p in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if "MIT License" in text:
            assert {"mit", "apache-2.0", "reserved"} <= set(r["labels"].split(","))


def brute_labels(words):
    """Label -> best share, by looking for every key phrase at every place."""
    found = {}
    for label, template, key in license_scan.TEMPLATES:
        template, key = (license_scan.words_of(x.encode()) for x in (template, key))
        k = next(i for i in range(len(template)) if template[i : i + len(key)] == key)
        for at in range(len(words)):
            if words[at : at + len(key)] == key:
                slack = int(license_scan.SLACK * len(template))
                region = list(words[max(0, at - k - slack) : at - k + len(template) + slack])
                same = 0
                for w in template:
                    if w in region:
                        region.remove(w)
                        same += 1
                if same >= license_scan.COVERAGE * len(template):
                    found[label] = max(found.get(label, 0), same / len(template))
    return found


def test_template_labels():
    """Any mixture of templates, changed, cut short and beside one another, against brute force."""
    index, rng = license_scan.Index(license_scan.TEMPLATES, {"license": 90, "software": 50}, 1000), random.Random(7)
    hits = 0
    for _ in range(300):
        words = []
        for _, template, _ in rng.sample(license_scan.TEMPLATES, rng.randint(1, 4)):
            own = license_scan.words_of(template.encode())
            own = own[rng.choice([0, 0, 1]) : len(own) - rng.choice([0, 0, 1])]
            for _ in range(rng.choice([0, 1, 4])):
                own[rng.randrange(len(own))] = b"other"
            words += [*own, *[b"filler"] * rng.randint(0, 5)]
        got = index.match(words, set(words))
        assert got == pytest.approx(brute_labels(words))
        hits += len(got)
    assert hits > 300
    every = [w for _, t, _ in license_scan.TEMPLATES for w in license_scan.words_of(t.encode())]
    assert set(index.match(every, set(every))) == {label for label, _, _ in license_scan.TEMPLATES}


def test_base_phrases_alone(spark):
    """Base phrases in texts without any template's words, and with other templates."""
    docs = spark.createDataFrame([(1, "All rights reserved."), (2, "Copyright 2020 X. All Rights Reserved"), (3, "CC BY cc by"), (4, "general public"), (5, None)], "doc_id long, text string")
    for more in ({}, {"templates": [("own", "my very own terms", "own terms")]}):
        got = {r["doc_id"]: r for r in license_scan.license_labels(docs, **more).collect()}
        assert {i: [(p["label"], p["word"]) for p in r["places"]] for i, r in got.items()} == {1: [("reserved", 0)], 2: [("reserved", 3)], 3: [("cc-by", 0), ("cc-by", 2)], 4: [], 5: []}
        assert [got[i]["score"] for i in range(1, 6)] == [1, 1, 1, 0, 0]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))] if "." in text else []
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    base += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return base


def test_pii(spark, rows, table_dir):
    for text, r in by_text(rows, queries.op10_pii(spark, f"{table_dir}/full").collect()):
        base = brute_pii(text)
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        assert r["base_sha256"] == sha(spans(base, pii.KINDS))
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("term")) == spans(base, pii.KINDS)


def test_revealing_terms(spark):
    """Terms, counted by the definition, over texts whose copies are known; every occurrence outside the patterns' spans."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(k, prose(80)) for k in range(300)]
    texts += [(1000 + k, f"{prose(50)} contact Zebulon Quackenbush at zeb@corp.example.com {prose(50)}") for k in range(3)]
    texts += [(1100, f"{prose(30)} about ZEBULON alone {prose(20)}"), (1101, f"Über {prose(9)} Zebulonia. zeb@corp.example.com {prose(40)}")]
    copy = f"{prose(60)} mail Waldemar at wal@x.example.org {prose(40)}"
    texts += [(2000, copy)] * 6
    for _ in range(20):
        words = copy.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append((2000, " ".join(words)))
    texts += [(3000 + k, f"{prose(60)} all@every.example.net {prose(10)}") for k in range(200)]  # too frequent to tell anything
    texts += [(4000, None), (4001, "")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3)

    total, at, having, classes, n_t = len(texts), {}, Counter(), {}, Counter()
    entities = []
    for group, text in texts:
        terms = {w.lower() for w in re.findall(r"[^\W\d_]+", text or "") if len(w) >= 4}
        own = {text[a:b].lower() for a, k, b in brute_pii(text or "") if k == 0}
        n_t.update(terms)
        having.update(own)
        entities.append(own)
        for e in own:
            for t in terms:
                at[e, t] = at.get((e, t), 0) + 1
                classes.setdefault((e, t), set()).add(group)
    reveals = {t for (e, t), n in at.items() if len(classes[e, t]) > 1 and 2 * n >= n_t[t] and total * n >= 8 * n_t[t] * having[e] and total >= 8 * having[e]}
    assert {"zebulon", "quackenbush"} <= reveals and "waldemar" not in reveals
    found = 0
    for r in pii.pii_spans(docs).collect():
        text = texts[r["doc_id"]][1] or ""
        base = brute_pii(text)
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in reveals and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"] == want
        found += len(want)
    assert found >= 9
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert "Zebulon" not in clean[300] and "<email>" in clean[300] and "ZEBULON" not in clean[303] and "Waldemar" in clean[305]


def test_shards(spark, rows, table_dir):
    found = queries.op8_kd_shards(spark, f"{table_dir}/full").collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    for text, r in by_text(rows, found):
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "bytes")
        assert 0 <= r["shard"] < 24
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_shards_are_near_equal(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('copy ', 40) else repeat(sha2(cast(id as string), 256), 1 + cast(id % 5 as int)) end as text", "if(id % 2 = 0, 'hot', cast(id % 9 as string)) as source", "'en' as lang")
    from semweave.llm import kd_shards

    sizes = Counter()
    for r in kd_shards.shard_by_bytes(docs, 24).collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(v - mean) < 0.03 * mean for v in sizes.values())


def sums(docs):
    from semweave.llm import kd_shards

    found = kd_shards.shard_by_bytes(docs, 24).collect()
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == docs.count() and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / 24
    return [sizes[i] / mean for i in range(24)]


def test_repeated_rows_are_cut(spark):
    """Equal rows, with one id or none, are dealt like others: no shard is empty or heavy."""
    own = spark.range(1000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", "'x' as source", "'en' as lang")
    same = spark.range(3000).selectExpr("7L as doc_id", "repeat('same ', 54) as text", "'x' as source", "'en' as lang")
    none = spark.range(1000).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "'x' as source", "'en' as lang")
    assert all(abs(x - 1) < 0.02 for x in sums(own.union(same)))
    assert all(abs(x - 1) < 0.03 for x in sums(none))


def test_equal_texts_share_a_shard(spark):
    from semweave.llm import kd_shards

    docs = spark.range(16000).selectExpr("id as doc_id", "sha2(cast(id % 4000 as string), 256) as text", "cast(id % 11 as string) as source", "cast(id % 3 as string) as lang")
    shards, sizes = {}, Counter()
    for r in kd_shards.shard_by_bytes(docs, 24).collect():
        shards.setdefault(r["doc_id"] % 4000, set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in shards.values())
    assert max(sizes.values()) < 1.05 * min(sizes.values())


@pytest.mark.parametrize("name", ["op1_secret_scan", "op5_quality_rules", "op6_bpe_codec", "op8_kd_shards", "op9_license_scan", "op10_pii"])
def test_empty(spark, table_dir, name):
    assert queries.QUERIES[name](spark, f"{table_dir}/empty").collect() == []

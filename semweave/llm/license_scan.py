"""License scan by a positional rare-token index.

A template counts only if its mandatory key phrase stands in the file. So the index has, for each template, postings
(template, position) of the words of its key phrase with the highest inverse document frequency in the corpus. A file's
licence words are looked up from the highest IDF on, until every template is decided: a template goes as soon as one of
its looked-up words is not in the file, and postings of the others that agree on the relative position of template and
file are intersected. Where they agree, the key phrase is verified. No template can be missed by this, however many stand
in one file. The share of the template's words in that region of the file, in any order, is its score.

Defined cases: a null or empty text has no words, labels or places; words are counted from 0; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import map_text, raw_bytes, slices
from semweave.llm.license_texts import TEMPLATES

#: Phrases that are always looked for, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of each key phrase that are looked up, those with the highest IDF first.
LOOKED_UP = 2
#: Share of a template's words that have to stand in its region, which is longer than the template by SLACK.
COVERAGE, SLACK = 0.6, 0.25

WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


class Index:
    """Postings of the key phrases' rarest words, with the corpus's IDF."""

    def __init__(self, templates: Iterable[tuple[str, str, str]], df: dict[str, int], n_docs: int):
        self.templates = [(label, words_of(t.encode()), words_of(key.encode())) for label, t, key in templates]
        self.key_at = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for _, t, k in self.templates]
        self.vocabulary = {w for _, _, key in self.templates for w in key}
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w.decode(), 0))) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.looked_up: list[int] = []
        for n, (_, _, key) in enumerate(self.templates):
            rare = sorted(range(len(key)), key=lambda i, key=key: (-self.idf[key[i]], key[i], i))[:LOOKED_UP]
            self.looked_up.append(len(rare))
            for i in rare:
                self.postings[key[i]].append((n, self.key_at[n] + i))
        self.order = sorted(self.postings, key=lambda w: (-self.idf[w], w))

    def match(self, words: list[bytes], have: set[bytes]) -> dict[str, float]:
        """Labels of the templates in place, with the best share of the template's words that stand there."""
        if have.isdisjoint(self.postings):
            return {}
        # templates that a word absent from the file rules out
        out = {n for w in self.order if w not in have for n, _ in self.postings[w]}
        open_ = {w: [p for p in self.postings[w] if p[0] not in out] for w in self.order if w in have}
        open_ = {w: posts for w, posts in open_.items() if posts}
        if not open_:
            return {}
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for at, w in enumerate(words):
            for n, i in open_.get(w, ()):
                votes[n, at - i] += 1
        found: dict[str, float] = {}
        for (n, start), hits in votes.items():
            label, template, key = self.templates[n]
            at = start + self.key_at[n]
            if hits < self.looked_up[n] or at < 0 or words[at : at + len(key)] != key:
                continue
            more = int(SLACK * len(template))
            region = Counter(words[max(0, start - more) : start + len(template) + more])
            share = (Counter(template) & region).total() / len(template)
            if share >= COVERAGE:
                found[label] = max(found.get(label, 0.0), share)
        return found


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], *, text_col: str = "text") -> DataFrame:
    """(word, n_docs) of the templates' words over all documents; each task sends at most one row a word of the vocabulary.
    The row of the empty word has the number of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in slices(batches):
            count[b""] += batch.num_rows
            for text in raw_bytes(batch.column(0)):
                if text:
                    count.update(vocabulary.intersection(words_of(text)))
        if count:
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in count], "n": list(count.values())})

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n_docs"))


def license_labels(docs: DataFrame, templates: Iterable[tuple[str, str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` (array of (label, word) of the fixed phrases), ``labels`` (of the templates in
    place, sorted) and ``score``: the largest share of a matched template's words in place, 1 for a fixed phrase, else 0.
    """
    templates = tuple(templates)
    vocabulary = Index(templates, {}, 0).vocabulary
    # at most one row a word of the templates reaches the driver
    df = {r["word"]: r["n_docs"] for r in document_frequencies(docs, vocabulary, text_col=text_col).collect()}

    def make() -> Callable[[bytes], tuple]:
        index = Index(templates, df, df.get("", 0))
        phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

        def kernel(text: bytes) -> tuple:
            words = words_of(text)
            have, flat, places = set(words), b"", []
            for phrase, label in phrases:
                if not have.issuperset(phrase.split()):
                    continue
                flat = flat or b" " + b" ".join(words) + b" "
                at, seen, last = flat.find(phrase), 0, 0
                while at >= 0:
                    seen += flat.count(b" ", last, at)
                    last = at
                    places.append({"label": label, "word": seen})
                    at = flat.find(phrase, at + 1)
            found = index.match(words, have)
            return len(words), places, sorted(found), 1.0 if places else max(found.values(), default=0.0)

        return kernel

    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    fields = [
        ("n_words", pa.int64(), "long"),
        ("places", place, "array<struct<label:string,word:bigint>>"),
        ("labels", pa.list_(pa.string()), "array<string>"),
        ("score", pa.float64(), "double"),
    ]
    return map_text(docs, make, fields, id_col=id_col, text_col=text_col)

"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary is made of what occurs often; a random string falls apart into many short tokens. So in every
run of key characters the stretches with few characters a token are found, whatever stands beside them, and reported
(kind ``random``) with the part between separators that they lie in. Known digests, UUIDs and numbers are excluded first.

Not found: random strings under 16 characters, or under 24 that are all small or all capital letters, unless a pattern has them.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; matches of one kind never overlap
(leftmost first), those of different kinds may; texts are scanned whole, whatever their length, in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import SPANS, SPANS_DDL, extend_rows, free_name, map_text, span_rows

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: What an assignment may begin with, in lower case; the pattern is tried at every place of them.
HEADS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Characters that a random string has at least; one that could be a word of its letters alone needs more.
LEAST, LEAST_WORD = 16, 24
#: A stretch under this many characters a token counts as random.
CHARS_PER_TOKEN = 2.0

#: Known digests, identifiers and numbers; a run is tested on either side of them.
KNOWN = re.compile(
    rb"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|"
    + b"|".join(b"[0-9a-f]{%d}|[0-9A-F]{%d}" % (n, n) for n in (128, 96, 64, 56, 48, 40, 32))
    + rb"|[0-9]+)(?![0-9A-Za-z])"
)
PART = re.compile(rb"[A-Za-z0-9]+")
WORD = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")
DIGIT = re.compile(rb"[0-9]")

_encodings: dict[str, object] = {}


def vocabulary(path: str | None = None):
    """The tiktoken encoding of a ``.tiktoken`` rank file (default: the public byte-level one), once a process."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def stretches(score: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches [i, j) of positive sum, left to right, in linear time (Ruzzo and Tompa 1999)."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, i, j
    total = 0.0
    for k, x in enumerate(score):
        before, total = total, total + x
        if x <= 0:
            continue
        new = (before, total, k, k + 1)
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
        found.append(new)
    return [(i, j) for _, _, i, j in found]


class TokenSizes(dict[int, int]):
    """Bytes of a token, by its id; remembers what it was asked, a vocabulary at most."""

    def __init__(self, bytes_of: Callable[[int], bytes]):
        self.bytes_of = bytes_of

    def __missing__(self, token: int) -> int:
        self[token] = n = len(self.bytes_of(token))
        return n


class RandomStrings:
    """Stretches of a run of key characters that a vocabulary encodes badly."""

    def __init__(self, vocabulary_path: str | None, limit: float):
        self.limit = limit
        encoding = vocabulary(vocabulary_path)
        self.encode = encoding.encode_ordinary
        self.size = TokenSizes(encoding.decode_single_token_bytes)

    def __call__(self, run: bytes) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        at = 0
        for known in (*KNOWN.finditer(run), None):
            stop = known.start() if known else len(run)
            if stop - at >= LEAST:
                out += [(at + a, at + b) for a, b in self.piece(run[at:stop])]
            at = known.end() if known else stop
        return out

    def piece(self, run: bytes) -> list[tuple[int, int]]:
        # long runs are encoded piece by piece
        sizes = [self.size[t] for i in range(0, len(run), 4096) for t in self.encode(run[i : i + 4096].decode())]
        ends = [0, *accumulate(sizes)]
        bad = lambda a, b: b - a >= LEAST and b - a < self.limit * (bisect_left(ends, b) - bisect_right(ends, a) + 1)
        parts = [m.span() for m in PART.finditer(run)]
        begins = [a for a, _ in parts]
        found = [p for p in parts if bad(*p)]
        for i, j in stretches([self.limit - x for x in sizes]):
            a, b = ends[i], ends[j]
            if b - a >= LEAST:
                # with the parts between separators that it lies in, if these are badly encoded as a whole
                low, high = bisect_right(begins, a) - 1, bisect_left(begins, b) - 1
                whole = min(a, begins[low] if low >= 0 and parts[low][1] > a else a), max(b, parts[high][1] if high >= 0 else b)
                if bad(*whole):
                    found.append(whole)
                elif DIGIT.search(run, a, b):  # else part of a long word
                    found.append((a, b))
        if not found and bad(0, len(run)):
            found = [(0, len(run))]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            inner = run[a:b].strip(b"+/_=-")
            a += run[a:b].index(inner)
            b = a + len(inner)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return [(a, b) for a, b in out if b - a >= (LEAST_WORD if WORD.fullmatch(run, a, b) else LEAST)]


def assignments(text: bytes) -> Iterator[re.Match[bytes]]:
    """Matches of ASSIGN, leftmost and not overlapping, also where one head begins inside another."""
    lower, heads = text.lower(), []
    for head in HEADS:
        at = lower.find(head)
        while at >= 0:
            heads.append(at)
            at = lower.find(head, at + 1)
    end = 0
    for at in sorted(heads):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            yield m


def make_finder(vocabulary_path: str | None = None, limit: float = CHARS_PER_TOKEN) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """text -> (start, kind number, end) in bytes."""
    random_in = RandomStrings(vocabulary_path, limit)

    def find(text: bytes) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in assignments(text) if m.end(2) - m.start(2) >= 8]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        found += [(m.start() + a, 3, m.start() + b) for m in RUN.finditer(text) for a, b in random_in(m[0])]
        return found

    return find


def secret_spans(docs: DataFrame, *, vocabulary_path: str | None = None, limit: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: (kind, start, end) in code points, end exclusive, by start, then kind as in KINDS."""

    def make():
        find = make_finder(vocabulary_path, limit)
        return lambda text: (span_rows(text, find(text), KINDS),)

    return map_text(docs, make, [("spans", SPANS, SPANS_DDL)], id_col=id_col, text_col=text_col)


def redact_secrets(docs: DataFrame, *, mark: str = "[SECRET]", vocabulary_path: str | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; each secret (overlapping ones as one) is replaced by ``mark`` in the text.

    A text without secrets, and a null one, stays as it is. A column ``n_chars``, if there is one, follows the new text.
    """

    def make():
        find, put = make_finder(vocabulary_path), mark.encode()

        def kernel(text: bytes) -> tuple:
            found = sorted(find(text))
            if not found:
                return (None,)
            out, at, i = [], 0, 0
            while i < len(found):
                start, end = found[i][0], found[i][2]
                i += 1
                while i < len(found) and found[i][0] < end:
                    end = max(end, found[i][2])
                    i += 1
                out += [text[at:start], put]
                at = end
            return ((b"".join(out) + text[at:]).decode("utf-8", "replace"),)

        return kernel

    name = free_name(docs, "redacted")
    rows = extend_rows(docs, make, [(name, pa.string(), "string")], text_col=text_col)
    new = F.col(name)
    put: dict[str, Column] = {text_col: F.coalesce(new, F.col(f"`{text_col}`"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(new.isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(put.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))

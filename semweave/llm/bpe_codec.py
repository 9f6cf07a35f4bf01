"""BPE encoding and decoding by forced boundaries.

If two neighbouring bytes never stand side by side inside any token of the vocabulary, no merge can ever join them: the
place between them is a certain cut. Each pre-token falls apart at its cuts into short fragments, every fragment is
merged on its own, and the ids are concatenated. Fragments and pre-tokens recur, so both have bounded memo tables; a full
table is emptied, which changes no result.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens in a text are recognised as
the tokenizer file says; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semweave.llm.arrow_rows import map_text

MEMO_ENTRIES = 700_000
NO_MERGE = 1 << 62
#: Pre-tokens of more bytes than this are merged one by one.
LONG = 48
#: Characters whose normal form, case, class and white space are the same in every Unicode version: texts made of them
#: alone are cut by PIECE below; all others go through the tokenizer file's own normalizer and pre-tokenizer.
USUAL = re.compile(r"[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
USUAL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_coders: dict[str, ForcedBoundaryBPE] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """A byte-level word-end BPE file (model ``BPE`` with ``end_of_word_suffix``), encoded fragment by fragment."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or spec.get("decoder"):
            raise ValueError(f"not a plain byte-level BPE file without decoder: {', '.join([model.get('type', ''), *odd, *(['decoder'] if spec.get('decoder') else [])])}")
        self.end = end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        # merge of two ids -> rank << 32 | new id
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[x] << 32 | vocab[y]] = rank << 32 | vocab[x + y]
        letters = byte_letters()
        self.first = [0] * 256
        self.last = [0] * 256
        for letter, byte in letters.items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        #: inside[a << 8 | b]: bytes a, b stand side by side in some token. All other places are forced boundaries.
        self.inside = bytearray(1 << 16)
        for token in vocab:
            body = [letters[c] for c in (token.removesuffix(end) if end else token)]
            for x, y in zip(body, body[1:], strict=False):
                self.inside[x << 8 | y] = 1
        parts = Tokenizer.from_file(path)
        self.normalize = parts.normalizer.normalize_str if parts.normalizer else str
        self.pieces = parts.pre_tokenizer.pre_tokenize_str
        self.usual = USUAL_CUT in path_cut(spec)
        self.letters = letters
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.memo: dict[str, bytes] = {}
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_values = np.array([self.merges[k] for k in sorted(self.merges)], np.int64)
        self.inside_table = np.frombuffer(bytes(self.inside), np.uint8)
        self.first_table, self.last_table = np.array(self.first, np.int64), np.array(self.last, np.int64)

    def cuts(self, piece: bytes) -> list[bytes]:
        """Fragments of a pre-token between its forced boundaries."""
        inside = self.inside
        at = [i for i, (x, y) in enumerate(zip(piece, piece[1:], strict=False), 1) if not inside[x << 8 | y]]
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)], strict=True)] if at else [piece]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one fragment, lowest rank first, leftmost first among equals."""
        get = self.merges.get
        pairs = [get(x << 32 | y, NO_MERGE) for x, y in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) != NO_MERGE:
            if len(ids) > 400:  # all places of the pair in one pass over a long fragment
                ids = self.merge_all(ids, pairs, best)
                pairs = [get(x << 32 | y, NO_MERGE) for x, y in zip(ids, ids[1:])]  # noqa: B905
                continue
            i = pairs.index(best)
            new = best & 0xFFFFFFFF
            ids[i] = new
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | new, NO_MERGE)
            if i < len(pairs):
                pairs[i] = get(new << 32 | ids[i + 1], NO_MERGE)
        return ids

    @staticmethod
    def merge_all(ids: list[int], pairs: list[int], best: int) -> list[int]:
        out, i, n = [], 0, len(ids)
        while i < n:
            if i + 1 < n and pairs[i] == best:
                out.append(best & 0xFFFFFFFF)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: its fragments on their own, the last one with the word end."""
        fragments, ids, first = self.cuts(piece), [], self.first
        for f in fragments[:-1]:
            ids += self.merge([first[b] for b in f])
        end = [first[b] for b in fragments[-1]]
        end[-1] = self.last[fragments[-1][-1]]
        return ids + self.merge(end)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of many pre-tokens; those of ordinary length are merged together, fragment by fragment."""
        raw = [p.encode() for p in pieces]
        long = [i for i, p in enumerate(raw) if len(p) > LONG]
        for i in long:
            self.memo[pieces[i]] = pack(self.piece(raw[i]))
        if long:
            pieces, raw = [p for p, r in zip(pieces, raw, strict=True) if len(r) <= LONG], [r for r in raw if len(r) <= LONG]
        if not raw:
            return
        size = np.array([len(p) for p in raw])
        stop = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ids = self.first_table[data]
        ids[stop - 1] = self.last_table[data[stop - 1]]
        cut = np.ones(len(data), bool)  # true where a fragment begins: at pre-tokens and forced boundaries
        cut[1:] = self.inside_table[data[:-1] << 8 | data[1:]] == 0
        cut[stop[:-1]] = True
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(data))
        flat, count = self.merge_many(ids, start, length)
        # fragments of a pre-token stand together, so its ids do
        owner = np.searchsorted(stop, start, side="right")
        n = np.bincount(owner, weights=count, minlength=len(raw)).astype(np.int64) * 4
        packed, at = flat.astype("<u4").tobytes(), 0
        for p, k in zip(pieces, n.tolist(), strict=True):
            self.memo[p] = packed[at : at + k]
            at += k

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NO_MERGE)

    def merge_many(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all fragments side by side, one merge of each a round: their ids in order, and how many each has."""
        out = np.full((len(start), int(length.max())), -1, np.int64)
        count = np.empty(len(start), np.int64)
        for low, high in ((0, 1), (1, 8), (8, 14), (14, 24), (24, LONG)):
            rows = np.flatnonzero((length > low) & (length <= high))
            if not len(rows):
                continue
            n, wide = length[rows], int(length[rows].max())
            column = np.arange(wide)
            a = np.where(column < n[:, None], ids[np.minimum(start[rows][:, None] + column, len(ids) - 1)], -1)
            r = self.lookup(a[:, :-1], a[:, 1:])
            r[column[1:] >= n[:, None]] = NO_MERGE
            while True:
                best = r.min(1) if r.shape[1] else np.full(len(rows), NO_MERGE)
                on = best != NO_MERGE
                done = rows[~on]
                out[done, : a.shape[1]] = a[~on]
                count[done] = n[~on]
                if not on.any():
                    break
                rows, a, r, n, best = rows[on], a[on], r[on], n[on] - 1, best[on]
                each, col, new = np.arange(len(rows)), r.argmin(1), best & 0xFFFFFFFF
                a[each, col] = new
                keep = np.ones(a.shape, bool)
                keep[each, col + 1] = False
                a = a[keep].reshape(len(rows), -1)
                keep = np.ones(r.shape, bool)
                keep[each, col] = False
                r = r[keep].reshape(len(rows), -1)
                x = np.flatnonzero(col > 0)
                r[x, col[x] - 1] = self.lookup(a[x, col[x] - 1], new[x])
                x = np.flatnonzero(col < n - 1)
                r[x, col[x]] = self.lookup(new[x], a[x, col[x] + 1])
        return out[out >= 0], count

    def unusual(self, text: str) -> list[int]:
        """A chunk without ASCII white space, by the file's own normalizer and pre-tokenizer."""
        ids: list[int] = []
        at = 0
        spans = [m.span() for m in self.specials.finditer(text)] if self.specials else []
        for start, stop in [*spans, (len(text), len(text))]:
            if start > at:
                for shown, _ in self.pieces(self.normalize(text[at:start])):
                    ids += self.piece(bytes(map(self.letters.__getitem__, shown)))
            if stop > start:
                ids.append(self.special[text[start:stop]])
            at = stop
        return ids

    def encode(self, raws: list[bytes]) -> list[tuple[bytes, str]]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers, and the text that they decode to."""
        done, at = [], 0
        while at < len(raws):  # texts of a few MB together
            stop, size = at, 0
            while stop < len(raws) and (stop == at or size < 4_000_000):
                size += len(raws[stop])
                stop += 1
            done += self.encode_some(raws[at:stop])
            at = stop
        return done

    def encode_some(self, raws: list[bytes]) -> list[tuple[bytes, str]]:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        parts: list[list[str | bytes]] = []
        new: set[str] = set()
        for raw in raws:
            text = raw.decode("utf-8", "replace")
            if self.is_usual(text):
                part = PIECE.findall(text.lower())
                new.update(part)
            else:  # no pre-token spans white space
                part = []
                for chunk in raw.split():
                    shown = chunk.decode("utf-8", "replace")
                    if self.is_usual(shown):
                        some = PIECE.findall(shown.lower())
                        new.update(some)
                        part += some
                    else:
                        part.append(pack(self.unusual(shown)))
            parts.append(part)
        self.learn([p for p in new if p not in self.memo])
        memo, out = self.memo, []
        for part in parts:
            ids = b"".join([memo[p] if p.__class__ is str else p for p in part])
            out.append((ids, self.decode(ids)))
        return out

    def decode(self, ids: bytes) -> str:
        """Token names, joined by a space: what a tokenizer file without a decoder gives."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def is_usual(self, text: str) -> bool:
        return self.usual and USUAL.fullmatch(text) is not None and not (self.specials and self.specials.search(text))


def path_cut(spec: dict) -> str:
    """The file's pre-token pattern if its other parts are the ones that PIECE and ``lower`` stand for, else nothing."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    usual = kinds == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
    return cuts[0]["pattern"].get("Regex", "") if usual and not cuts[1].get("use_regex", True) else ""


def pack(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def coder(path: str) -> ForcedBoundaryBPE:
    if path not in _coders:
        _coders[path] = ForcedBoundaryBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit ids) and ``decoded`` (what the ids decode to, with
    special tokens, for a tokenizer without decoder)."""
    where = path or default_path()

    def make() -> Callable[[bytes], tuple]:
        return coder(where).encode

    return map_text(docs, make, [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")], id_col=id_col, text_col=text_col, batched=True)

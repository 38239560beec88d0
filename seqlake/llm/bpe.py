"""Byte-level BPE by backtracking over longest matches, exact and linear in the text.

A sequence of tokens is what the merges give if and only if each two neighbours are compatible, that is, if merging
the two tokens' bytes alone gives back the two tokens. So a piece is encoded left to right: take the longest token
that matches, or the next shorter one that is compatible with the token before it, and step back where none is. Each
position is given up at most once, and compatibility is memoised by pair. Bytes are mapped to Latin-1 characters, so
that one Aho-Corasick automaton over all tokens cuts a piece into longest matches in a single scan; they stand up to the
first two that aren't compatible. From there on its trie says how far a visited place can match at most, and the longest
token is the first prefix from there down that is one. Both the backtracking and the test of compatibility are the
published ones of GitHub's "So many tokens, so little time" (2024).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqlake.llm.common import arrow_map, batch, column

#: Distinct pre-tokens and pairs that a worker remembers; beyond, the pairs start afresh and half of the pre-tokens go
#: (results are the same). Pre-tokens of
#: more than MEMO_CHARS characters are never remembered, so the memo is bounded in bytes too.
MEMO, MEMO_CHARS = 200_000, 64
#: White space of the Unicode standard, which is what \s means to the public tokenizers' pattern engines.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pattern(text: str) -> regex.Pattern:
    """A tokenizer's pattern with \\s spelt out, because Python's \\s also takes \\x1c-\\x1f."""
    return regex.compile(text.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks have to be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in f if x.strip())]
    pairs.sort(key=lambda x: x[1])
    if [r for _, r in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not dense")
    return [t for t, _ in pairs]


class Bpe:
    """Encodes pieces (matches of the pattern) and decodes ids; special tokens are ordinary text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.automaton, self.most = ahocorasick.Automaton(), max(self.length, default=0)
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.memo: dict[int, int] = {}
        for i, t in enumerate(tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.ids.get(t[self.length[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]
            self.halves.append((left, right) if left >= 0 else (i, i))

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes merges at the seam, the latest first; a merge across the seam that would have come earlier forbids it."""
        merged, halves, bound = self.merged, self.halves, len(self.tokens) + 1
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    bound, left = left, halves[left][1]
                    if left != bound:
                        break
                else:
                    bound, right = right + 1, halves[right][0]
                    if right + 1 != bound:
                        break
                undo_left = not undo_left
            else:
                return True

    def fitting(self, left: int, token: int) -> int:
        """The first of token and the shorter and shorter ones in its place that is compatible with left, -1 if none is."""
        memo, tried = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        while token >= 0:
            known = memo.get(left << 32 | token)
            if known is not None:
                token = known
                break
            tried.append(token)
            if self._compatible(left, token):
                break
            token = self.shorter[token]
        for t in tried:
            memo[left << 32 | t] = token
        return token

    def longest(self, piece: bytes, text: str, at: int) -> int:
        """The longest token at a place of a piece (text: its bytes as Latin-1), -1 if there is none."""
        get, k = self.ids.get, self.automaton.longest_prefix(text[at : at + self.most])
        while k:
            token = get(piece[at : at + k])
            if token is not None:
                return token
            k -= 1
        return -1

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        text, n, length, known = piece.decode("latin-1"), len(piece), self.length, self.memo.get
        out: list[int] = []
        at, before, token = 0, -1, -1
        for _, token in self.automaton.iter_long(text):
            if before >= 0:
                fits = known(before << 32 | token)
                if fits is None:
                    fits = self.fitting(before, token)
                if fits != token:
                    token = fits
                    break
            out.append(token)
            at += length[token]
            before = token
        else:
            if at == n:
                return out
            token = self.longest(piece, text, at)
        dead: set[int] = set()  # places that were given up
        shorter = self.shorter
        while at < n:
            while token >= 0:
                if before >= 0:
                    fits = known(before << 32 | token)
                    token = self.fitting(before, token) if fits is None else fits
                if token < 0 or at + length[token] not in dead:
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    before, token = token, self.longest(piece, text, at)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token, before = shorter[last], out[-1] if out else -1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def _loaded(path: str, pat: str) -> tuple[Bpe, regex.Pattern]:
    return Bpe(read_ranks(path)), pattern(pat)


class Pieces(dict):
    """The ids of each piece, joined by commas; remembered while there is room. The half that fills up first is kept as old:
    pieces that come again move on from there, the others go with it. Known pieces are found without a call of Python, and
    as nothing but strings is kept, the garbage collector has nothing to follow."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old, self.names = bpe, {}, [str(i) for i in range(len(bpe.tokens))]

    def __missing__(self, text: str) -> str:
        found = self.old.get(text)
        if found is None:
            names = self.names
            found = ",".join([names[i] for i in self.bpe.encode(text.encode())])
        if len(text) <= MEMO_CHARS:
            if len(self) > MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class TextCodec:
    """Whole texts: pieces are encoded once each while the memo holds them."""

    def __init__(self, path: str, pat: str):
        self.bpe, self.pattern = _loaded(path, pat)
        self.known = Pieces(self.bpe)
        self.bytes = dict(zip(self.known.names, self.bpe.tokens))

    def joined(self, text: str) -> str:
        """The ids of a text as decimal numbers, joined by commas."""
        return ",".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        joined = self.joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, joined: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, joined.split(","))) if joined else b""


@functools.lru_cache(2)
def codec_of(path: str, pat: str) -> TextCodec:
    """The codec of a worker, which knows the pieces of its tasks so far."""
    return TextCodec(path, pat)


def encode(docs: DataFrame, ranks: str, pat: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row and whole text; null is empty, an empty text has no ids."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        codec = codec_of(ranks, pat)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield batch(out, b.column(0), ids, [codec.bpe.decode(x) for x in ids])

    return arrow_map(docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str, pat: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() of every whole text, of which only digests
    leave the workers. Null is empty; the digests of an empty text are those of no bytes. Null and repeated ids stay
    as they are; an empty table gives no rows; other columns are not read."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = codec_of(ranks, pat)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1).to_pylist():
                joined = codec.joined(t or "")
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(joined)).hexdigest())
            yield batch(out, b.column(0), n, ids, back)

    return arrow_map(docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public multilingual vocabulary; another path can be given to every function here."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN

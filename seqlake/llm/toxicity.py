"""Toxicity by a noisy channel: restore obfuscated words, then score the restored text.

1. A character language model: counts of 4-grams of folded letters over the words of all documents. The alphabet has 28
   symbols, so the model is a table of 28^4 cells however large the corpus.
2. Spans that look obfuscated (letters mixed with look-alike digits and signs, letters spaced out one by one, letters
   repeated three times or more) become lattices: each character offers its readings at a cost, or nothing where it
   separates or repeats. Viterbi decoding under the language model picks the restored text.
3. A logistic scorer over the restored text's words and word beginnings, learnt from a bounded sample of labelled rows:
   SAMPLE documents a class, and of their features the FEATURES that mark toxic documents most (three at least that
   have it, four times as often as clean ones).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, arrow_map, batch, held_out

#: Labelled rows of each class that the scorer is fitted on, and features that it has, at most.
SAMPLE, FEATURES = 4000, 4000
THRESHOLD = 0.3
#: Symbols: 0 word boundary, 1-26 letters, 27 any other letter.
SYMBOLS, ORDER = 28, 4
#: Readings of look-alikes (fixed values).
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou",
}
#: Costs in nats: a look-alike's reading, a sign that stands for nothing, a repeated letter, a separator inside a
#: spaced-out word, a separator that ends a word.
LOOKALIKE, NOTHING, REPEAT, JOIN, BREAK = 0.5, 4.0, 1.5, 0.2, 1.0
_SEPARATORS = " .-_*/|"
_ONE = r"(?:[^\W_]|[@$!])"
_SPACED = re.compile(rf"(?<![^\W_@$!]){_ONE}([ .\-_*/|]{{1,3}}){_ONE}(?:\1{_ONE})+(?![^\W_])")
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]*+(?:[0-9@$!|+*€]++[^\W\d_]++)++(?:[0-9@$]{1,2}(?![0-9@$]))?")
_TAIL = re.compile(r"(?<![^\W_])[^\W\d_]++[0-9@$]{1,2}(?![0-9@$\w])")
_REPEATED = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*")
_WORDS = re.compile(r"[^\W\d_]+")
_GATHER, _MEMO = 200_000, 100_000


def _fold(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else SYMBOLS - 1


class _Fold(dict):
    def __missing__(self, key: int) -> str:
        self[key] = chr(_fold(chr(key)))
        return self[key]


_FOLD = _Fold({0: "\0"})


def gram_counts(words: dict[str, int]) -> np.ndarray:
    """Weighted counts of each symbol after the three before it; a word stands between boundaries."""
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + "".join([w + pad for w in words])).translate(_FOLD).encode("latin-1"), np.uint8).astype(np.int64)
    cell = codes[3:] + SYMBOLS * (codes[2:-1] + SYMBOLS * (codes[1:-2] + SYMBOLS * codes[:-3]))
    weight = np.repeat(np.fromiter(words.values(), np.float64, len(words)), [len(w) + 3 for w in words])
    real = (codes[3:] > 0) | (codes[2:-1] > 0)  # the boundary behind a word counts once
    return np.bincount(cell[real], weight[real], SYMBOLS**ORDER)


class CharModel:
    """log P(symbol | three before), each order smoothed by the next lower one."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape((SYMBOLS,) * ORDER)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for lower in range(ORDER):
            n = c.sum(tuple(range(ORDER - 1 - lower)))
            p = (n + 4 * p) / (n.sum(-1, keepdims=True) + 4)
        self.logp = np.log(p).astype(np.float32).ravel()
        self.cells = self.logp.tolist()

    def decode(self, span: str) -> str:
        """The likeliest restoration of an obfuscated span (lower case)."""
        spaced = _SPACED.fullmatch(span) is not None
        cells, size, cube = self.cells, SYMBOLS, SYMBOLS**3
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by the last three symbols: score, path back
        for k, ch in enumerate(span):
            if spaced and ch in _SEPARATORS:
                options = [("", JOIN), (" ", BREAK)]
            elif ch.isalpha():
                options = [(ch, 0.0)]
                if k and span[k - 1] == ch:
                    options.append(("", REPEAT))
            else:
                options = [(r, LOOKALIKE) for r in READINGS.get(ch, "")] + [("", NOTHING)]
            after: dict[int, tuple[float, tuple]] = {}
            for context, (score, path) in states.items():
                for reading, cost in options:
                    if reading == "":
                        key, value = context, score - cost
                    elif reading == " ":
                        key, value = 0, score - cost + (cells[context * size] if context else 0.0)
                    else:
                        cell = context * size + ord(_FOLD[ord(reading)])
                        key, value = cell % cube, score - cost + cells[cell]
                    if key not in after or value > after[key][0]:
                        after[key] = (value, (path, reading) if reading else path)
            states = after
        path = max((score + (cells[c * size] if c else 0.0), k, path) for k, (c, (score, path)) in enumerate(states.items()))[2]
        out = []
        while path:
            path, reading = path
            out.append(reading)
        return "".join(reversed(out))


#: Classes of the characters up to U+FFFF: 1 letter or digit, 2 look-alike, 4 separator, 8 letter.
_CLASS = np.array(
    [chr(c).isalnum() + 2 * (chr(c) in READINGS) + 4 * (chr(c) in _SEPARATORS) + 8 * chr(c).isalpha() if not 0xD800 <= c < 0xE000 else 0 for c in range(0x10000)], np.uint8
)


def _suspects(low: str) -> tuple[bool, bool, bool]:
    """Whether a text can hold spaced-out, mixed and repeated spans at all (never a wrong no): whole arrays at a time."""
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) < 2 or code.max() > 0xFFFF:
        return True, True, True
    kind = _CLASS[code]
    letter = kind & 8 > 0
    same = code[1:] == code[:-1]
    repeated = bool((same[1:] & same[:-1] & letter[2:]).any())
    sign = kind & 2 > 0
    mixed = bool((letter[:-1] & sign[1:]).any() or (sign[:-1] & letter[1:]).any())
    one = (kind & 1 > 0) | sign
    lone = one[:-1] & (kind[1:] & 4 > 0)  # before a separator
    lone[1:] &= ~one[:-2] | sign[:-2]
    at = np.nonzero(lone)[0]
    return bool((at[1:] - at[:-1] <= 4).any()), mixed, repeated


def noisy_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of spans that look obfuscated; of overlapping ones the longer."""
    spaced, mixed, repeated = _suspects(text)
    use = [_SPACED] * spaced + [_MIXED, _TAIL] * mixed + [_REPEATED] * repeated
    found = [m.span() for rx in use for m in rx.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
        elif b - a > out[-1][1] - out[-1][0]:
            out[-1] = (a, b)
    return out


_NO_LETTER = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letter_words(low: str) -> list[str]:
    """Maximal runs of letters; where all that isn't ASCII is letters, by a byte table."""
    if low.isascii():
        return low.encode().translate(_NO_LETTER).decode().split()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    high = code[code > 127]
    if high.max() <= 0xFFFF and (_CLASS[high] & 8).all():
        return low.encode().translate(_NO_LETTER).decode().split()
    return _WORDS.findall(low)


class Restorer:
    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def restore(self, text: str | None) -> str:
        """The whole text in lower case, with each noisy span decoded."""
        low, out, at = (text or "").lower(), [], 0
        for a, b in noisy_spans(low):
            span = low[a:b]
            said = self.known.get(span)
            if said is None:
                if len(self.known) > _MEMO:
                    self.known.clear()
                said = self.model.decode(span)
                if len(span) <= 64:
                    self.known[span] = said
            out += (low[at:a], said)
            at = b
        return "".join([*out, low[at:]])


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters if it is longer (marked by a hyphen)."""
    return [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)]


def features(restored: str) -> set[str]:
    return {f for w in set(letter_words(restored)) for f in word_features(w)}


class Scorer:
    """Sum of the weights of a text's distinct features; words are looked up once while the memo holds them."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def logit(self, restored: str) -> float:
        words, known = set(letter_words(restored)), self.known
        if len(known) > 2 * _MEMO:
            known.clear()
        for w in words.difference(known):
            known[w] = tuple(f for f in word_features(w) if f in self.weights)
        found = {f for hit in filter(None, map(known.__getitem__, words)) for f in hit}
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))


def language_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts over the words of all documents: each task sums its own table, Spark sums the tasks'."""
    out = pa.schema([("cell", pa.int32()), ("n", pa.float64())])

    def run(batches):
        total, words = np.zeros(SYMBOLS**ORDER), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(letter_words((t or "").lower()))
            if len(words) > _GATHER:
                total += gram_counts(words)
                words = Counter()
        if words:
            total += gram_counts(words)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=out)

    counts = np.zeros(SYMBOLS**ORDER)
    rows = arrow_map(docs.select(F.col(text_col).cast("string").alias("text")), run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 28^4 rows at most
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return CharModel(counts)


def _logistic(rows: list[list[int]], y: np.ndarray, width: int, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Binary features; full-batch Adam on the mean log loss."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64)
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[col], len(rows)) + w[-1])))
        err = (p - y) / len(y)
        grad = np.append(np.bincount(col, err[at], width) + ridge * w[:-1], err.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad**2 - v)
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, scratch: Scratch, sample: int = SAMPLE, most: int = FEATURES) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) from labelled rows of the training fold; no weights where there are none."""
    spark = docs.sparkSession
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    y = y.where("doc_id is not null and toxic is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in y.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}, -20.0 if 1 not in n else 20.0
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / n[1]))).otherwise(F.lit(min(1.0, sample / n[0])))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = y.where(drawn < share * (1 << 30)).orderBy(drawn, "doc_id").limit(3 * sample)  # about 2 x sample; the limit only holds it if hashes are very uneven
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row of each id, however often it repeats
    shared = spark.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("feature", pa.list_(pa.string()))])

    def run(batches):
        r = Restorer(shared.value)
        for b in batches:
            yield batch(out, b.column(0), b.column(2), [sorted(features(r.restore(t))) for t in b.column(1).to_pylist()])

    seen = scratch.table(arrow_map(rows.select("doc_id", "text", "toxic"), run, "doc_id long, toxic int, feature array<string>"), "sample")
    long = seen.select("doc_id", "toxic", F.explode("feature").alias("feature"))
    t, c = F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    lift = (F.col("t") + 0.5) / (n[1] * min(1.0, sample / n[1]) + 1) / ((F.col("c") + 0.5) / (n[0] * min(1.0, sample / n[0]) + 1))
    chosen = long.groupBy("feature").agg(t, c).where("t >= 3").where(lift >= 4).orderBy(F.desc(lift), "feature").limit(most).select("feature")
    names = [r.feature for r in chosen.collect()]  # FEATURES at most
    number = {f: k for k, f in enumerate(names)}
    own = seen.select("doc_id", "toxic", F.array_intersect("feature", F.lit(names) if names else F.array().cast("array<string>")).alias("feature")).collect()  # 3 x SAMPLE rows at most
    weights, bias = _logistic([[number[f] for f in r.feature] for r in own], np.array([r.toxic for r in own], float), len(names))
    return {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, bias


def score_documents(docs: DataFrame, model: CharModel, weights: dict[str, float], bias: float, threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), and restored if with_text, for every row and whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, bias))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), *([("restored", pa.string())] if with_text else [])])

    def run(batches):
        model, weights, bias = shared.value
        r, scorer = Restorer(model), Scorer(weights, bias)
        for b in batches:
            texts = [r.restore(t) for t in b.column(1).to_pylist()]
            sums = [scorer.logit(t) for t in texts]
            score = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
            yield batch(out, b.column(0), score.tolist(), *([texts] if with_text else []))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = arrow_map(rows, run, "doc_id long, score double" + ", restored string" * with_text)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *(["restored"] if with_text else []))


def toxicity(docs: DataFrame, labels: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD).

    Labels are learnt from rows of the training fold only; null labels and ids are left out, a doc_id labelled more
    than once counts as toxic if any label says so. Null and empty texts are scored like a text without words. Without
    labels of both classes all scores are near 0 (or near 1 if only toxic rows are known). Null and repeated ids stay
    as rows; an empty table gives no rows; columns other than doc_id, text and toxic are not read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = language_model(docs)
    return score_documents(docs, model, *fit(docs, labels, model, scratch), with_text=with_text)

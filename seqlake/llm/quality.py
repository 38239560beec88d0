"""Quality by weak labels: heuristic labellers vote, expectation-maximisation weighs them, a hashed scorer learns.

Each labeller says good, bad or nothing of a text. Their votes over all documents are counted by pattern (at most
3^labellers patterns), and expectation-maximisation over these counts estimates the share of good documents and what
each labeller says of good and of bad ones. The posterior of a document's pattern is its soft label; a logistic scorer
over hashed words and word shapes learns it from a bounded sample of documents and scores every text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import arrow_map, batch, column

#: Documents that the scorer is fitted on at most, about; hashed columns; the score from which a document is kept.
SAMPLE, COLUMNS, KEEP = 4000, 1 << 16, 0.5
#: Shares of words are small numbers; times this they suit the fit.
SCALE = 8.0
NONE, BAD, GOOD = 0, 1, 2
_SIGN = "#%&*$|~^=<>{}\\@!"
#: Classes of the characters up to U+FFFF: 1 letter, 2 capital, 4 sign, 8 cell border.
_CLASS = np.array([chr(c).isalpha() + 2 * chr(c).isupper() + 4 * (chr(c) in _SIGN) + 8 * (chr(c) == "|") if not 0xD800 <= c < 0xE000 else 0 for c in range(0x10000)], np.uint8)
_MEMO = 200_000


def _between(x: float, bad: float, good: float) -> int:
    """Bad from bad on, good up to good, nothing between."""
    return BAD if x >= bad else GOOD if x <= good else NONE


#: Labellers: (name, vote of a text's figures), see figures().
LABELLERS = (
    ("capitals", lambda x: _between(x["capitals"] / max(1, x["letters"]), 0.3, 0.12)),
    ("signs", lambda x: _between(x["signs"] / max(1, x["words"]), 0.4, 0.05)),
    ("cells", lambda x: _between(x["cells"] / max(1, x["words"]), 0.12, 0.0)),
    ("repeats", lambda x: NONE if x["lines"] < 4 else _between(1 - x["distinct_lines"] / x["lines"], 0.35, 0.1)),
    ("variety", lambda x: NONE if x["words"] < 20 else _between(-x["distinct_words"] / min(x["words"], 400), -0.2, -0.35)),
    ("letters", lambda x: _between(1 - x["letters"] / max(1, x["chars"]), 0.35, 0.25)),
    ("length", lambda x: BAD if x["words"] < 3 else GOOD if x["words"] >= 20 else NONE),
    ("stop", lambda x: GOOD if x["last"] in (".", "?", '"', "\u201d") else BAD),
)


def figures(text: str | None) -> dict:
    """What labellers look at; lines are sentences too."""
    t = text or ""
    words, lines = t.split(), [x for x in t.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if x]
    n = np.bincount(_CLASS[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)], minlength=16)
    at = np.arange(16)
    sums = {name: int(n[at & bit > 0].sum()) for name, bit in (("letters", 1), ("capitals", 2), ("signs", 4), ("cells", 8))}
    return sums | {"chars": len(t), "words": len(words), "distinct_words": len(set(words)), "lines": len(lines), "distinct_lines": len(set(lines)), "last": t.rstrip()[-1:]}


def votes(text: str | None) -> list[int]:
    """One vote of each labeller; null is empty."""
    x = figures(text)
    return [vote(x) for _, vote in LABELLERS]


def pattern_code(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def estimate(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], float, np.ndarray]:
    """(posterior of good by pattern, share of good, P(vote | class) as (labellers, class, vote)) by EM; class 1 is good.

    A labeller that says nothing counts neither way. It starts from labellers that are right three times in four.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    v = np.stack([codes // 3**k % 3 for k in range(labellers)], 1) if len(codes) else np.zeros((0, labellers), np.int64)
    share, said = 0.8, np.tile([[1.0, 0.75, 0.25], [1.0, 0.25, 0.75]], (labellers, 1, 1))
    post = np.zeros(0)
    for _ in range(rounds):
        like = np.stack([np.log(said[np.arange(labellers), c, v]).sum(1) for c in (0, 1)], 1) + np.log([1 - share, share])
        before, post = post, 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        if len(before) and np.abs(post - before).max() < 1e-9:
            break
        share = float(np.clip((post @ n + 1) / (n.sum() + 2), 0.01, 0.99))
        for k in range(labellers):
            for c, p in ((0, 1 - post), (1, post)):
                tally = np.bincount(v[:, k], p * n, 3)[1:] + 1
                said[k, c, 1:] = tally / tally.sum()
    return dict(zip(codes.tolist(), post.tolist(), strict=True)), share, said


def posterior_of(code: int, share: float, said: np.ndarray) -> float:
    """The posterior of one pattern under what estimate() has found; patterns that it never met have one too."""
    k = np.arange(len(said))
    like = [float(np.log(said[k, c, code // 3**k % 3]).sum()) for c in (0, 1)]
    return 1 / (1 + math.exp(min(500.0, like[0] - like[1] + math.log((1 - share) / share))))


class Posterior(dict):
    """Posteriors by pattern, computed once each."""

    def __init__(self, share: float, said: np.ndarray):
        super().__init__()
        self.share, self.said = share, said

    def __missing__(self, code: int) -> float:
        self[code] = posterior_of(code, self.share, self.said)
        return self[code]

    def __reduce__(self):
        return Posterior, (self.share, self.said)


_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Classes of a word's characters, runs drawn together: "The," is "Aa,"."""
    return _RUN.sub(r"\1", "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]))


class _Columns(dict):
    """Word to its two hashed columns, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = out = zlib.crc32(b"w" + word.lower().encode()) % COLUMNS << 20 | zlib.crc32(b"s" + shape(word).encode()) % COLUMNS
        return out


def hashed(text: str | None, known: _Columns) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns of a whole text, and their shares of its words (times SCALE)."""
    words = (text or "").split() or [""]
    pair = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    col, n = np.unique(np.concatenate([pair >> 20, pair & (1 << 20) - 1]), return_counts=True)
    return col, n * (SCALE / len(words))


class Scorer:
    """The linear score of a whole text: the mean over its words of their two columns' weights."""

    def __init__(self, weights: np.ndarray):
        self.columns, self.weights, self.known = _Columns(), weights, {}

    def logit(self, text: str | None) -> float:
        words, known = (text or "").split() or [""], self.known
        if len(known) > _MEMO:
            known.clear()
        for w in set(words).difference(known):
            pair = self.columns[w]
            known[w] = SCALE * float(self.weights[pair >> 20] + self.weights[pair & (1 << 20) - 1])
        return sum(map(known.__getitem__, words)) / len(words) + float(self.weights[-1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], columns: int = COLUMNS, steps: int = 200, rate: float = 0.3) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of soft labels, by full-batch Adam."""
    w = np.zeros(columns + 1)
    if not rows:
        return w
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col, x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col] * x, len(rows)) + w[-1], -30, 30)))
        err = (p - y) / len(y)
        grad = np.append(np.bincount(col, err[at] * x, columns) + 1e-6 * w[:-1], err.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad**2 - v)
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, weak_label (posterior of the votes), score (0 to 1), keep (score >= keep).

    No label table is read. Null and empty texts are texts without words. Null and repeated ids stay as rows; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    out = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])

    def vote(batches):
        n = Counter()
        for b in batches:
            n.update(pattern_code(votes(x)) for x in b.column(0).to_pylist())
        yield batch(out, list(n), list(n.values()))

    voted = arrow_map(texts.select("text"), vote, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r.pattern: r.n for r in voted.collect()}  # 3^8 rows at most
    _, good, said = estimate(counts)
    posterior = Posterior(good, said)
    share = min(1.0, sample / max(1, sum(counts.values())))
    rows = pa.schema([("label", pa.float64()), ("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])

    def pick(batches):
        known = _Columns()
        for b in batches:
            got = [(posterior[pattern_code(votes(t))], *hashed(t, known)) for t in b.column(0).to_pylist()]
            yield batch(rows, *zip(*got)) if got else batch(rows, [], [], [])

    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    drawn = arrow_map(chosen, pick, "label double, cols array<int>, vals array<float>")
    seen = drawn.orderBy(F.xxhash64("cols", "vals"), "label").limit(3 * sample).collect()  # about sample; the limit only holds it if hashes are very uneven
    shared = spark.sparkContext.broadcast((posterior, fit([(np.array(r.cols, np.int64), np.array(r.vals), r.label) for r in seen]).astype(np.float32)))
    kind = pa.schema([("doc_id", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64())])

    def score(batches):
        posterior, w = shared.value
        scorer = Scorer(w)
        for b in batches:
            t = b.column(1).to_pylist()
            z = np.clip(np.array([scorer.logit(x) for x in t], float), -30, 30)
            yield batch(kind, b.column(0), [posterior[pattern_code(votes(x))] for x in t], (1 / (1 + np.exp(-z))).tolist())

    got = arrow_map(texts, score, "doc_id long, weak_label double, score double")
    return got.withColumn("keep", F.col("score") >= keep)

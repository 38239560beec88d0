"""Benchmark decontamination: rare seeds join passages to test items, Smith-Waterman alignment of words scores them.

A copy may be edited, so seeds are ordered pairs of words at distance one or two, on both sides. An alignment of an item
of n words that scores at least r of the item's own has m >= rn matches and costs of at most 2m - 2rn; two matches in a row
that are further apart than two words, in the item or the text, cost 2 at least, so rn - 1 or more of the pairs of
consecutive matches are near. These form paths over the item's places, so at most d - 1 of them lie wholly among any d places. Hence:

1. The pairs of all items are counted over all documents (document frequency).
2. Each item drops all pairs among its d most frequent places (those whose pairs are the most frequent); the others are its
   seeds, and every copy of enough score holds rn - d of them, within (3 - 2r) n words. Nothing that scores enough is
   lost, however edited, for any d up to rn - 1. The item takes the d with the least bound on the documents that hold
   enough seeds: the sum of the seeds' frequencies over the number needed. So what many items share (a template) is no seed.
3. Seeds met in texts join the items' seeds. Document and item go on where enough seeds lie close enough together; the
   stretch of words around them is aligned if rn places of the item or more hold a word of it.

Letters of scripts without spaces are words of their own (scripts.words).

Items, pairs, seeds and stretches are tables; a filter of the pairs (9 bits each) goes to the scans of documents, and the
items' words where they are few. Beyond stated sizes both are left out, and the result is the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import ROW, ROW_ARROW, SCREEN_KEYS, KeyFilter, Scratch, arrow_map, batch, column, join_rows, numbered, spare, without
from seqlake.llm.scripts import words

MIN_RATIO = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs, and words of their texts, that are aligned at once.
PAIRS, CELLS = 128, 1_000_000
_MEMO, _GATHER = 200_000, 1_000_000
#: Distinct words of all items up to which they are sent to the scans, so that other words need no hash.
VOCABULARY = 500_000
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) or 1


class Hashes(dict):
    """64-bit hash of each word, 0 for words outside a vocabulary if one is given; else remembered while there is room."""

    def __init__(self, vocabulary: list[str] | None = None):
        super().__init__((w, _hash(w)) for w in vocabulary or ())
        self.closed = vocabulary is not None

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = _hash(word)
        return h

    def of(self, w: list[str]) -> np.ndarray:
        if self.closed:
            get = self.get
            return np.fromiter([get(x, 0) for x in w], np.uint64, len(w))
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def pair_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, key) of each ordered pair of words at distance one or two, both with a hash."""
    at, keys = [], []
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            both = np.nonzero((h[:-gap] != 0) & (h[gap:] != 0))[0]
            a, b = h[both], h[both + gap]
            at.append(both)
            x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
            keys.append((x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53))
    return np.concatenate(at), np.concatenate(keys).view(np.int64)


def kept_pairs(n: int, min_ratio: float) -> int:
    """Pairs of its item that every copy of enough score holds at least."""
    return max(1, math.ceil(n * min_ratio) - 1)


def chosen_seeds(at: np.ndarray, to: np.ndarray, df: np.ndarray, n: int, min_ratio: float) -> tuple[np.ndarray, int]:
    """(which pairs are seeds, how many of them every copy of enough score holds) of the pairs of places (at, to) of an
    item of n words, df: in how many documents each pair stands."""
    kept = kept_pairs(n, min_ratio)
    weight = np.bincount(at, df, n) + np.bincount(to, df, n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), -weight))] = np.arange(n)
    gone = np.maximum(rank[at], rank[to])  # a pair goes when both of its places have
    lost = np.bincount(gone, df, n).cumsum()
    need = np.concatenate([[kept], kept - np.arange(kept)])  # for d = 0, 1, ... kept places
    left = df.sum() - np.concatenate([[0], lost[:kept]])
    d = int(np.lexsort((-need, left / need[: len(left)]))[0])
    return gone >= d, int(need[d])


def covers(item: list[str], stretch: list[str], min_ratio: float) -> bool:
    """Whether enough places of the item hold a word of the stretch for an alignment that scores enough."""
    there = set(stretch)
    return sum(w in there for w in item) >= math.ceil(len(item) * min_ratio)


def smith_waterman(items: list[list[int]], texts: list[list[int]]) -> np.ndarray:
    """Best local score of each pair, linear gaps; a row of an item's words at a time for all pairs at once."""
    rows, wide, tall = len(items), max(map(len, texts), default=0), max(map(len, items), default=0)
    a, b = np.full((rows, tall), -1, np.int32), np.full((rows, wide), -2, np.int32)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)] = x
        b[k, : len(y)] = y
    before, best = np.zeros((rows, wide + 1), np.int32), np.zeros(rows, np.int32)
    step = -GAP * np.arange(wide + 1, dtype=np.int32)
    for i in range(tall):
        now = np.zeros_like(before)
        np.maximum(before[:, :-1] + np.where(b == a[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH)), before[:, 1:] + GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        before = np.maximum.accumulate(now + step, axis=1) - step  # gaps along the text: a running maximum
        np.maximum(best, before.max(1), out=best)
    return best


def stretches(at: list[int], n: int, need: int, min_ratio: float = MIN_RATIO) -> list[tuple[int, int]]:
    """(first word, end) of the stretches that can hold a copy of n words, which itself has at most (3 - 2 min_ratio) n:
    need seeds that close together, and as much around them as the copy can reach; overlapping ones are one."""
    out: list[tuple[int, int]] = []
    reach = int((3 - 2 * min_ratio) * n) + 1
    for k in range(len(at) - need + 1):
        lo, hi = at[k], at[k + need - 1]
        if hi - lo <= reach:
            first, end = max(0, hi - reach), lo + reach + 2
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((first, end))
    return out


def _items(items: DataFrame, item_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(item, item_id, words): distinct items that have an id and a word, numbered."""
    out = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string()))])

    def cut(batches):
        for b in batches:
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := words(t))]
            yield batch(out, *zip(*rows)) if rows else batch(out, [], [])

    rows = items.select(column(item_col).cast("long").alias("item_id"), column(text_col).cast("string").alias("text")).where("item_id is not null")
    return scratch.table(arrow_map(rows, cut, "item_id long, words array<string>").distinct().withColumn("item", F.monotonically_increasing_id()), "items")


def _item_pairs(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, n, at, to, key): one row for each place of a pair in an item."""
    out = pa.schema([("item", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("to", pa.int32()), ("key", pa.int64())])

    def run(batches):
        h = Hashes()
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, keys = pair_keys(h.of(w))
                to = at + np.where(np.arange(len(at)) < len(w) - 1, 1, 2)  # pairs of neighbours come first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(np.full(len(keys), len(w), np.int32)), pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(keys)], schema=out)

    return scratch.table(arrow_map(items.select("item", "words"), run, "item long, n int, at int, to int, key long"), "item-pairs")


def _filter(keys: DataFrame, scratch: Scratch) -> KeyFilter | None:
    """None where there are too many keys for a filter: then every pair of every text meets the join."""
    keys = scratch.table(keys.select("key").distinct(), "keys")
    return KeyFilter(keys, scratch) if keys.count() <= SCREEN_KEYS else None


def _vocabulary(items: DataFrame):
    """A broadcast of the items' distinct words, or of None where they are more than VOCABULARY."""
    distinct = items.select(F.explode("words").alias("word")).distinct()
    got = [r.word for r in distinct.limit(VOCABULARY + 1).toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(got if len(got) <= VOCABULARY else None)


def document_frequency(texts: DataFrame, known: KeyFilter | None, vocabulary) -> DataFrame:
    """(key, df): documents that hold each pair that the filter passes; summed by task, then by key."""
    out = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def gathered(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], schema=out)

    def run(batches):
        h, parts, size = Hashes(vocabulary.value), [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if w := words(t):
                    keys = pair_keys(h.of(w))[1]
                    parts.append(np.unique(keys if known is None else keys[known.has(keys)]))
                    size += len(parts[-1])
            if size > _GATHER:
                yield gathered(parts)
                parts, size = [], 0
        yield gathered(parts)

    return arrow_map(texts.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))


def seed_table(pairs: DataFrame, df: DataFrame, min_ratio: float) -> DataFrame:
    """(item, n, need, key): the seeds of each item, and how many of them every copy of enough score holds."""
    out = pa.schema([("item", pa.int64()), ("n", pa.int32()), ("need", pa.int32()), ("key", pa.int64())])
    counted = pairs.join(df, "key", "left").select("item", "n", F.struct("at", "to", F.coalesce("df", F.lit(0)).alias("df"), "key").alias("p"))
    per_item = counted.groupBy("item", "n").agg(F.array_sort(F.collect_list("p")).alias("pairs"))

    def run(batches):
        for b in batches:
            for i, n, p in zip(*(c.to_pylist() for c in b.columns)):
                at, to, df, key = (np.array([x[k] for x in p], np.int64) for k in ("at", "to", "df", "key"))
                seed, need = chosen_seeds(at, to, df, n, min_ratio)
                keys = np.unique(key[seed])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(np.full(len(keys), n, np.int32)), pa.array(np.full(len(keys), need, np.int32)), pa.array(keys)], schema=out)

    return arrow_map(per_item, run, "item long, n int, need int, key long")


def _met(texts: DataFrame, known: KeyFilter | None, vocabulary) -> DataFrame:
    """(row, at, key): places of pairs in texts that the filter of the seeds passes."""
    out = pa.schema([("row", ROW_ARROW), ("at", pa.int32()), ("key", pa.int64())])

    def run(batches):
        h = Hashes(vocabulary.value)
        for b in batches:
            rows, at, keys = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if w := words(t):
                    p, x = pair_keys(h.of(w))
                    if known is not None:
                        ok = known.has(x)
                        p, x = p[ok], x[ok]
                    rows.append(np.full(len(p), k))
                    at.append(p.astype(np.int32))
                    keys.append(x)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(at)), pa.array(np.concatenate(keys))], schema=out)

    return arrow_map(texts.select("row", "text"), run, f"row {ROW}, at int, key long")


def _matches(texts: DataFrame, items: DataFrame, item_col: str, item_text: str, min_ratio: float, scratch: Scratch) -> DataFrame:
    """(row, item_id, score, ratio, n_seeds) of texts (row, text)."""
    tests = _items(items, item_col, item_text, scratch)
    pairs = _item_pairs(tests, scratch)
    vocabulary = _vocabulary(tests)
    df = document_frequency(texts, _filter(pairs, scratch), vocabulary)
    seeds = scratch.table(seed_table(pairs, df, min_ratio), "seeds")
    met = _met(texts, _filter(seeds, scratch), vocabulary).join(seeds, "key")
    near = met.groupBy("row", "item").agg(F.sort_array(F.collect_list("at")).alias("at"), F.max("n").alias("n"), F.max("need").alias("need"))
    near = near.where(F.size("at") >= F.col("need"))
    kind = pa.schema([("row", ROW_ARROW), ("item", pa.int64()), ("n_seeds", pa.int32()), ("first", pa.int32()), ("end", pa.int32())])

    def place(batches):
        for b in batches:
            rows = [(r, i, len(at), a, e) for r, i, at, n, need in zip(*(c.to_pylist() for c in b.columns)) for a, e in stretches(at, n, need, min_ratio)]
            yield batch(kind, *zip(*rows)) if rows else batch(kind, *[[] for _ in kind])

    found = scratch.table(arrow_map(near.select("row", "item", "at", "n", "need"), place, f"row {ROW}, item long, n_seeds int, first int, end int"), "places")
    by_row = scratch.table(found.groupBy("row").agg(F.collect_list(F.struct("item", "n_seeds", "first", "end")).alias("places")), "by-row")
    mine = join_rows(texts, by_row.select("row"), "row", scratch, "left_semi").join(by_row, "row")  # other texts aren't moved
    cut_kind = pa.schema([("row", ROW_ARROW), ("item", pa.int64()), ("n_seeds", pa.int32()), ("stretch", pa.list_(pa.string()))])

    def cut(batches):
        for b in batches:
            for r, t, places in zip(*(c.to_pylist() for c in b.columns)):
                w = words(t)
                yield batch(cut_kind, *zip(*[(r, p["item"], p["n_seeds"], w[p["first"] : p["end"]]) for p in places]))

    passages = arrow_map(mine.select("row", "text", "places"), cut, f"row {ROW}, item long, n_seeds int, stretch array<string>")
    passages = scratch.table(passages, "passages")  # written, so that no task runs two Python workers at once
    result = pa.schema([("row", ROW_ARROW), ("item_id", pa.int64()), ("score", pa.int32()), ("ratio", pa.float64()), ("n_seeds", pa.int32())])

    def align(batches):
        for b in batches:
            rows = [x for x in zip(*(c.to_pylist() for c in b.columns)) if covers(x[3], x[4], min_ratio)]
            rows.sort(key=lambda r: (len(r[3]), len(r[4])))
            got, k = [], 0
            while k < len(rows):
                end, wide = k + 1, len(rows[k][4])
                while end < min(len(rows), k + PAIRS) and (end + 1 - k) * (wide := max(wide, len(rows[end][4]))) <= CELLS:
                    end += 1
                part, number = rows[k:end], {}
                k = end
                code = lambda ws: [number.setdefault(w, len(number)) for w in ws]  # noqa: B023, E731
                score = smith_waterman([code(r[3]) for r in part], [code(r[4]) for r in part])
                for (row, i, c, item, _), v in zip(part, score.tolist(), strict=True):
                    ratio = v / (MATCH * len(item))
                    if ratio >= min_ratio:
                        got.append((row, i, v, ratio, c))
            yield batch(result, *zip(*got)) if got else batch(result, *[[] for _ in result])

    joined = passages.join(tests, "item").select("row", "item_id", "n_seeds", "words", "stretch")
    return scratch.table(arrow_map(joined, align, f"row {ROW}, item_id long, score int, ratio double, n_seeds int"), "aligned")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, item_id, score, ratio, n_seeds): the contaminated pairs, each once, with its best stretch.

    Every row and whole text of docs counts. Null and empty texts and items match nothing; an item_id that repeats with
    other texts has the best of them; an item of one word (of one letter in an unspaced script) matches nothing, of one of two words the text has to hold both,
    next to each other or one apart. A null doc_id is not reported, equal rows are reported once. Empty tables give no rows. Other columns
    are not read.
    """
    scratch, row = Scratch(docs.sparkSession, "decontaminate"), spare(docs, "row")
    rows = numbered(docs, scratch, row).select(F.col(row).alias("row"), column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    found = _matches(rows.select("row", "text"), items, item_col, item_text, min_ratio, scratch)
    best = F.max(F.struct("ratio", "score", "n_seeds")).alias("best")
    hits = scratch.table(found.groupBy("row", "item_id").agg(best), "hits")
    ids = join_rows(rows.select("row", "doc_id"), scratch.table(hits.select("row").distinct(), "hit-rows"), "row", scratch, "left_semi")
    per = hits.join(ids.where("doc_id is not null"), "row").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return per.select("doc_id", "item_id", "best.score", "best.ratio", "best.n_seeds")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs without the rows that a test item contaminates; rows go by their own text, whatever their id."""
    scratch, row = Scratch(docs.sparkSession, "clean"), spare(docs, "row")
    rows = numbered(docs, scratch, row)
    found = _matches(rows.select(F.col(row).alias("row"), column(text_col).cast("string").alias("text")), items, "item_id", "text", min_ratio, scratch)
    return without(rows, found.select(F.col("row").alias(row)), row, scratch)

"""Token counts without ids: pieces are counted once per distinct pre-token.

1. One pass splits every text into pre-tokens and writes each document's pre-token frequencies.
2. The distinct pre-tokens are counted over all documents and encoded once each.
3. The pieces join the frequencies and are summed by document. The HEAD most frequent pre-tokens, a table of bounded
   size, are joined by broadcast, so that hot keys are never shuffled; the others by shuffle.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.bpe import pattern
from seqlake.llm.common import Scratch, arrow_map, column

#: Most frequent pre-tokens whose pieces are joined by broadcast (about 5 MB).
HEAD = 100_000
LIMIT = 2048


class Splitter:
    """Pre-tokens of a word BPE of the `tokenizers` library, and the number of pieces of one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer {steps}")
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = pattern(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.begins = {t[0] for t in special}
        own = spec | {"normalizer": None, "pre_tokenizer": byte_level, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(own))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's lower case by itself (a capital sigma has one, wherever it stands)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and the number of special tokens, which count one each."""
        if self.special is None or not any(c in text for c in self.begins) or not (n := len(self.special.findall(text))):
            return self.pattern.findall(self.normal(text)), 0
        return [w for part in self.special.split(text) for w in self.pattern.findall(self.normal(part))], n

    def count(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.pieces.encode_batch(words, add_special_tokens=False)]


@functools.lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _counted(words: DataFrame, path: str) -> DataFrame:
    """(word, n) -> (word, n, pieces), each row encoded once."""

    def run(batches):
        s = splitter(path)
        for b in batches:
            yield b.append_column("pieces", pa.array(s.count(b.column(0).to_pylist()), pa.int64()))

    return words.select("word", "n").mapInArrow(run, "word string, n long, pieces long")


def frequencies(texts: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, special, words): special tokens and the frequency of each pre-token, of every row."""
    kind = pa.map_(pa.string(), pa.int32())

    def run(batches):
        s = splitter(path)
        for b in batches:
            size, special, ends, words, counts = [], [], [0], [], []
            for t in b.column(1).to_pylist():
                split, n = s.split(t or "")
                seen = Counter(split)
                size.append(len((t or "").encode()))
                special.append(n)
                words += seen
                counts += seen.values()
                ends.append(len(words))
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int32())).cast(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(special, pa.int64()), maps], names=["doc_id", "n_bytes", "special", "words"])

    return arrow_map(texts, run, "doc_id long, n_bytes long, special long, words map<string,int>")


_CELL = "floor(8 * log2(n))"


def _head_cell(totals: DataFrame, head: int) -> int:
    """The least frequency class (eighths of a doubling, a few hundred at most) from which up no more than head
    pre-tokens are."""
    taken, cell = 0, 1 << 20
    for r in totals.groupBy(F.expr(_CELL).alias("cell")).agg(F.count("*").alias("k")).orderBy(F.desc("cell")).collect():
        taken += r.k
        if taken > head:
            break
        cell = r.cell
    return cell


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null counts as empty: 0 bytes, 0 tokens. Special strings inside texts count as the library's default has them (one
    token). Null and repeated ids stay as rows of their own: rows are matched by a row number, not by id. An empty
    table gives no rows. Other columns are not read. Any head, 0 included, gives the same counts.
    """
    scratch = Scratch(docs.sparkSession, "counts")
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    rows = scratch.table(frequencies(texts, path).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    seen = rows.select("row", F.explode("words").alias("word", "n"))
    totals = scratch.table(seen.groupBy("word").agg(F.sum("n").alias("n")), "totals")
    cell = _head_cell(totals, head)
    pieces = scratch.table(_counted(totals, path).withColumn("hot", F.expr(f"{_CELL} >= {cell}")), "pieces")
    scratch.drop(totals)
    hot, rest = (pieces.where(w).select("word", "pieces") for w in ("hot", "not hot"))
    joined = seen.join(F.broadcast(hot), "word").select("row", "n", "pieces")  # head rows at most
    cold = seen.join(F.broadcast(hot.select("word")), "word", "left_anti").join(rest, "word").select("row", "n", "pieces")
    summed = joined.unionByName(cold).groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("inside"))
    n = (F.col("special") + F.coalesce("inside", F.lit(0))).alias("n_tokens")
    return rows.join(summed, "row", "left").select("doc_id", "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)


def default_path() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))

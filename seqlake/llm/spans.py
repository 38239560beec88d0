"""Substring duplicates by sliding spans of sentences.

A text is cut into sentences; every run of two consecutive sentences is a span, and a run of more where two have fewer
than SPAN_CHARS characters, so a passage yields the same spans wherever it stands, and a longer run that repeats is covered by those of its pairs. Spans are hashed (128 bits), grouped over all
documents, and every sentence covered by a span that is not the first of its kind (by doc_id, then position) goes.
Only hashes and positions are shuffled to find spans; texts are read again at the end, where only documents that lose
sentences meet their positions.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, arrow_map, batch, column, join_rows, numbered, spare
from seqlake.llm.scripts import HAS_UNSPACED, UNIT

#: Characters (white space left out) that a span has at least, and sentences; words from which a sentence is cut further.
SPAN_CHARS, SPAN_SENTENCES, LONG = 60, 2, 16
#: One word in so many ends a part of a long sentence.
ONE_IN = 8
_CUT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？｡])(?![。！？｡」』”’）])\s*|(?<=[。！？｡][」』”’）])\s*|\n+")
_WORD = re.compile(r"\S+")
_COMMA = re.compile(r"(?<=[,;:])\s+|(?<=[、，；：])\s*")


def sentences(text: str | None, most_words: int = LONG) -> list[tuple[int, int]]:
    """(start, end) of each sentence, white space at the ends left out. A sentence ends at a stop that white space
    follows, at a full-width stop, or at a line end; one of more than most_words words is cut after commas as well, and what is
    still longer behind words that a hash picks (one in ONE_IN). Letters of scripts without spaces count as words. So places of cuts depend on the words next to them alone, and a
    passage is cut alike wherever it stands; only where no word of 4 x most_words in a row is picked, a cut is made
    there."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    unit = UNIT if HAS_UNSPACED.search(text) else _WORD
    at, cuts = 0, [(m.start(), m.end()) for m in _CUT.finditer(text)]
    for start, end in [*cuts, (len(text), len(text))]:
        _add(out, text, at, start, most_words, unit)
        at = end
    return out


def _add(out: list[tuple[int, int]], text: str, start: int, end: int, most: int, unit: re.Pattern, commas: bool = True) -> None:
    body = text[start:end]
    left = len(body) - len(body.lstrip())
    start, body = start + left, body.strip()
    if not body:
        return
    if len(body) <= most or (len(body.split()) if unit is _WORD else len(unit.findall(body))) <= most:
        out.append((start, start + len(body)))
    elif commas and (cuts := [m.span() for m in _COMMA.finditer(body)]):
        at = 0
        for a, b in [*cuts, (len(body), len(body))]:
            _add(out, text, start + at, start + a, most, unit, commas=False)
            at = b
    else:
        first, words = 0, list(unit.finditer(body))
        for k, w in enumerate(words):
            if k == len(words) - 1 or zlib.crc32(w[0].encode("utf-8", "replace")) % ONE_IN == 0 or k - first + 1 >= 4 * most:
                out.append((start + words[first].start(), start + w.end()))
                first = k + 1


def spans(text: str | None, chars: int = SPAN_CHARS, least: int = SPAN_SENTENCES, most: int = LONG) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash of the words) of every span; white space between words doesn't count."""
    cut = sentences(text, most)
    parts = [text[a:b].split() for a, b in cut]
    size = [sum(map(len, p)) for p in parts]
    keys = [" ".join(p).encode("utf-8", "replace") for p in parts]
    out, j, n = [], 0, 0
    for i in range(len(parts)):
        while j < len(parts) and (n < chars or j - i < least):
            n += size[j]
            j += 1
        if n < chars or j - i < least:
            break
        out.append((i, j - i, xxhash.xxh3_128_digest(b"\n".join(keys[i:j]))))
        n -= size[i]
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(key, text): key is the id and a hash of the row's place, so rows that share an id are told apart."""
    row = spare(docs, "row")
    key = F.struct(column(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(row)).alias("place"))
    return numbered(docs, scratch, row).select(key.alias("key"), column(text_col).cast("string").alias("text")).where("key.doc_id is not null")


def covered(docs: DataFrame, scratch: Scratch, chars: int = SPAN_CHARS) -> DataFrame:
    """(key, first, n, of) of docs (key, text): the spans that are not the first of their kind, which is that with the
    smallest id, then position; of: the document that has the first."""
    out = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("place", pa.int64()), ("n", pa.int32()), ("hash", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(k["doc_id"], i, k["place"], n, h) for i, n, h in spans(t, chars)]
                if len(rows) > 100_000:
                    yield batch(out, *zip(*rows))
                    rows = []
            if rows:
                yield batch(out, *zip(*rows))

    every = scratch.table(arrow_map(docs, run, "doc_id long, first int, place long, n int, hash binary"), "spans")
    place = F.struct("doc_id", "first", "place")
    groups = every.groupBy("hash").agg(F.count("*").alias("times"), F.min(place).alias("origin")).where("times > 1").select("hash", "origin")
    groups = scratch.table(groups, "repeated")
    again = every.join(groups, "hash").where(place != F.col("origin"))
    out = scratch.table(again.select(F.struct("doc_id", "place").alias("key"), "first", "n", F.col("origin.doc_id").alias("of")), "covered")
    scratch.drop(every, groups)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = SPAN_CHARS) -> DataFrame:
    """One row per document that loses sentences: doc_id, text (what is left), n_sentences, n_removed, chars_removed,
    repeats_of (sorted ids of the documents that keep the passages; the document itself if it repeats itself).

    Documents without a repeated span, null and empty texts have no row: they stay as they are. Sentences that go take
    the white space behind them along. Rows with a null id are not compared. Rows that share an id are documents of
    their own; of equal rows one keeps its sentences. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    texts = _keyed(docs, id_col, text_col, scratch)
    gone = covered(texts, scratch, chars)
    per_doc = gone.groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("gone"), F.sort_array(F.collect_set("of")).alias("repeats_of"))
    per_doc = scratch.table(per_doc, "by-document")
    mine = join_rows(texts, per_doc.select("key"), "key", scratch, "left_semi").join(per_doc, "key")  # other texts aren't moved
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("chars_removed", pa.int64()), ("repeats_of", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for d, t, gone, of in zip(*(c.to_pylist() for c in b.columns)):
                cut = sentences(t)
                drop = {k for x in gone for k in range(x["first"], x["first"] + x["n"])}
                kept, at = [], 0
                for k, (start, end) in enumerate(cut):
                    nxt = cut[k + 1][0] if k + 1 < len(cut) else len(t)
                    if k in drop:
                        kept.append(t[at:start])
                        at = nxt
                kept.append(t[at:])
                left = "".join(kept)
                rows.append((d, left, len(cut), len(drop), len(t) - len(left), of))
            yield batch(out, *zip(*rows)) if rows else batch(out, *[[] for _ in out])

    kind = "doc_id long, text string, n_sentences int, n_removed int, chars_removed long, repeats_of array<long>"
    return arrow_map(mine.select("key.doc_id", "text", "gone", "repeats_of"), run, kind)

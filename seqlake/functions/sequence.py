"""Column functions on sequences. Those of fixed tables stay in the JVM; packing is done by Arrow functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Complements (fixed values): standard IUPAC, and the variant in which S and W complement each other.
COMPLEMENT = {"standard": ("ABCDGHKMNRSTVWY", "TVGHCDMKNYSABWR"), "reference": ("ABCDGHKMNRSTVWY", "TVGHCDMKNYWABSR")}


def revcomp(seq: Column, iupac: str = "standard") -> Column:
    """Reverse complement; case is kept, other characters stay."""
    a, b = COMPLEMENT[iupac]
    return F.reverse(F.translate(seq, a + a.lower(), b + b.lower()))


def dna_text(seq: Column) -> Column:
    """Keeps A, C, G, T, N of either case and drops the rest."""
    return F.regexp_replace(seq, "[^ACGTNacgtn]", "")


def dna_ambiguous(seq: Column) -> Column:
    """Keeps IUPAC letters and gaps."""
    return F.regexp_replace(seq, "[^ABCDGHKMNRSTVWYabcdghkmnrstvwy-]", "")


def ambiguous_to_n(seq: Column) -> Column:
    a = "BDHKMRSVWY"
    return F.translate(F.regexp_replace(seq, "[^ABCDGHKMNRSTVWYabcdghkmnrstvwy]", ""), a + a.lower(), "N" * 10 + "n" * 10)


def to_index(seq: Column, n_as: str = "4") -> Column:
    """a, c, g, t as 0 to 3, n as 4 (or as n_as, "0" to pack)."""
    return F.translate(F.lower(dna_text(seq)), "acgtn", "0123" + n_as)


def from_index(seq: Column) -> Column:
    return F.translate(seq, "01234", "acgtn")


def is_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGTacgt]*$")


#: Sets of bases of the ambiguity codes, one bit for each of a, c, g, t (fixed values).
FOUR_BITS = {"-": 0, "a": 1, "c": 2, "m": 3, "g": 4, "r": 5, "s": 6, "v": 7, "t": 8, "w": 9, "y": 10, "h": 11, "k": 12, "d": 13, "b": 14, "n": 15}
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def _codes(seq: Column, letters: str, codes: list[int], fold: bool = True) -> Column:
    """array<int> of the codes of letters, others left out."""
    table = F.create_map(*[F.lit(x) for c, k in zip(letters, codes) for x in (c, k)])
    symbols = F.split(F.lower(seq) if fold else seq, "")
    return F.filter(F.transform(symbols, lambda c: F.element_at(table, c)), lambda k: k.isNotNull())


def to_index4(seq: Column) -> Column:
    """a, c, g, t and n as "0" to "3", n as "0": what two bits hold."""
    return to_index(seq, "0")


def to_four_bits(seq: Column, ambiguous: bool = False) -> Column:
    """array<int>: the set of bases of each letter; of a, c, g, t and n only, unless ambiguous."""
    use = {c: k for c, k in FOUR_BITS.items() if ambiguous or c in "acgtn"}
    return _codes(seq, "".join(use), list(use.values()))


def amino_index(seq: Column) -> Column:
    """array<int>: amino acids by their letters' order, X (and B and Z, which stand for two) 20; others are left out."""
    return _codes(amino_text(seq), AMINO + "X", list(range(21)), fold=False)


def amino_text(seq: Column) -> Column:
    """Amino acids in upper case, X for B, Z and X; other characters are left out."""
    return F.regexp_replace(F.translate(F.upper(seq), "BZ", "XX"), f"[^{AMINO}X]", "")


def first_mismatch(a: Column, b: Column) -> Column:
    """The first 0-based position at which two sequences of equal length differ; 0 if they are equal."""
    unlike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.greatest(F.array_position(unlike, True) - 1, F.lit(0))


def cut(seq: Column, start: Column, end: Column) -> Column:
    """0-based half-open substring."""
    return F.substr(seq, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


_RUN = re.compile("[ACGTacgt]+")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("run", T.StringType())])))
def contig_runs(seq: pd.Series) -> pd.Series:
    """array<struct<pos, run>>: maximal runs of a, c, g, t of either case with their 0-based positions, in one pass over
    each sequence (a fold over an array would copy what it has at every run)."""
    return seq.map(lambda s: None if s is None else [{"pos": m.start(), "run": m[0]} for m in _RUN.finditer(s)])


_BASE = np.zeros(256, bool)
_BASE[np.frombuffer(b"acgtACGT", np.uint8)] = True


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("len", T.LongType())])))
def contig_spans(seq: pa.Array) -> pa.Array:
    """array<struct<pos, len>>: where contig_runs() are, without their texts. The bytes of an Arrow batch are looked at all
    at once, as they lie in memory; positions count characters."""
    wide = pa.types.is_large_string(seq.type)
    gone = seq.is_null()
    ends = np.frombuffer(seq.buffers()[1], np.int64 if wide else np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64) if len(seq) else np.zeros(1, np.int64)
    data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    base = np.concatenate([[False], _BASE[data], [False]])
    border = np.zeros(len(data) + 1, bool)
    border[ends] = True
    change = base[1:] != base[:-1]
    first = np.flatnonzero((change | border) & base[1:])
    last = np.flatnonzero((change | border) & base[:-1])
    letter = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    text = np.searchsorted(ends, first, "right") - 1
    pos = letter[first] - letter[ends[text]]
    offsets = np.searchsorted(first, ends).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(pos.astype(np.int64)), pa.array((last - first).astype(np.int64))], names=["pos", "len"])
    return pa.ListArray.from_arrays(pa.array(offsets), runs, mask=gone)


def symbol_runs(seq: Column) -> Column:
    """Runs of one repeated symbol, in order."""
    return F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))


def quality_bits(qual: Column, threshold: int) -> Column:
    """1 where a quality reaches the threshold."""
    return F.transform(qual, lambda q: (q >= threshold).cast("int"))


def phred(text: Column) -> Column:
    """Qualities of a FASTQ line (Phred + 33)."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def parse_coordinates(text: Column) -> Column:
    """struct(id, start, end) of "id:start-end"; backslash escapes stay in the id, the end may be missing."""
    part = lambda k: F.regexp_extract(text, r"^((?:\\.|[^:\\])*):(\d+)(?:-(\d+))?$", k)
    number = lambda c: F.when(c != "", c.cast("long"))
    return F.struct(part(1).alias("id"), number(part(2)).alias("start"), number(part(3)).alias("end"))


def leading_integer(text: Column) -> Column:
    """The integer at the start of a label; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def short_name(text: Column) -> Column:
    """A name up to the first blank or tab."""
    return F.regexp_extract(text, "^[^ \t]*", 0)


def unescape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


_CODE = np.zeros(256, np.uint8)
for _k, _c in enumerate("acgt"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _k


def pack_bases(seq: str) -> bytes:
    """Two bits a base, base i in bits 2 (i mod 4) of byte i / 4; what isn't a, c, g, t becomes a."""
    x = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    x = np.pad(x, (0, -len(x) % 4)).reshape(-1, 4)
    return (x << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


def unpack_bases(packed: bytes, n: int) -> str:
    x = np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return np.frombuffer(b"acgt", np.uint8)[x.ravel()[:n]].tobytes().decode()


@F.pandas_udf(T.BinaryType())
def pack2bit(seq: pd.Series) -> pd.Series:
    return seq.map(lambda s: None if s is None else pack_bases(s))


@F.pandas_udf(T.StringType())
def unpack2bit(packed: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else unpack_bases(bytes(p), int(k)) for p, k in zip(packed, n)])


_SWAP = np.array([(3 - (b & 3)) << 6 | (3 - (b >> 2 & 3)) << 4 | (3 - (b >> 4 & 3)) << 2 | 3 - (b >> 6) for b in range(256)], np.uint8)


def packed_revcomp(packed: bytes, n: int) -> bytes:
    """Reverse complement of a packed sequence of n bases: bytes in reverse order by a table, then shifted over the
    unused places at what was the end."""
    x = _SWAP[np.frombuffer(packed, np.uint8)[::-1]]
    spare = 2 * (-n % 4)
    if spare:
        x = (x >> spare) | np.append(x[1:], 0).astype(np.uint8) << (8 - spare)
        x = x.astype(np.uint8)
        x[-1] &= (1 << (8 - spare)) - 1
    return x.tobytes()


@F.pandas_udf(T.BinaryType())
def revcomp2bit(packed: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else packed_revcomp(bytes(p), int(k)) for p, k in zip(packed, n)])


def pack_bits(bits: list[int]) -> bytes:
    """One bit each, the first lowest."""
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def unpack_bits(packed: bytes, n: int, low: int = 0, high: int = 1) -> list[int]:
    return [high if b else low for b in np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[:n]]

"""Reading and writing of typed line files, ASCII and binary, and a Spark data source of their lines.

A reader yields Line records; the data source `one` gives them as rows of LINES. Binary files carry an index of their
objects and are split between tasks at objects, each of which reads its own bytes; an ASCII file is one task, which
holds one block of it.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from seqlake.functions.sequence import pack_bases, unpack_bases
from seqlake.sources.huffman import Codec
from seqlake.sources.oneschema import HEADER, LISTS, LineType, Schema, add_definition, parse_schemas

LINES = (
    "file string, line_no long, type string, fields array<struct<i:bigint,r:double,c:string>>, list_str string, list_int array<bigint>, "
    "list_real array<double>, list_strs array<string>, comment string, object_ord long"
)
MAJOR, MINOR = 2, 1


@dataclass
class Line:
    type: str
    values: list  # one for each field; that of the list field is a str or a list
    comment: str | None = None


@dataclass
class Header:
    schema: Schema
    subtype: str | None = None
    text: list[str] = field(default_factory=list)
    provenance: list[tuple[str, ...]] = field(default_factory=list)
    references: list[tuple[str, int]] = field(default_factory=list)
    deferred: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    nested: dict[tuple[str, str, str], int] = field(default_factory=dict)  # (object type, # or +, type): most in one object
    index: dict[str, list[int]] = field(default_factory=dict)
    codecs: dict[str, Codec] = field(default_factory=dict)
    binary: bool = False
    data_start: int = 0
    data_end: int = 0


def varint(v: int) -> bytes:
    """1 byte for -64 to 63, 2 for 64 to 8191, else a length byte and little-endian bytes."""
    if 0 <= v < 64:
        return bytes([0x40 | v])
    if 0 <= v < 8192:
        return bytes([0x20 | v >> 8, v & 255])
    if -64 <= v < 0:
        return bytes([v & 255])
    for n in range(2, 9):
        if -(1 << 8 * n - 1) <= v < 1 << 8 * n - 1:
            return bytes([(0x80 if v < 0 else 0) | n - 1]) + v.to_bytes(n, "little", signed=True)
    raise OverflowError(v)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    x = b[at]
    if x & 0xC0 == 0x40:
        return x & 0x3F, at + 1
    if x & 0xC0 == 0xC0:
        return x - 256, at + 1
    if x & 0xE0 == 0x20:
        return (x & 0x1F) << 8 | b[at + 1], at + 2
    n = (x & 0x1F) + 1
    return int.from_bytes(b[at + 1 : at + 1 + n], "little", signed=True), at + 1 + n


def split_ints(values: list[int]) -> tuple[bytes, bytes]:
    """Binary form of a list: the first value and the width of the differences; the differences."""
    if len(values) < 2:
        return (varint(values[0]) if values else b""), b""
    d = [y - x for x, y in zip(values, values[1:])]
    n = next(k for k in range(1, 9) if all(-(1 << 8 * k - 1) <= x < 1 << 8 * k - 1 for x in d))
    return varint(values[0]) + bytes([n]), b"".join(x.to_bytes(n, "little", signed=True) for x in d)


def compact_ints(values: list[int]) -> bytes:
    return b"".join(split_ints(values))


def expand_ints(first: int, width: int, diffs: bytes) -> list[int]:
    out = [first]
    for k in range(0, len(diffs), width):
        out.append(out[-1] + int.from_bytes(diffs[k : k + width], "little", signed=True))
    return out


class FileBytes:
    """A file that is sliced like bytes but read in blocks, as far as it is looked at (headers and footers)."""

    BLOCK = 1 << 16

    def __init__(self, file):
        self.file, self.blocks = file, {}
        self.size = file.seek(0, os.SEEK_END)

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) > 64:
                self.blocks.clear()
            self.file.seek(k * self.BLOCK)
            self.blocks[k] = self.file.read(self.BLOCK)
        return self.blocks[k]

    def __getitem__(self, key):
        if isinstance(key, int):
            key += self.size if key < 0 else 0
            return self._block(key // self.BLOCK)[key % self.BLOCK]
        a, b, _ = key.indices(self.size)
        if a // self.BLOCK == (b - 1) // self.BLOCK:
            return self._block(a // self.BLOCK)[a % self.BLOCK : a % self.BLOCK + b - a] if b > a else b""
        self.file.seek(a)
        return self.file.read(max(0, b - a))

    def find(self, what: bytes, start: int = 0) -> int:
        at = start
        while at < self.size:
            part = self[at : (at // self.BLOCK + 1) * self.BLOCK]
            if (k := part.find(what)) >= 0:
                return at + k
            at += len(part)
        return -1

    def partition(self, what: bytes) -> tuple[bytes, bytes, bytes]:
        """The first line only: what is behind it isn't read."""
        k = self.find(what)
        return (self[:k], what, b"") if k >= 0 else (self[:], b"", b"")


class Parser:
    """Lines of one file held as bytes, or of a part of one whose first byte has offset base."""

    def __init__(self, data: bytes | FileBytes, type: str | None = None, schema: Schema | None = None):
        self.data, self.at, self.line, self.base = data, 0, 0, 0
        self.wanted: set[str] | None = None  # line types whose lists are decoded; None: all
        if data[:2] == b"1 ":
            first, _, _ = data.partition(b"\n")
            parts = first.decode().split(" ")
            if len(parts) < 5 or not int(parts[1]):
                raise ValueError("line 1: type name, major and minor version expected")
            if int(parts[3]) != MAJOR or int(parts[4]) > MINOR:
                raise ValueError(f"version {parts[3]}.{parts[4]} can't be read")
            self.header = Header(Schema(parts[2]))
            self.at = len(first) + 1
            self._read_header()
        elif schema is None:
            raise ValueError("a file without header needs a type and a schema")
        else:
            self.header = Header(schema, data_end=len(data))
        self.header.data_start = self.at
        if schema is not None and self.header.schema is not schema:
            self.header.schema.check_against(schema, set(self.header.counts) or None)

    def _fail(self, what: str):
        raise ValueError(f"line {self.line}: {what}")

    def _blank(self) -> None:
        if self.data[self.at : self.at + 1] != b" ":
            self._fail("a single space has to stand between items")
        self.at += 1

    def _item(self) -> bytes:
        self._blank()
        k = self.at
        while k < len(self.data) and self.data[k] not in b" \n\r\t\0":
            k += 1
        if k - self.at > 31:
            self._fail("overlong item")
        if k == self.at:
            self._fail("an item is missing")
        out, self.at = self.data[self.at : k], k
        return out

    def _bytes(self, n: int) -> bytes:
        self._blank()
        out = self.data[self.at : self.at + n]
        if len(out) < n or (b"\n" in out and not self.header.binary and self.line_type != "~"):
            self._fail("line too short")
        self.at += n
        return out

    def _ascii(self, letter: str, kinds: tuple[str, ...]) -> Line:
        self.line_type, values = letter, []
        for kind in kinds:
            if kind == "INT":
                values.append(int(self._item()))
            elif kind == "REAL":
                values.append(float(self._item()))
            elif kind == "CHAR":
                self._blank()
                values.append(chr(self.data[self.at]))
                self.at += 1
            else:
                n = int(self._item())
                if kind in ("STRING", "DNA"):
                    values.append(self._bytes(n).decode("utf-8", "surrogateescape") if n or self.data[self.at : self.at + 1] == b" " else "")
                elif kind == "STRING_LIST":
                    values.append([self._bytes(int(self._item())).decode("utf-8", "surrogateescape") for _ in range(n)])
                else:
                    values.append([(int if kind == "INT_LIST" else float)(self._item()) for _ in range(n)])
        end = self.data.find(b"\n", self.at)
        end = len(self.data) if end < 0 else end
        rest = self.data[self.at : end]
        if rest and rest[:1] != b" ":
            self._fail("a comment has to follow a space")
        self.at = end + 1
        return Line(letter, values, rest[1:].decode("utf-8", "surrogateescape") or None)

    def _binary(self, byte: int, kinds: tuple[str, ...], letter: str) -> Line:
        values, size, kind = [], None, None
        lazy = self.wanted is not None and letter not in self.wanted and letter not in HEADER
        for f in kinds:
            if f == "REAL":
                values.append(struct.unpack("<d", self.data[self.at : self.at + 8])[0])
                self.at += 8
            elif f == "CHAR":
                values.append(chr(self.data[self.at]))
                self.at += 1
            else:
                v, self.at = read_varint(self.data, self.at)
                if f in LISTS:
                    size, kind = v, f
                    values.append(None)
                else:
                    values.append(v)
        if kind is not None:
            values[values.index(None)] = self._list(kind, size, byte & 1, letter, lazy)
        return Line(letter, values)

    def _take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def _list(self, kind: str, size: int, packed: int, letter: str, lazy: bool = False):
        """The list field; a lazy one is stepped over by its length and never decoded."""
        if not size:
            return "" if kind in ("STRING", "DNA") else []
        if kind == "STRING_LIST":
            return [self._bytes(int(self._item())).decode("utf-8", "surrogateescape") for _ in range(size)]
        first = width = None
        if kind == "INT_LIST":
            first, self.at = read_varint(self.data, self.at)
            if size == 1:
                return [first]
            width = self._take(1)[0]
        n = {"STRING": size, "DNA": size, "REAL_LIST": 8 * size}.get(kind) or width * (size - 1)
        if packed:
            bits, self.at = read_varint(self.data, self.at)
            if lazy:
                self.at += (bits + 7) // 8
                return None
            raw = self._take((bits + 7) // 8)
            if kind == "DNA":
                return unpack_bases(raw, size)
            raw = self.header.codecs[letter].decode(raw, bits, n)
        elif lazy:
            self.at += n
            return None
        else:
            raw = self._take(n)
        if kind == "INT_LIST":
            return expand_ints(first, width, raw)
        if kind == "REAL_LIST":
            return list(struct.unpack(f"<{size}d", raw))
        return raw.decode("utf-8", "surrogateescape")

    def _next(self) -> Line | None:
        """The next line, comments of binary files attached; None at the end of the data."""
        if self.at >= len(self.data) or self.data[self.at] == 10 and self.header.binary:
            return None
        self.line += 1
        byte = self.data[self.at]
        self.at += 1
        letter = letter_of(byte) if byte & 0x80 else chr(byte)
        kinds = HEADER[letter] if letter in HEADER else self.header.schema.lines[letter].fields if letter in self.header.schema.lines else None
        if kinds is None:
            self._fail(f"unknown line type {letter!r}")
        if byte & 0x80:
            return self._binary(byte, kinds, letter)
        if self.wanted is not None and letter not in self.wanted and letter not in HEADER:
            end = self.data.find(b"\n", self.at)
            self.at = len(self.data) if end < 0 else end + 1
            return Line(letter, [None] * len(kinds))
        return self._ascii(letter, kinds)

    def _read_header(self) -> None:
        h, back = self.header, None
        h.data_end = len(self.data)
        while self.at < len(self.data):
            b = self.data[self.at]
            letter = letter_of(b) if b & 0x80 else chr(b)
            if letter.isalpha() or letter == "\n":
                break
            x = self._next()
            v = x.values
            if letter == "2":
                h.subtype = v[0]
            elif letter == "." and x.comment:
                h.text.append(x.comment)
            elif letter == "~":
                if v[0] == "G":
                    h.schema.group(v[1])
                else:
                    h.schema.add(v[0], v[1], tuple(v[2]), x.comment or "")
            elif letter in "#@+":
                {"#": h.counts, "@": h.longest, "+": h.totals}[letter][v[0]] = v[1]
            elif letter == "%":
                h.nested[v[0], v[1], v[2]] = v[3]
            elif letter == "!":
                h.provenance.append(tuple(v[0]))
            elif letter == "<":
                h.references.append((v[0], v[1]))
            elif letter == ">":
                h.deferred.append(v[0])
            elif letter == "$":
                if v[0]:
                    raise ValueError("big-endian binary file: convert it to ASCII")
                h.binary, back = True, self.at
                self.at = struct.unpack("<q", self.data[-8:])[0]
                h.data_end = self.at
            elif letter == "&":
                h.index[v[0]] = v[1]
            elif letter == ";":
                h.codecs[v[0]] = Codec.load(v[1].encode("utf-8", "surrogateescape"))
            elif letter == "^":
                self.at = back

    def lines(self, start: int | None = None, end: int | None = None, last: bool = True) -> Iterator[tuple[int, Line]]:
        """(byte offset, line) of data lines from start to end; unless last, the final line is kept for the next call,
        because a comment of it may follow."""
        self.at = (self.header.data_start if start is None else start) - self.base
        end = (self.header.data_end if end is None else end) - self.base
        held, self.held = getattr(self, "held", None), None
        while self.at < end:
            at = self.at + self.base
            x = self._next()
            if x is None:
                break
            if x.type == "/":
                if held:
                    held[1].comment = x.values[0]
                continue
            if held:
                yield held
            held = (at, x)
        if last and held:
            yield held
        elif held:
            self.held = held

    def read_range(self, file, start: int, end: int, block: int = 8 << 20) -> Iterator[tuple[int, Line]]:
        """lines() of a byte range of the open file: an ASCII range is read a block of whole lines at a time, a binary
        one (cut at objects, see OneReader.partitions) at once."""
        if self.header.binary:
            file.seek(start)
            self.data, self.base = file.read(end - start), start
            yield from self.lines(start, end)
            return
        at, rest = start, b""
        file.seek(start)
        while at < end or rest:
            part = file.read(min(block, end - at))
            at += len(part)
            data = rest + part
            cut = data.rfind(b"\n") + 1 if part and at < end else len(data)
            self.data, self.base, rest = data[:cut], at - len(data), data[cut:]
            yield from self.lines(self.base, self.base + cut, last=at >= end)
            if not part:
                break


def letter_of(byte: int) -> str:
    k = (byte & 0x7F) >> 1
    if k < 26:
        return chr(65 + k)
    if k < 52:
        return chr(71 + k)
    return {0xE8: ";", 0xEA: "&", 0xEC: "/", 0xEE: "."}[byte & 0xFE]


def byte_of(letter: str) -> int:
    if letter in ";&/.":
        return {";": 0xE8, "&": 0xEA, "/": 0xEC, ".": 0xEE}[letter]
    return 0x80 | (ord(letter) - 65 if letter.isupper() else ord(letter) - 71) << 1


def _text_value(kind: str, v) -> str:
    if kind == "INT":
        return str(v)
    if kind == "REAL":
        return f"{v:.6f}"
    if kind == "CHAR":
        return v
    if kind in ("STRING", "DNA"):
        return f"{len(v.encode('utf-8', 'surrogateescape'))} {v}"
    if kind == "STRING_LIST":
        return " ".join([str(len(v)), *(f"{len(x.encode('utf-8', 'surrogateescape'))} {x}" for x in v)])
    return " ".join([str(len(v)), *(str(x) if kind == "INT_LIST" else f"{x:.6f}" for x in v)])


def ascii_line(line: Line, kinds: tuple[str, ...]) -> str:
    return " ".join([line.type, *(_text_value(k, v) for k, v in zip(kinds, line.values, strict=True)), *([line.comment] if line.comment else [])])


def list_body(kind: str, v) -> tuple[bytes, bytes]:
    """Binary form of a list in two: what always stands as it is, and the bytes that a codec compresses."""
    if kind == "STRING":
        return b"", v.encode("utf-8", "surrogateescape")
    if kind == "INT_LIST":
        return split_ints(v)
    if kind == "REAL_LIST":
        return b"", struct.pack(f"<{len(v)}d", *v)
    return "".join(f" {len(x.encode())} {x}" for x in v).encode(), b""  # STRING_LIST


def binary_line(line: Line, kinds: tuple[str, ...], codec: Codec | None = None) -> bytes:
    """DNA takes two bits a base; other lists go through the codec of their line type, if it has one."""
    head, body, packed = b"", b"", 0
    for kind, v in zip(kinds, line.values, strict=True):
        if kind == "INT":
            head += varint(v)
        elif kind == "REAL":
            head += struct.pack("<d", v)
        elif kind == "CHAR":
            head += v.encode("latin-1")
        else:
            head += varint(len(v.encode("utf-8", "surrogateescape")) if isinstance(v, str) else len(v))
            if kind == "DNA":
                packed, body = (1, varint(2 * len(v)) + pack_bases(v)[: (2 * len(v) + 7) // 8]) if v else (0, b"")
            else:
                first, raw = list_body(kind, v)
                if codec is not None and raw:
                    data, bits = codec.encode(raw)
                    packed, raw = 1, varint(bits) + data
                body = first + raw
    out = bytes([byte_of(line.type) | packed]) + head + body
    if line.comment:
        c = line.comment.encode("utf-8", "surrogateescape")
        out += bytes([byte_of("/")]) + varint(len(c)) + c
    return out


Counts = dict[tuple[str, str], int]  # (# or +, type): lines, or list elements


def _added(a: Counts, b: Counts) -> Counts:
    return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}


def _most(a: Counts, b: Counts) -> Counts:
    return {k: max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys()}


@dataclass
class Stretch:
    """What a stretch of lines says about the objects of one type: head, the counts before any of them begins or ends (they
    belong to one that is open before the stretch); most, the maxima of those that begin and end inside; tail, the counts of
    the one still open at the end, None if there is none; ended: whether any begins or ends at all. then() is associative."""

    head: Counts = field(default_factory=dict)
    most: Counts = field(default_factory=dict)
    tail: Counts | None = None
    ended: bool = False

    def add(self, one: Counts) -> None:
        if not self.ended:
            self.head = _added(self.head, one)
        elif self.tail is not None:
            self.tail = _added(self.tail, one)

    def end(self, begins: bool) -> None:
        self.most = _most(self.most, self.tail or {})
        self.tail, self.ended = ({} if begins else None), True

    def then(self, after: Stretch) -> Stretch:
        if not after.ended:
            if not self.ended:
                return Stretch(_added(self.head, after.head))
            return Stretch(self.head, self.most, None if self.tail is None else _added(self.tail, after.head), True)
        if not self.ended:
            return Stretch(_added(self.head, after.head), after.most, after.tail, True)
        across = {} if self.tail is None else _added(self.tail, after.head)
        return Stretch(self.head, _most(_most(self.most, after.most), across), after.tail, True)


class Nested:
    """The most lines, and list elements, of each type inside one object of each type that contains them. Those of stretches
    of a file, cut anywhere, join to those of the whole: then()."""

    def __init__(self, schema: Schema, of: dict[str, Stretch] | None = None):
        self.schema = schema
        self.inside = {k: schema.contained(k) - {k} for k, x in schema.lines.items() if x.kind == "O"}
        self.of = of or {k: Stretch() for k in self.inside}

    def add(self, letter: str, size: int) -> None:
        for k, inside in self.inside.items():
            if letter == k:
                self.of[k].end(True)
            elif letter in inside:
                self.of[k].add({("#", letter): 1, ("+", letter): size})
            elif letter in self.inside:
                self.of[k].end(False)

    def then(self, after: Nested) -> Nested:
        return Nested(self.schema, {k: x.then(after.of[k]) for k, x in self.of.items()})

    def maxima(self) -> dict[tuple[str, str, str], int]:
        """Of a whole file: what stands before the first object belongs to none."""
        return {(k, sign, letter): n for k, x in self.of.items() for (sign, letter), n in _most(x.most, x.tail or {}).items() if n}

    def text(self) -> list[str]:
        return nested_text(self.maxima())


def joined(parts: list[Nested]) -> Nested:
    """then() of all, as a tree."""
    while len(parts) > 1:
        parts = [parts[k].then(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def nested_text(most: dict[tuple[str, str, str], int]) -> list[str]:
    return [f"% {k} {sign} {letter} {n}" for (k, sign, letter), n in sorted(most.items())]


class Encoder:
    """Writes a typed line file line after line: a binary one at once, with counts and index behind the data; the data
    of an ASCII one into a spare file first, because its counts stand in front."""

    def __init__(self, path: str, schema: Schema, binary: bool = False, header: Header | None = None):
        self.path, self.schema, self.binary = path, schema, binary
        self.stats: dict[str, tuple[int, int, int]] = {}
        self.nested = Nested(schema)
        h = header or Header(schema)
        self.codecs = h.codecs
        out = [f"1 {len(schema.primary)} {schema.primary} {MAJOR} {MINOR}"]
        if h.subtype:
            out.append(f"2 {len(h.subtype)} {h.subtype}")
        out += [f". {t}" for t in h.text]
        out += ["! " + _text_value("STRING_LIST", list(p)) for p in h.provenance]
        out += [f"< {_text_value('STRING', f)} {n}" for f, n in h.references] + [f"> {_text_value('STRING', f)}" for f in h.deferred]
        for letter, line in schema.lines.items():
            out.append(f"~ {line.kind} {letter} {_text_value('STRING_LIST', list(line.fields))}" + (f" {line.comment}" if line.comment else ""))
            out += [f"~ G {m} 0" for m in schema.groups.get(letter, [])]
        self.head = out
        self.file = open(path if binary else path + ".data", "wb")
        if binary:
            self.file.write("\n".join([*out, "$ 0", ""]).encode("utf-8", "surrogateescape"))
            self.start = self.file.tell()
            self.index: dict[str, list[int]] = {}

    def add(self, x: Line) -> None:
        line = self.schema.lines[x.type]
        if self.binary:
            if line.kind == "O":
                self.index.setdefault(x.type, [self.start]).append(self.file.tell())
            self.file.write(binary_line(x, line.fields, self.codecs.get(x.type)))
        else:
            self.file.write(ascii_line(x, line.fields).encode("utf-8", "surrogateescape") + b"\n")
        n = next((len(v.encode("utf-8", "surrogateescape")) if isinstance(v, str) else len(v) for k, v in zip(line.fields, x.values) if k in LISTS), 0)
        c, m, t = self.stats.get(x.type, (0, 0, 0))
        self.stats[x.type] = (c + 1, max(m, n), t + n)
        self.nested.add(x.type, n)

    def close(self) -> None:
        counts = counts_text(self.stats) + self.nested.text()
        if self.binary:
            self.file.write(footer(self.file.tell(), counts, {k: self.index[k] for k in self.schema.lines if k in self.index}, {k: c for k, c in self.codecs.items() if k in self.stats}))
            self.file.close()
            return
        self.file.close()
        with open(self.path, "wb") as f, open(self.path + ".data", "rb") as data:
            f.write("\n".join([*self.head, *counts, ".", ""]).encode("utf-8", "surrogateescape"))
            shutil.copyfileobj(data, f)
        os.remove(self.path + ".data")


def counts_text(stats: dict[str, tuple[int, int, int]]) -> list[str]:
    return [f"{s} {k} {v}" for k, x in sorted(stats.items()) for s, v in zip("#@+", x) if s == "#" or x[1]]


def footer(end: int, counts: list[str], index: dict[str, list[int]], codecs: dict[str, Codec] | None = None) -> bytes:
    """What follows the data of a binary file whose last byte has offset end - 1."""
    out = b"\n" + "".join(c + "\n" for c in counts).encode()
    for k, at in index.items():
        out += bytes([byte_of("&")]) + k.encode() + varint(len(at)) + compact_ints(at)
    for k, c in (codecs or {}).items():
        serial = c.dump()
        out += bytes([byte_of(";")]) + k.encode() + varint(len(serial)) + serial
    return out + b"^\n" + struct.pack("<q", end + 1)


def encode_file(schema: Schema, lines: Iterable[Line], binary: bool = False, header: Header | None = None) -> bytes:
    """A whole small file; header gives subtype, provenance, references and deferred files."""
    with tempfile.TemporaryDirectory() as d:
        e = Encoder(f"{d}/x", schema, binary, header)
        for x in lines:
            e.add(x)
        e.close()
        with open(f"{d}/x", "rb") as f:
            return f.read()


def statistics(schema: Schema, lines: Iterable[Line]) -> dict[str, tuple[int, int, int]]:
    """(count, max, total) of list lengths by line type."""
    out: dict[str, tuple[int, int, int]] = {}
    for x in lines:
        kinds = schema.lines[x.type].fields
        n = next((len(v.encode("utf-8", "surrogateescape")) if isinstance(v, str) else len(v) for k, v in zip(kinds, x.values) if k in LISTS), 0)
        c, m, t = out.get(x.type, (0, 0, 0))
        out[x.type] = (c + 1, max(m, n), t + n)
    return out


def read_header(path: str, type: str | None = None, schema: Schema | None = None) -> Header:
    """Header, and footer of a binary file, without the data between them."""
    with open(path, "rb") as f:
        return Parser(FileBytes(f), type, schema).header


@dataclass
class Joined:
    """How parts become one file: pieces are (part, first byte, bytes, place in the file); head and foot stand around them."""

    head: bytes
    pieces: list[tuple[str, int, int, int]]
    foot: bytes
    size: int  # without the footer


def join_plan(parts: list[str], nested: list[Nested] | None = None) -> Joined:
    """From headers and footers alone: counts summed, maxima taken, the object index shifted. Maxima inside objects need
    nested, the statistics of each part (a writer gives them) if an object goes on from one part into the next, and are
    left out without. Parts have one schema, one header and the same codecs."""
    heads = [read_header(p) for p in parts]
    schema = heads[0].schema
    outer = {k for k, x in schema.lines.items() if x.kind == "O" and not any(k in schema.contained(o) for o, y in schema.lines.items() if y.kind == "O" and o != k)}
    codecs: dict[str, Codec] = {}
    most: dict[tuple[str, str, str], int] = {}
    whole = True
    stats: dict[str, tuple[int, int, int]] = {}
    index: dict[str, list[int]] = {}
    pieces, at = [], heads[0].data_start
    for path, h in zip(parts, heads):
        with open(path, "rb") as part:
            if path == parts[0]:
                head = part.read(h.data_start)
            part.seek(h.data_start)
            first = part.read(1)[0]
        whole = whole and (path == parts[0] or (letter_of(first) if first & 0x80 else chr(first)) in outer)
        size, shift = h.data_end - 1 - h.data_start, at - h.data_start  # without the empty line that ends the data
        pieces.append((path, h.data_start, size, at))
        at += size
        for k, x in h.index.items():
            index.setdefault(k, [heads[0].data_start]).extend(y + shift for y in x[1:])
        for k, n in h.counts.items():
            c, m, t = stats.get(k, (0, 0, 0))
            stats[k] = (c + n, max(m, h.longest.get(k, 0)), t + h.totals.get(k, 0))
        for key, n in h.nested.items():
            most[key] = max(n, most.get(key, 0))
        for k, c in h.codecs.items():
            if codecs.setdefault(k, c).dump() != c.dump():
                raise ValueError(f"parts compress lines {k} with different codes")
    if nested is not None:
        most, whole = joined(nested).maxima(), True
    index = {k: index[k] for k in schema.lines if k in index}
    codecs = {k: codecs[k] for k in schema.lines if k in codecs}
    return Joined(head, pieces, footer(at, counts_text(stats) + (nested_text(most) if whole else []), index, codecs), at)


def _copy(part: str, start: int, size: int, out, block: int = 8 << 20) -> None:
    with open(part, "rb") as f:
        f.seek(start)
        while size:
            data = f.read(min(size, block))
            out.write(data)
            size -= len(data)


def merge_files(parts: list[str], out: str, nested: list[Nested] | None = None) -> None:
    """One file of binary parts, their lines in the order of the parts: join_plan(), copied by this process."""
    plan = join_plan(parts, nested)
    with open(out + ".tmp", "wb") as f:
        f.write(plan.head)
        for part, start, size, _ in plan.pieces:
            _copy(part, start, size, f)
        f.write(plan.foot)
    os.replace(out + ".tmp", out)


def merge_parts(spark, parts: list[str], out: str, nested: list[Nested] | None = None, block: int = 64 << 20) -> None:
    """merge_files() by tasks: each copies blocks of the parts to their places in the file (on a mounted folder), again if
    it is run again; the driver writes head and footer only."""
    plan = join_plan(parts, nested)
    with open(out + ".tmp", "wb") as f:
        f.write(plan.head)
        f.seek(plan.size)
        f.write(plan.foot)
    rows = [(part, start + k, min(block, size - k), at + k) for part, start, size, at in plan.pieces for k in range(0, size, block)]

    def copy(batches):
        import pyarrow as pa

        for b in batches:
            done = 0
            for part, start, size, at in zip(*(c.to_pylist() for c in b.columns)):
                with open(out + ".tmp", "r+b") as f:
                    f.seek(at)
                    _copy(part, start, size, f)
                done += size
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["bytes"])

    if rows:
        todo = spark.createDataFrame(rows, "part string, start long, size long, at long").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
        copied = todo.mapInArrow(copy, "bytes long").groupBy().sum("bytes").first()[0]
        if copied != sum(r[2] for r in rows):
            raise OSError("not all bytes were copied")
    os.replace(out + ".tmp", out)


def byte_histograms(lines, schema: Schema):
    """(type, byte, n) of typed lines (LINES): how often each byte stands in what a codec of the line type compresses.
    Counted batch by batch, then summed; a row for each type and byte."""
    kinds = {k: next((f for f in x.fields if f in ("STRING", "INT_LIST", "REAL_LIST")), None) for k, x in schema.lines.items()}
    column = {"STRING": "list_str", "INT_LIST": "list_int", "REAL_LIST": "list_real"}

    def count(batches):
        import pyarrow as pa

        for b in batches:
            seen: dict[str, np.ndarray] = {}
            lists = {c: b.column(c).to_pylist() for c in column.values()}
            for k, letter in enumerate(b.column("type").to_pylist()):
                kind = kinds.get(letter)
                v = lists[column[kind]][k] if kind else None
                if v:
                    seen[letter] = seen.get(letter, 0) + np.bincount(np.frombuffer(list_body(kind, v)[1], np.uint8), minlength=256)
            got = [(t, x, int(n)) for t, h in seen.items() for x, n in enumerate(h) if n]
            yield pa.RecordBatch.from_pylist([{"type": t, "byte": x, "n": n} for t, x, n in got], pa.schema([("type", pa.string()), ("byte", pa.int32()), ("n", pa.int64())]))

    from pyspark.sql import functions as F

    return lines.select("type", *column.values()).mapInArrow(count, "type string, byte int, n long").groupBy("type", "byte").agg(F.sum("n").alias("n"))


def train_codecs(lines, schema: Schema) -> dict[str, Codec]:
    """A codec for each line type with a list to compress, from the bytes of all lines; 256 counts a type are collected."""
    counts: dict[str, list[int]] = {}
    for r in byte_histograms(lines, schema).collect():
        counts.setdefault(r.type, [0] * 256)[r.byte] = r.n
    return {k: Codec.of_histogram(h) for k, h in counts.items()}


def codecs_option(codecs: dict[str, Codec]) -> str:
    """For the writer's option codecs."""
    return json.dumps({k: c.dump().hex() for k, c in codecs.items()})


def write_compressed(lines, path: str, schema_text: str, type: str | None = None, **options) -> None:
    """Writes lines (LINES, sorted in their partitions) as binary files with compressed lists, one code for all tasks."""
    schemas = parse_schemas(schema_text)
    codecs = train_codecs(lines, schemas[type] if type else next(iter(schemas.values())))
    w = lines.write.format("one").mode("append").option("schema_text", schema_text).option("binary", "true").option("codecs", codecs_option(codecs))
    for k, v in (options | ({"type": type} if type else {})).items():
        w = w.option(k, v)
    w.save(path)


def resolve(path: str, type: str | None = None) -> list[str]:
    """Files of a path: itself, a folder's, a pattern's, or with ".<type>" or ".1<type>" behind it."""
    for p in [path, *([f"{path}.{type}", f"{path}.1{type}"] if type else [])]:
        if os.path.isdir(p):
            return sorted(x for x in glob.glob(f"{p}/*") if not os.path.basename(x).startswith(("_", ".")))
        if found := sorted(glob.glob(p)):
            return found
    raise FileNotFoundError(path)


def _row(file: str, n: int, x: Line, kinds: tuple[str, ...], obj: int) -> tuple:
    plain, lists = [], {"STRING": None, "INT_LIST": None, "REAL_LIST": None, "STRING_LIST": None}
    for k, v in zip(kinds, x.values):
        if k in LISTS:
            lists["STRING" if k == "DNA" else k] = v
        plain.append((v if k == "INT" else None, v if k == "REAL" else None, v if k == "CHAR" else None))
    return (file, n, x.type, plain, lists["STRING"], lists["INT_LIST"], lists["REAL_LIST"], lists["STRING_LIST"], x.comment, obj)


class _Part(InputPartition):
    def __init__(self, file: str, start: int | None, end: int | None, first: int):
        self.file, self.start, self.end, self.first = file, start, end, first


class OneReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.type = options["path"], options.get("type")
        self.wanted = set(options["lines"].replace(",", "")) if options.get("lines") else None  # prunes line types
        self.object = options.get("object")  # the object type to number and to split by
        self.splits, self.split_bytes = int(options.get("splits", "8")), int(options.get("split_bytes", str(64 << 20)))
        self.first, self.stop = int(options.get("from", "0")), int(options.get("to", "0")) or None  # objects to read, half-open
        self.only: set[int] | None = None  # of these, if a filter names them
        self.block = int(options.get("ascii_block", "0"))  # bytes of a part of an ASCII file, see read_ascii()
        schemas = parse_schemas(options["schema_text"]) if options.get("schema_text") else {}
        self.schema_ = schemas.get(self.type) if self.type else next(iter(schemas.values()), None)

    def _letter(self, h: Header) -> str | None:
        return self.object or next((k for k, x in h.schema.lines.items() if x.kind == "O"), None)

    def _runs(self, count: int) -> list[tuple[int, int]]:
        """Wanted ordinals from 0 (what stands before the first object) to count, as half-open ranges."""
        lo, hi = max(0, self.first), count + 1 if self.stop is None else min(self.stop, count + 1)
        if self.only is None:
            return [(lo, hi)] if lo < hi else []
        out: list[tuple[int, int]] = []
        for k in sorted(k for k in self.only if lo <= k < hi):
            if out and out[-1][1] == k:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((k, k + 1))
        return out

    def _wants(self, obj: int) -> bool:
        return self.first <= obj and (self.stop is None or obj < self.stop) and (self.only is None or obj in self.only)

    def partitions(self):
        """Binary files are cut at objects; header and footer are all that is read for it. Parts without a wanted object
        aren't read at all."""
        out = []
        some = self.first > 0 or self.stop is not None or self.only is not None
        for file in resolve(self.path, self.type):
            h = read_header(file, self.type, self.schema_)
            at = h.index.get((self._letter(h) if some else self.object) or "", [])
            if h.binary and len(at) > 1 and (len(at) > self.splits or some):
                starts = [*at, h.data_end]  # of ordinal 0, 1, ... and the end
                splits = max(self.splits, (h.data_end - h.data_start) // self.split_bytes)
                for lo, hi in self._runs(len(at) - 1):
                    n = max(1, min(hi - lo, splits * (hi - lo) // len(at)))
                    cuts = sorted({lo + k * (hi - lo) // n for k in range(n)})
                    out += [_Part(file, starts[a], starts[b], max(0, a - 1)) for a, b in zip(cuts, [*cuts[1:], hi]) if starts[a] < starts[b]]
            elif not h.binary and self.block:
                out += [_Part(file, k, k + self.block, 0) for k in range(h.data_start // self.block * self.block, h.data_end, self.block)]
            else:
                out.append(_Part(file, None, None, 0))
        return out

    def read(self, part: _Part | None):
        if part is None:  # what Spark gives where there are no partitions
            return
        with open(part.file, "rb") as f:
            p, obj, n = Parser(FileBytes(f), self.type, self.schema_), part.first, 0
            p.wanted = self.wanted
            h = p.header
            letter = self._letter(h)
            start, end = (h.data_start, h.data_end) if part.start is None else (part.start, part.end)
            if not h.binary and part.start is not None:  # lines that begin in the block; no string of an ASCII file holds a line end
                start, end = (line_start(p.data, max(x, h.data_start), h) for x in (start, end))
            for at, x in p.read_range(f, start, end):
                n += 1
                obj += x.type == letter
                if (self.wanted is None or x.type in self.wanted) and (self.block or self._wants(obj)):
                    yield _row(part.file, at if part.start is not None else n, x, h.schema.lines[x.type].fields, obj)


def line_start(data: FileBytes, at: int, h: Header) -> int:
    """The first place from at on where a line of the data begins."""
    if at <= h.data_start or at >= h.data_end:
        return max(h.data_start, min(at, h.data_end))
    k = data.find(b"\n", at - 1)
    return h.data_end if k < 0 else k + 1


def read_ascii(spark, path: str, block: int = 64 << 20, **options):
    """Lines of ASCII files (LINES), each file by many tasks: a task scans the lines that begin in its block, and numbers the
    objects among them; the blocks' counts, a row each, are summed to number them through. line_no is the byte
    where a line begins. Options are those of the source but for lines of objects (from, to, pushdown)."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window

    from seqlake.operators.coords import dimension

    if options.keys() & {"from", "to", "pushdown"}:
        raise ValueError("objects of an ASCII file are numbered after reading: filter the result")
    wanted = options.get("lines")
    if wanted:  # objects are counted by their own lines
        if not options.get("object"):
            raise ValueError("lines needs the object type that numbers go by")
        options["lines"] = wanted + options["object"]
    lines = spark.read.format("one").options(ascii_block=str(block), **options).load(path)
    part = F.expr(f"line_no div {block}")
    per = lines.groupBy("file", part.alias("part")).agg(F.max("object_ord").alias("n"))
    before = per.select("file", "part", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = lines.withColumn("part", part).join(dimension(before), ["file", "part"])
    out = joined.withColumn("object_ord", F.col("object_ord") + F.col("before")).select(*lines.columns)
    return out.where(F.col("type").isin(*wanted.replace(",", ""))) if wanted else out


class PushingReader(OneReader):
    """Comparisons of object_ord with numbers become the objects, and so the bytes, to read; those of type the lines whose
    lists are decoded. They are applied exactly, so Spark doesn't repeat them."""

    def pushFilters(self, filters):
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f) -> bool:
        name, kind, v = ".".join(f.attribute) if hasattr(f, "attribute") else "", type(f).__name__, getattr(f, "value", None)
        if name in ("object_ord", "type") and kind == "IsNotNull":
            return True
        if name == "type" and kind in ("EqualTo", "In"):
            letters = set(v) if kind == "In" else {v}
            self.wanted = letters if self.wanted is None else self.wanted & letters
            return True
        if name != "object_ord" or kind not in ("EqualTo", "In", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"):
            return False
        if kind in ("EqualTo", "In"):
            some = set(v) if kind == "In" else {v}
            self.only = some if self.only is None else self.only & some
        elif kind.startswith("Greater"):
            self.first = max(self.first, v + (kind == "GreaterThan"))
        else:
            end = v + (kind == "LessThanOrEqual")
            self.stop = end if self.stop is None else min(self.stop, end)
        return True


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]], nested: Nested | None = None):
        self.files, self.nested = files, nested


def _header(schema: Schema, options) -> Header:
    """The header that a writer's options describe. template: a file whose texts, subtype, provenance, references and
    deferred files are taken over; then what the other options give is added."""
    h = Header(schema)
    if options.get("template"):
        old = read_header(options["template"])
        h.subtype, h.text, h.provenance, h.references, h.deferred = old.subtype, list(old.text), list(old.provenance), list(old.references), list(old.deferred)
        if not schema.lines:
            h.schema = old.schema
    h.subtype = options.get("subtype") or h.subtype
    if options.get("provenance"):  # [[program, version, command, date], ...]
        h.provenance += [tuple(map(str, p)) for p in json.loads(options["provenance"])]
        if any(len(p) != 4 for p in h.provenance):
            raise ValueError("provenance is program, version, command and date")
    for name in filter(None, options.get("references", "").split(",")):
        h.references.append((name, len(h.references) + 1))
    h.deferred += list(filter(None, options.get("deferred", "").split(",")))
    h.codecs = {k: Codec.load(bytes.fromhex(c)) for k, c in json.loads(options.get("codecs") or "{}").items()}
    return h


class OneWriter(DataSourceWriter):
    """Each task writes one whole file into a staging folder beside the results, line after line; rows have to come in
    the order of line_no (sortWithinPartitions). Files appear when the job commits; a failed job leaves none. With
    single, the parts are joined to one file in their order."""

    def __init__(self, options):
        self.path, self.binary, self.single = options["path"], options.get("binary", "false") == "true", options.get("single", "false") == "true"
        if options.get("schema_text"):
            schemas = parse_schemas(options["schema_text"])
            self.schema = schemas[options["type"]] if options.get("type") else next(iter(schemas.values()))
        elif options.get("template"):
            self.schema = read_header(options["template"]).schema
        else:
            raise ValueError("schema_text or template has to give the schema")
        self.header = _header(self.schema, options)
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        if self.single and not self.binary:
            raise ValueError("only binary parts are joined")

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, encoder, before = TaskContext.get(), None, None
        name = f"part-{context.partitionId():05d}.1{self.schema.primary}"
        place = f"{self.staging}/{name}-{context.taskAttemptId()}"
        for r in rows:
            if encoder is None:
                os.makedirs(self.staging, exist_ok=True)
                encoder = Encoder(place, self.schema, self.binary, self.header)
            if before is not None and r.line_no is not None and r.line_no < before:
                raise ValueError("rows are not in the order of line_no: sortWithinPartitions('line_no')")
            before, values, kinds = r.line_no, [], self.schema.lines[r.type].fields
            for k, f in zip(kinds, r.fields):
                values.append({"INT": f.i, "REAL": f.r, "CHAR": f.c, "STRING": r.list_str, "DNA": r.list_str, "INT_LIST": r.list_int, "REAL_LIST": r.list_real, "STRING_LIST": r.list_strs}[k])
            encoder.add(Line(r.type, values, r.comment))
        if encoder is None:
            return _Written([])
        encoder.close()
        return _Written([(place, name)], encoder.nested)

    def commit(self, messages) -> None:
        done = sorted(((*f, m.nested) for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        if self.single and done:
            merge_files([place for place, _, _ in done], f"{self.path}/all.1{self.schema.primary}", [n for _, _, n in done])
        else:
            for place, name, _ in done:
                os.replace(place, f"{self.path}/{name}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class OneSource(DataSource):
    """spark.dataSource.register(OneSource); spark.read.format("one").load(path).

    Options: type and schema_text (needed for headerless files), lines (letters to keep; lists of others are never
    decoded), object (type to number and split by), from and to (its ordinals to read, half-open), splits and split_bytes,
    pushdown (true: filters on object_ord and type reach the reader; spark.sql.python.filterPushdown.enabled has to be on,
    and each query has to load() anew, because Spark 4.1 keeps what the last one pushed for a query without filters);
    for writing: schema_text, type, binary, single, template, subtype, references, deferred, provenance, codecs
    (write_compressed). The path has to be mounted on the executors.
    """

    @classmethod
    def name(cls):
        return "one"

    def schema(self):
        return LINES

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown") == "true" else OneReader)(self.options)

    def writer(self, schema, overwrite):
        return OneWriter(self.options)


__all__ = ["Codec", "Header", "Line", "LineType", "OneSource", "Parser", "add_definition", "encode_file", "statistics"]

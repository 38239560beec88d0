"""Length-limited prefix codes of bytes, as typed line files use them for lists: built from a byte histogram, serialised
into the footer, read back from it.

A code has at most MOST_BITS bits. Bytes that the histogram lacks are written behind an escape. The first two bits of a
compressed list are spare; its bits lie in 64-bit words in little-endian order, the first and last byte of the first word
exchanged; what is left behind the last whole word comes highest byte first. A list that doesn't shrink is a byte 255 and the list.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence

MOST_BITS = 12
RAW = 255


def code_lengths(weights: Sequence[int], most: int = MOST_BITS) -> list[int]:
    """Lengths of the shortest prefix code of symbols with these weights and at most so many bits a symbol: the symbols'
    coins of each bit are packed in pairs into those of the bit above, and the cheapest 2n - 2 of the top are taken."""
    n = len(weights)
    if n > 1 << most:
        raise ValueError("too many symbols for so few bits")
    if n == 1:
        return [1]
    coins = sorted((w, (k,)) for k, w in enumerate(weights))
    row = coins
    for _ in range(most - 1):
        packed = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = list(heapq.merge(coins, packed, key=lambda c: c[0]))
    out = [0] * n
    for _, symbols in row[: 2 * n - 2]:
        for k in symbols:
            out[k] += 1
    return out


class Codec:
    """codes: {byte: (bits, code)}; escape: (byte that stands for it in the serialised form, bits, code) or None."""

    def __init__(self, codes: dict[int, tuple[int, int]], escape: tuple[int, int, int] | None = None):
        self.codes, self.escape = codes, escape
        self.text = {s: format(c, f"0{n}b") for s, (n, c) in codes.items()}
        self.text_escape = format(escape[2], f"0{escape[1]}b") if escape else None
        known = [(n, c, s) for s, (n, c) in codes.items()] + ([(escape[1], escape[2], 256)] if escape else [])
        self.widest = max((n for n, _, _ in known), default=1)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.widest)  # by the next bits: (bits of the code, symbol)
        for n, c, s in known:
            first = c << self.widest - n
            self.table[first : first + (1 << self.widest - n)] = [(n, s)] * (1 << self.widest - n)

    @classmethod
    def of_histogram(cls, histogram: Sequence[int]) -> Codec:
        """The code of 256 counts; an escape stands for the bytes without one."""
        symbols = [s for s in range(256) if histogram[s]]
        if not symbols:
            raise ValueError("the histogram is empty")
        spare = next((s for s in range(256) if not histogram[s]), None)
        every = symbols if spare is None else [*symbols, spare]
        lengths = code_lengths([histogram[s] for s in every])
        codes, code, before = {}, 0, 0
        for n, s in sorted(zip(lengths, every)):
            code <<= n - before
            codes[s], before = (n, code), n
            code += 1
        escape = (spare, *codes.pop(spare)) if spare is not None else None
        return cls(codes, escape)

    @classmethod
    def load(cls, serial: bytes) -> Codec:
        order = ">" if serial[0] else "<"
        spare, bits = struct.unpack(order + "ii", serial[1:9])
        codes, escape, at = {}, None, 9
        for s in range(256):
            n = serial[at]
            at += 1
            if n > 0 or s == spare:
                code = struct.unpack(order + "H", serial[at : at + 2])[0]
                at += 2
                if s == spare:
                    escape = (s, bits, code)
                else:
                    codes[s] = (n, code)
        return cls(codes, escape)

    def dump(self) -> bytes:
        """Byte order, byte and bits of the escape, then the bits of each byte, with its code where it has one."""
        spare, bits, code = self.escape or (-1, 0, 0)
        out = [b"\0", struct.pack("<ii", spare, bits)]
        for s in range(256):
            n, c = self.codes.get(s, (0, code))
            out.append(bytes([n]) + (struct.pack("<H", c) if n or s == spare else b""))
        return b"".join(out)

    def encode(self, data: bytes) -> tuple[bytes, int]:
        """(compressed list, its bits)."""
        try:
            bits = "00" + "".join(map(self.text.__getitem__, data))
        except KeyError:
            if self.escape is None:
                raise ValueError("a byte has no code and there is no escape") from None
            bits = "00" + "".join([self.text.get(x) or self.text_escape + format(x, "08b") for x in data])
        n = len(bits)
        if n > 8 * len(data):
            return bytes([RAW]) + data, 8 * len(data) + 8
        size = (n + 7) // 8
        return _turned(int(bits.ljust(8 * size, "0"), 2).to_bytes(size, "big"), n // 64), n

    def decode(self, data: bytes, bits: int, size: int) -> bytes:
        """The list of size bytes."""
        if data[:1] == b"\xff":
            return data[1 : 1 + size]
        if bits >= 64 and not data[0] & 0x40:  # the mark of a big-endian writer
            data = _turned(data, bits // 64)
        stream = bin(int.from_bytes(data, "big") | 1 << 8 * len(data))[3 : 3 + bits] + "0" * self.widest
        out, at, table, wide = bytearray(), 2, self.table, self.widest
        while len(out) < size:
            found = table[int(stream[at : at + wide], 2)] if at < bits else None
            if found is None or at + found[0] > bits:
                raise ValueError("broken code")
            at += found[0]
            s = found[1]
            if s == 256:
                s = int(stream[at : at + 8], 2)
                at += 8
            out.append(s)
        return bytes(out)


def _turned(data: bytes, words: int) -> bytes:
    """Whole words with their bytes in reverse order, but the first and last byte of the first one; its own inverse."""
    b = bytearray(data)
    for k in range(words):
        b[8 * k : 8 * k + 8] = b[8 * k : 8 * k + 8][::-1]
    if words:
        b[0], b[7] = b[7], b[0]
    return bytes(b)

"""Words of any script: scripts that put no spaces between words give a word for each letter, marks stay with theirs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Blocks of scripts written without spaces (fixed values): Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo, Han.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
#: A letter of such a script, as a character class.
UNSPACED_LETTER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]"
HAS_UNSPACED = re.compile(UNSPACED_LETTER)
#: What counts as one in the length of a text: such a letter, or anything else up to white space.
UNIT = re.compile(rf"{UNSPACED_LETTER}|[^\s{UNSPACED_LETTER[1:-1]}]+")

OTHER, WORD, ALONE, MARK = range(4)


def _class(c: int) -> int:
    if 0xD800 <= c < 0xE000:
        return OTHER
    x = chr(c)
    if unicodedata.category(x)[0] == "M":
        return MARK
    if not (x.isalnum() or x == "_"):
        return OTHER
    return ALONE if any(a <= c <= b for a, b in UNSPACED) else WORD


@lru_cache(2)
def _classes(wide: bool) -> np.ndarray:
    return np.fromiter(map(_class, range(0x110000 if wide else 0x10000)), np.uint8, 0x110000 if wide else 0x10000)


_BYTES = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Words of the lower-case text: runs of letters, digits and underscores, with the marks on them; every letter of an
    unspaced script is a word of its own. Whole arrays at a time."""
    low = (text or "").lower()
    if low.isascii():
        return low.encode().translate(_BYTES).decode().split()
    code = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")
    kind = _classes(bool(code.max() > 0xFFFF))[code]
    if kind.max() <= WORD:
        return np.where(kind, code, 32).astype("<u4").tobytes().decode("utf-32-le").split()
    own = np.maximum.accumulate(np.where(kind != MARK, np.arange(len(code)), -1))  # the character that a mark stands on
    base = np.where(own >= 0, kind[np.maximum(own, 0)], OTHER)
    before = np.concatenate([[OTHER], base[:-1]])
    cuts = np.flatnonzero((kind == ALONE) | (kind == WORD) & (before == ALONE))
    out = np.insert(np.where(base != OTHER, code, 32), cuts, 32)
    return out.astype("<u4").tobytes().decode("utf-32-le").split()

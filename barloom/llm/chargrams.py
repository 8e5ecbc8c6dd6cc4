"""Byte and character n-grams of many texts at once, as integer codes over one array.

Texts are lower-cased, ASCII characters other than letters become spaces, and the texts are laid end to
end, as UTF-8 bytes or as code points, with ``GAP`` spaces around each, so that no n-gram of up to GAP + 1
spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GAP = 8
BLOCK_BYTES = 1 << 20
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def layout(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first text, end, bytes, starts): text i owns bytes from starts[i - first] to the next start.

    A block has about BLOCK_BYTES bytes, or one longer text.
    """
    pad, parts, starts, at, first = b" " * GAP, [], [], 0, 0
    for i, t in enumerate(texts):
        part = pad + (t or "").lower().encode("utf-8", "replace").translate(_LETTERS)
        if parts and at + len(part) > BLOCK_BYTES:
            yield first, i, np.frombuffer(b"".join([*parts, pad]), dtype=np.uint8), np.array(starts)
            parts, starts, at, first = [], [], 0, i
        parts.append(part), starts.append(at)
        at += len(part)
    if parts:
        yield first, len(texts), np.frombuffer(b"".join([*parts, pad]), dtype=np.uint8), np.array(starts)


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (n <= 8) from each position, packed exactly; n - 1 shorter than data."""
    out = data[: len(data) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out <<= np.uint64(8)
        out |= data[k : len(data) - n + 1 + k]
    return out


def hashed(code: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Multiplicative hash of codes to 0 .. 2**bits - 1; each n has its own spread."""
    return ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def layout_characters(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As layout, with one code point for each character."""
    for first, end, data, starts in layout(texts):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        # a text starts at as many code points as there are bytes before it that begin a character
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        yield first, end, points, begins[starts]


def character_codes(points: np.ndarray, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """64-bit codes of the n-grams from each position, for each n of orders, ascending."""
    code = points.astype(np.uint64)
    for n in range(2, max(orders) + 1):
        if len(points) < n:
            return
        code = code[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[n - 1 :]
        if n in orders:
            yield code + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

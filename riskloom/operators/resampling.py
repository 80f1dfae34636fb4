"""How often resamples take rows, by inversion of MD5 digests that are made for many rows and samples at once."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests that are made at once, about.
CELLS = 1 << 15


def _rounds(state: list[np.ndarray], words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The state after one block of 16 words; words and state may be rows or columns of the shape."""
    a, b, c, d = (np.array(np.broadcast_to(x, shape)) for x in state)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += words[_PLACES[i]] + np.uint32(_SINES[i])
        left = int(_SHIFTS[i])
        np.left_shift(a, np.uint32(left), out=g), np.right_shift(a, np.uint32(32 - left), out=a)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _words(texts: list[bytes], before: int, total: int, blocks: int) -> np.ndarray:
    """Texts of one length as little-endian words, a row a word, behind so many zero bytes; the end of a message of `total` bytes
    follows if they are its last part."""
    out = np.zeros((len(texts), 64 * blocks), np.uint8)
    length = len(texts[0])
    if length:
        out[:, before : before + length] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), length)
    if before + length == total:
        out[:, total] = 0x80
        out[:, -8:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
    return np.ascontiguousarray(out.view("<u4").T.astype(np.uint32))


def first_words(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The first four bytes of the MD5 digest of each head followed by each tail, as numbers; a row a head. The heads are of one
    length, and so are the tails."""
    total = len(heads[0]) + len(tails[0])
    blocks = (total + 8) // 64 + 1
    front, back = _words(heads, 0, -1, blocks), _words(tails, len(heads[0]), total, blocks)
    shape = (len(heads), len(tails))
    state = [np.full((1, 1), x, np.uint32) for x in _START]
    for k in range(blocks):
        words = [front[j][:, None] | back[j][None, :] if front[j].any() else back[j][None, :] for j in range(16 * k, 16 * k + 16)]
        state = _rounds(state, words, shape)
    return state[0].byteswap()


def weights(heads: list[bytes], tails: list[bytes], steps: list[float]) -> np.ndarray:
    """How many of the steps each digest reaches, as a share of 2 to the 32nd: a row a head, a column a tail, of any lengths."""
    out = np.zeros((len(heads), len(tails)), np.uint8)
    least = [x for x in (math.ceil(s * 2.0**32) for s in steps) if x < 2**32]
    lengths = [np.array([len(x) for x in some]) for some in (heads, tails)]
    for n in np.unique(lengths[0]):
        rows = np.flatnonzero(lengths[0] == n)
        for m in np.unique(lengths[1]):
            columns = np.flatnonzero(lengths[1] == m)
            for at in range(0, len(columns), 1024):
                some = columns[at : at + 1024]
                step = max(1, CELLS // len(some))
                for r in range(0, len(rows), step):
                    word = first_words([heads[i] for i in rows[r : r + step]], [tails[i] for i in some])
                    out[np.ix_(rows[r : r + step], some)] = sum((word >= np.uint32(x)).view(np.uint8) for x in least)
    return out

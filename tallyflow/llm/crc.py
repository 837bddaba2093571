"""CRC-32 of very many short strings at once.

The checksum is linear: that of ``a + b`` is the checksum of ``a`` moved over the length of ``b``, xor that of ``b``. Moves over fewer than 64
bytes are four table look-ups each; longer ones go by powers of two.
"""

from __future__ import annotations

import numpy as np

SHORT = 64
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Tables [length, byte of the state, its value] of the moves over 0 to 63 bytes, and over 1, 2, 4, ... 2**31 bytes."""
    one = _byte_table()
    state = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    short = [state]
    for _ in range(SHORT - 1):
        state = (state >> 8) ^ one[state & 255]
        short.append(state)
    powers = [short[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1].ravel(), np.int64(0), powers[-1]))
    return np.array(short), np.array(powers)


def _apply(tables: np.ndarray, base: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = tables[base + (state & 255)]
    out ^= tables[base + 256 + (state >> 8 & 255)]
    out ^= tables[base + 512 + (state >> 16 & 255)]
    out ^= tables[base + 768 + (state >> 24)]
    return out


_SHORT, _POWERS = (t.reshape(-1) for t in _moves())


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved over ``length`` bytes each."""
    out = _apply(_SHORT, np.minimum(length, SHORT - 1).astype(np.int64) << 10, crc)
    long = np.flatnonzero(length >= SHORT)
    if len(long):
        state, rest = crc[long], length[long].astype(np.int64)
        for k in range(int(rest.max()).bit_length()):
            on = np.flatnonzero(rest >> k & 1)
            state[on] = _apply(_POWERS, np.int64(k << 10), state[on])
        out[long] = state
    return out


def joined(crc: np.ndarray, crc_next: np.ndarray, length_next: np.ndarray) -> np.ndarray:
    """Checksums of pairs of strings put together."""
    return moved(crc, length_next) ^ crc_next

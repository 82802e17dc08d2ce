"""Ids of headwords: SipHash-1-3 with zero keys, over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SipHash's initial state for zero keys.
_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(v: list[np.ndarray]) -> None:
    v[0] += v[1]
    v[2] += v[3]
    v[1] = _rotl(v[1], 13) ^ v[0]
    v[3] = _rotl(v[3], 16) ^ v[2]
    v[0] = _rotl(v[0], 32)
    v[2] += v[1]
    v[0] += v[3]
    v[1] = _rotl(v[1], 17) ^ v[2]
    v[3] = _rotl(v[3], 21) ^ v[0]
    v[2] = _rotl(v[2], 32)


def siphash13(messages: list[bytes]) -> np.ndarray:
    """64-bit hashes of many messages at once, grouped by their number of words."""
    out = np.zeros(len(messages), np.uint64)
    sizes = np.array([len(m) for m in messages], np.int64)
    for words in np.unique(sizes // 8):
        at = np.flatnonzero(sizes // 8 == words)
        block = bytearray()
        for i in at:
            tail = messages[i].ljust(8 * (int(words) + 1), b"\0")
            block += tail[:-1] + bytes([len(messages[i]) & 0xFF])
        rows = np.frombuffer(bytes(block), "<u8").reshape(len(at), -1)
        v = [np.full(len(at), s, np.uint64) for s in _START]
        for k in range(rows.shape[1]):
            v[3] ^= rows[:, k]
            _round(v)
            v[0] ^= rows[:, k]
        v[2] ^= np.uint64(0xFF)
        for _ in range(3):
            _round(v)
        out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


@F.pandas_udf(T.LongType())
def phrase_id(words: pd.Series) -> pd.Series:
    """Unsigned 32-bit id of a headword, as a bigint; null for null.  A string is hashed with a closing 0xFF byte."""
    known = words.notna().to_numpy()
    ids = siphash13([w.encode() + b"\xff" for w in words[known]]) & np.uint64(0xFFFFFFFF)
    found = pd.Series(pd.NA, index=words.index, dtype="Int64")
    found[known] = ids.astype(np.int64)
    return found

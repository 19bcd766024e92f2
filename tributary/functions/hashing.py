"""Stable hashes, canonical JSON and binding fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of 64-bit FNV-1a and of the 64-bit finaliser that follows it.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_MASK = (1 << 64) - 1


def stable_hash64(seed: int, data: bytes) -> int:
    """FNV-1a from offset xor seed, then the finaliser."""
    h = (FNV_OFFSET ^ seed) & _MASK
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    h = ((h ^ (h >> 33)) * MIX_1) & _MASK
    h = ((h ^ (h >> 33)) * MIX_2) & _MASK
    return h ^ (h >> 33)


def _many(seed: int, items: list[bytes]) -> np.ndarray:
    """stable_hash64 of each item: one numpy step per byte position, items sorted by length."""
    length = np.array([len(x) for x in items], np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.frombuffer(b"".join(items[i] for i in order), np.uint8)
    begin = np.concatenate(([0], np.cumsum(length[order])[:-1])) if len(items) else np.zeros(0, np.int64)
    h = np.full(len(items), (FNV_OFFSET ^ seed) & _MASK, np.uint64)
    live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    with np.errstate(over="ignore"):
        for at, n in enumerate(live.tolist()):
            h[:n] = (h[:n] ^ flat[begin[:n] + at]) * np.uint64(FNV_PRIME)
        for mix in (MIX_1, MIX_2):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(mix)
        h ^= h >> np.uint64(33)
    out = np.empty_like(h)
    out[order] = h
    return out


def stable_hash64_column(column: Column | str, seed: int = 0) -> Column:
    """stable_hash64 of a string's UTF-8 bytes as 16 hex digits (Spark has no unsigned 64-bit type)."""

    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna()
            hashes = _many(seed, [x.encode() for x in s[known]])
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known] = [f"{h:016x}" for h in hashes.tolist()]
            yield out

    return hashed(column)


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json_column(column: Column | str) -> Column:
    """Canonical form of a column of JSON text; null where it is not JSON."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else canonical_json(json.loads(x))
            except ValueError:
                return None

        return s.map(one)

    return canonical(column)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sha256_text(column: Column | str) -> Column:
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names: a binding fingerprint."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def prompt_hash(system: str, user: str) -> str:
    return sha256_json({"system": system, "user": user})

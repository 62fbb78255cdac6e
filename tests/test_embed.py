"""V3: the default embedding against a plain version of its hash."""

import math
import re

import pytest

from bastion.operators.vectors import hashing_embedder


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 x86 32-bit, signed."""
    h, mask = seed, 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mix = lambda k: rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for i in range(0, len(data) // 4 * 4, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if tail := data[len(data) // 4 * 4:]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * times & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plain(text, dim):
    out = [0.0] * dim
    for w in re.split(r"\W+", (text or "").lower()):
        if w:
            out[murmur3(w.encode()) % dim] += 1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_values_against_plain_hashing(spark):
    texts = ["One two  two, THREE", "é façade naïve", "", "?!", "a" * 50_000, " ".join(f"w{i % 997}" for i in range(40_000)), "x_1 x-1"]
    got = hashing_embedder(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", dim=64).collect()
    for r in got:
        assert r.vec == pytest.approx(plain(texts[r.id], 64), abs=1e-12)


def test_registered_query_covers_every_document(spark):
    from bastion.registry.vectors import v3_embed
    sf = "/root/testdata/sf0.001"
    got = v3_embed(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and {r.dim for r in got} == {256}

"""SipHash against a plain implementation and a published vector, the multi-index join and the ordered folds against brute force."""

import random

import numpy as np

from pyspark.sql import functions as F

from textloom.operators import neardup

ONES = (1 << 64) - 1


def siphash(data, k0=0, k1=0, compress=1, finish=3):
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    rot = lambda x, n: (x << n | x >> 64 - n) & ONES

    def turn():
        v[0] = v[0] + v[1] & ONES
        v[1] = rot(v[1], 13) ^ v[0]
        v[0] = rot(v[0], 32)
        v[2] = v[2] + v[3] & ONES
        v[3] = rot(v[3], 16) ^ v[2]
        v[0] = v[0] + v[3] & ONES
        v[3] = rot(v[3], 21) ^ v[0]
        v[2] = v[2] + v[1] & ONES
        v[1] = rot(v[1], 17) ^ v[2]
        v[2] = rot(v[2], 32)

    whole = len(data) // 8 * 8
    for m in [*(int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)), int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]:
        v[3] ^= m
        for _ in range(compress):
            turn()
        v[0] ^= m
    v[2] ^= 0xFF
    for _ in range(finish):
        turn()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_siphash():
    key = bytes(range(16))
    # the vector of the SipHash paper (2 and 4 rounds) checks the plain version, which checks the vectorised one
    assert siphash(bytes(range(15)), int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little"), 2, 4) == 0xA129CA6149BE45E5
    for n in (1, 2, 3, 4, 7, 8, 9):
        grams = np.random.default_rng(n).integers(0, 256, (6, n), dtype=np.uint8)
        assert neardup.sip_bytes(grams).tolist() == [siphash(n.to_bytes(8, "little") + bytes(g)) for g in grams]


def sip_simhash(text):
    data = text.encode()
    if len(data) < 4:
        return siphash(len(data).to_bytes(8, "little") + data) if data else 0
    hashes = [siphash((4).to_bytes(8, "little") + data[i : i + 4]) for i in range(len(data) - 3)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_sip_simhash(spark):
    texts = ["", "a", "abc", "abcd", "ERROR: timeout at 192.168.1.1", "ERROR: timeout at 192.168.1.2", "é中" * 20, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", neardup.sip_simhash_udf("text").alias("h")).collect()
    assert [r.h & ONES for r in sorted(rows)] == [sip_simhash(t or "") for t in texts]


def test_pairs_by_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, ONES]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for h in base for _ in range(12)] + base
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, hash long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    ids = sorted(first.values())
    for most in (0, 1, 3, 5):
        got = [(r.a, r.b, r.bits) for r in neardup.similar_pairs(df, most).collect()]
        want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in ids for b in ids if a < b and (hashes[a] ^ hashes[b]).bit_count() <= most}
        assert len(got) == len(set(got)) and set(got) == want


def test_folds_by_brute_force(spark):
    rng = random.Random(9)
    words = ["error", "timeout at", "10.0.0.1", "10.0.0.2", "job 17 done", "job 18 done", "", "  "]
    rows = [(d, i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for d in (1, 2, None) for i in range(150)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(3)
    kept, unique = set(), {}
    for doc in (1, 2, None):
        held, every = [], []
        for d, i, line in rows:
            if d != doc:
                continue
            h = neardup.simhash(line) & ONES
            if not line.strip():
                kept.add((d, i))
                continue
            if all((h ^ x).bit_count() > 3 for x in held[-20:]):
                kept.add((d, i))
                held.append(h)
            if all((h ^ x).bit_count() > 3 for x in every):
                every.append(h)
        unique[doc] = len(every)
    assert {(r.doc_id, r.line_no) for r in neardup.window_dedup(lines, 3, 20).collect()} == kept
    assert {r.doc_id: r.n_unique for r in neardup.count_unique(lines).collect()} == unique
    assert neardup.count_unique(lines.filter(F.lit(False))).count() == 0

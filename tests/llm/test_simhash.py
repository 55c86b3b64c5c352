import random

import numpy as np
import pytest
import xxhash
from nichewright.llm.simhash import anchors, block_links, fingerprint, links, simhash_components
from nichewright.operators.components import connected_components


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, t=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= t:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "one", "A b\tC\nd e", "é É ß 漢 " * 5, "w " * 300000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) % 2**64 == brute_print(text)


@pytest.mark.parametrize(("threshold", "g"), [(4, 1), (4, 2), (3, 1), (0, 1)])
def test_every_close_pair_meets_at_the_nearest_anchor(threshold, g):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 300, np.uint64, endpoint=False)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    rx, kx, nx = anchors(x, threshold, g)
    ry, ky, _ = anchors(y, threshold, g)
    home = {(r, k) for r, k, n in zip(rx, kx, nx) if n}
    assert len(home) == 300 * 3
    there = set(zip(ry, ky))
    assert {r for r, k in home if (r, k) in there} == set(range(300))


def near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize(("block", "g"), [(8192, 1), (16, 1), (64, 2)])
def test_links_connect_what_brute_force_connects(spark, block, g):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(60)} | {near(rng, centre, 2) for _ in range(80)} | {0, 1, 2**64 - 1}
    for p in list(prints)[:30]:
        prints.add(near(rng, near(rng, p, 4), 3))
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    got = {r.node % 2**64: r.component % 2**64 for r in connected_components(links(rows, 4, block, g)).collect()}
    want = brute_components(prints)
    of = [got.get(p, p) for p in prints]
    assert len(set(zip(of, want))) == len(set(of)) == len(set(want))


def test_block_links_are_a_forest():
    x = np.arange(64, dtype=np.uint64)
    a, b = block_links(x, x, 6)
    assert len(b) == 63 and set(a) == {0}


def rows_of(rng):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    texts += [t + " tail" for t in texts[:15]] + [t.replace("w1 ", "w2 ", 1) for t in texts[:10]] + texts[:5]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    return rows + [(500, None), (501, ""), (502, " \t"), (None, texts[0]), (None, "only null"), (None, "only null"), (3, "tie"), (3, "tie"), (600, "word " * 50000)]


def test_components_of_documents(spark):
    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fingerprint string, fp int")
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components(prints)
    least = {g: min((d for (d, _), h in zip(rows, groups) if h == g and d is not None), default=None) for g in groups}
    want = sorted((str(d), f"{p:016x}", str(least[g])) for (d, _), p, g in zip(rows, prints, groups))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(docs).collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).count() == 0

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from nichewright.llm.minhash import MinHasher, fingerprinted


MASK = 2**64 - 1


def spread(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & MASK
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


class Plain:
    """Signatures by the definition, with Python integers."""

    def __init__(self, slots=64, width=5, seed=11):
        rng = np.random.default_rng(seed)
        draw = lambda n: [int(v) | 1 for v in rng.integers(0, 2**64, n, np.uint64, endpoint=False)]
        self.place, self.a, self.b, self.width, self.seed, self.known = draw(width), draw(slots), draw(slots), width, seed, {}

    def shingles(self, text):
        words = [xxhash.xxh64_intdigest(w.encode(), self.seed) for w in re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text))]
        runs = [words[i : i + self.width] for i in range(len(words) - self.width + 1)] or [words]
        return {spread((sum(h * p for h, p in zip(run, self.place)) + len(run)) & MASK) for run in runs}

    def signature(self, text):
        if text not in self.known:
            found = self.shingles(text)
            self.known[text] = [min((a * x + b & MASK) for x in found) >> 32 & 0xFFFF for a, b in zip(self.a, self.b)]
        return self.known[text]


def digits(signature):
    return "".join(f"{v & 255:02x}{v >> 8:02x}" for v in signature)


def components(rows, threshold=0.8):
    """(component_id, copies) of every row, by all pairs."""
    sets = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in {t or "" for _, t in rows} for w in ["".join(c.lower() if c.isascii() else c for c in t).split()]}
    texts, root = sorted(sets), {t: t for t in sets}
    for x in texts:
        for y in texts:
            if x < y and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                old, new = root[x], root[y]
                root = {t: new if r == old else r for t, r in root.items()}
    least = {r: min((d for d, t in rows if d is not None and root[t or ""] == r), default=None) for r in set(root.values())}
    copies = Counter(t or "" for _, t in rows)
    return [(least[root[t or ""]], copies[t or ""]) for _, t in rows]


def brute(rows):
    plain = Plain()
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in rows]
    out = []
    for i, ((doc_id, _), text, (component, copies)) in enumerate(zip(rows, texts, components(rows))):
        following, n = texts[(i + 1) % len(rows)], len(text) // 3
        edited = (text[:-n] if n else text) + following[:n]
        own, new, other = map(plain.signature, (text, edited, following))
        like = lambda x, y: sum(a == b for a, b in zip(x, y)) / len(x)
        out.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(new), like(own, new), like(own, other), str(component), copies))
    return sorted(out)


def rows_of(n):
    rng = random.Random(n)
    words = ["alpha", "Beta", "gamma\n", "é漢", "🙂", "delta", "\tx"]
    return [(i * 3 - 20, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 40, 300])))) for i in range(n)] + [(1000, None), (1001, ""), (None, "the null id"), (2000, "long one " * 40000)]


@pytest.mark.parametrize("n", [0, 1, 60])
def test_equals_brute_force(spark, n):
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows_of(n)], "doc_id long, text string, fingerprint string, part int").repartition(7)
    got = sorted((str(r.doc_id), *r[1:7], str(r.component_id), r.copies) for r in fingerprinted(docs).collect())
    assert got == brute(rows_of(n))


def test_repeated_rows_and_one_document(spark):
    same = spark.createDataFrame([(4, "a b c d e f g h i")] * 5, "doc_id long, text string")
    rows = fingerprinted(same).collect()
    assert len(rows) == 5 and {r.near_next for r in rows} == {1.0} and len({r.fingerprint for r in rows}) == 1
    assert {(r.component_id, r.copies) for r in rows} == {(4, 5)}
    one = fingerprinted(same.limit(1)).collect()
    assert [(r.edited_sha256, r.near_next, r.component_id, r.copies) for r in one] == [(hashlib.sha256(b"a b c d e f a b c").hexdigest(), 1.0, 4, 1)]
    assert fingerprinted(same.where("false")).count() == 0


def test_likeness_estimates_jaccard():
    rng, hasher = random.Random(1), MinHasher(slots=512)
    words = [f"w{i}" for i in range(2000)]
    for share in (0.3, 0.8):
        cut = int(1000 * share)
        a = [rng.choice(words) for _ in range(1000)]
        b = a[:cut] + [rng.choice(words) for _ in range(1000 - cut)]
        x, y = (" ".join(t).encode() for t in (a, b))
        truth = len(set(hasher.shingles(x)) & set(hasher.shingles(y))) / len(set(hasher.shingles(x)) | set(hasher.shingles(y)))
        assert abs((hasher.signature(x) == hasher.signature(y)).mean() - truth) < 0.07


@pytest.mark.parametrize("block", [512, 9])
def test_groups_equal_brute_force(spark, block):
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=120)) for _ in range(30)]
    chain = [" ".join(base[0].split()[i * 8 :] + [f"c{j}" for j in range(i * 8)]) for i in range(1, 6)]
    texts = base + [t + " end" for t in base[:20]] + [" ".join(t.split()[:60]) for t in base[20:]] + base[:4] + chain + [base[7] + f" tail{i}" for i in range(40)]
    rows = [(i * 13 % 997, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, root int, copies int").repartition(4)
    got = {r.doc_id: (r.component_id, r.copies) for r in fingerprinted(docs, block=block).collect()}
    assert got == {d: c for (d, _), c in zip(rows, components(rows))} and len({c for c, _ in got.values()}) < 45

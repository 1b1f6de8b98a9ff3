"""Subvector codes next to plain integers, and filter interactions next to a walk through every order."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import removal_ranks, subvector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [
        (key, [math.floor(scale * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**27 / scale for x in v)
    ]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[0]].append(v)
        centroids = [[sum(x) // len(of[c]) for x in zip(*of[c])] if of[c] else old for c, old in enumerate(centroids)]
    found = [(key, *near(v)) for key, v in kept]
    per = defaultdict(int)
    for _, c, d in found:
        per[c] += d
    return [(key, c, d, per[c], sum(per.values()), centroids[c]) for key, c, d in found]


@pytest.mark.parametrize("entries,decimals,block", [(1 << 16, 6, 8), (90, 0, 1), (4, 6, 0)])
def test_clusters_equal_plain_integers(spark, entries, decimals, block):
    r = random.Random(3)
    rows = [(i, [round(r.gauss(0, 1), decimals) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 8) for i in range(90)]  # one very common vector
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, [0.25] * 8), (None, [1.0] * 8)]
    rows += [(200, None), (201, []), (202, [1.0] * 7), (203, [1.0] * 7 + [None]), (204, [math.nan] * 8), (205, [math.inf] * 8), (206, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("_k", "_v", "cluster")})
    out = subvector_codes.cluster(df, k=9, rounds=3, dims=8, scale=4, entries=entries)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain_clusters(rows, 9, 3, 8, 4), key=repr)
    kept = subvector_codes.integers(df, "vec_id", "embedding", 8, 4)
    assert subvector_codes.block_width(kept, 8, entries) == block


def test_fewer_vectors_than_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 6.0])], "vec_id long, embedding array<float>")
    out = subvector_codes.cluster(df, k=5, rounds=2, dims=2)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in out.collect()) == [(1, 0, 0), (2, 0, 0)]
    none = subvector_codes.cluster(df.filter("false"), dims=2)
    assert none.count() == 0 and none.columns == out.columns and none.dtypes == out.dtypes


def test_codes_lose_nothing():
    r = np.random.default_rng(1)
    v = r.integers(-(1 << 27), 1 << 27, (500, 4))
    v[100:200] = v[0]
    parts = [np.unique(v[:, k : k + 2], axis=0) for k in (0, 2)]
    codes = subvector_codes._codes(v, parts)
    assert (np.concatenate([p[codes[:, b]] for b, p in enumerate(parts)], axis=1) == v).all()
    c = r.integers(-(1 << 27), 1 << 27, (3, 4))
    best, far = subvector_codes.nearest(codes, subvector_codes.partial_distances(parts, c))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert far.tolist() == [min(e) for e in exact] and best.tolist() == [e.index(min(e)) for e in exact]


def plain_audit(docs, labels):
    """A walk over the documents of each part, one order at a time."""
    smallest = {}
    for key, text, _ in docs:
        if key is not None:
            smallest[text or ""] = min(key, smallest.get(text or "", key))
    fails = []
    for key, text, part in docs:
        t, w = text or "", WORD.findall(text or "")
        f = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)]
        f += [bool(re.search(r"[#$%&*|]", t)), key is not None and key > smallest[t]]
        own = [x for x in labels if key is not None and x[0] == key]
        fails.append((part or "", {n for n, x in zip("ABCDE", f) if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in fails}:
        rows = [f[1:] for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            here = rows
            for step, name in enumerate(order, 1):
                gone = [x for x in here if name in x[0]]
                late = sum(name in x[0] for x in rows) - len(gone)
                here = [x for x in here if name not in x[0]]
                shapley[part, name] += len(gone)
                only = sum(x[0] == {name} for x in rows)
                out[part, "".join(order), step] = [len(here), len(gone), late, only, sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_interactions_equal_a_walk(spark, odd, empty):
    labels = [(k, k % 2, k % 3 == 0) for k in range(1, 12)] + [(None, 1, 1), (3, 0, 1), (1, None, None), (99, 1, 1), (9, 1, 1), (9, 1, 1)]
    labels = [(k, q, None if x is None else int(x)) for k, q, x in labels]
    more = [(30 + k, "SHOUT " * 60 + "# " * (k % 2), None if k % 3 else "", 0) for k in range(7)] + [(None, "SHOUT " * 60, "a", 0)]
    rows = spark.createDataFrame(more, "doc_id long, text string, source string, n_chars long")
    docs = odd.unionByName(rows, allowMissingColumns=True)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(5) for c in ("_k", "_q", "n", "part")})
    out = removal_ranks.audit(docs.withColumns({c: F.lit(5) for c in ("part", "mask", "_h", "_m", "_t", "quality")}), said)
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted(map(tuple, out.collect())) == plain_audit(plain, labels)
    assert removal_ranks.audit(empty, said).count() == 0
    assert removal_ranks.audit(docs, said.filter("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_removal_steps():
    each, positions = removal_ranks.orders(3)
    steps = removal_ranks.removal_steps(np.arange(8), positions)
    for mask in range(8):
        for order, step in zip(each.tolist(), steps[mask].tolist()):
            assert step == next((s for s, f in enumerate(order) if mask >> f & 1), 3)

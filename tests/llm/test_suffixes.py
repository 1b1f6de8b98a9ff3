"""Suffixes sorted through a threshold, next to a walk over all strings of that length."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import suffix_radix


def plain(rows, width):
    """(key, bytes, removed, spans, kept) of each row; rows that repeat a key and text are one document."""
    order = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)))}
    seen, out = set(), {}
    for r in order:
        x, gone = (r[1] or "").encode(), set()
        for p in range(len(x) - width + 1):
            w = x[p : p + width]
            if w in seen:
                gone.update(range(p, p + width))
            seen.add(w)
        marks = "".join("x" if i in gone else "." for i in range(len(x)))
        out[r] = (r[0], len(x), len(gone), len(re.findall("x+", marks)), bytes(b for i, b in enumerate(x) if i not in gone))
    return sorted((out[r] for r in rows), key=repr)


def loose_copies(seed: int, n: int, of: str, rate: float) -> list[str]:
    r = random.Random(seed)
    return [" ".join(w if r.random() > rate else "w%d" % r.randrange(10**6) for w in of.split()) for _ in range(n)]


def rows_of(seed: int):
    r = random.Random(seed)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    base = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60))
    rows = [(k, t) for k, t in enumerate(loose_copies(seed, 12, base, 0.05))]
    rows += [(20 + k, f"{r.random()} é {passage} {r.random()} 漢字") for k in range(15)]
    rows += [(50, "ab" * 120), (51, "ab" * 70 + "ba" * 60), (52, passage + passage), (53, passage[3:90])]
    rows += [(54, base), (54, base), (None, base), (None, None), (None, passage), (55, ""), (56, "x")]
    return rows


@pytest.mark.parametrize("width,anchor,crowd", [(20, None, 4096), (20, 3, 2), (33, 33, 5), (50, None, 4096)])
def test_removed_bytes_equal_a_walk(spark, width, anchor, crowd):
    rows = rows_of(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("_k", "_t", "_x", "h", "at", "n")})
    out = suffix_radix.dedup(df, width=width, anchor=anchor, crowd=crowd)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr) == plain(rows, width)


def test_odd_texts(spark, odd, empty):
    out = suffix_radix.dedup(odd)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr) == plain(rows, 100)
    assert suffix_radix.dedup(empty).count() == 0
    names = odd.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert suffix_radix.dedup(names, key="name", text="body").agg(F.sum("n_bytes")).first() == out.agg(F.sum("n_bytes")).first()


def test_pieces_of_long_texts_cover_all_suffixes(monkeypatch):
    monkeypatch.setattr(suffix_radix, "SLICE", 64)
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 5, 19, 20, 64, 83, 84, 500)]
    found = {}
    for owner, at, n, lead, h, _ in suffix_radix.text_runs(texts, 20, 6, suffix_radix.Rolling()):
        for o, a, m, x, y in zip(owner.tolist(), at.tolist(), n.tolist(), lead.tolist(), h.tolist()):
            for j in range(m):
                found[o, a + j] = (x - j, y)
    assert sorted(found) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 19)]
    anchors = {}
    for (i, p), (x, y) in found.items():
        assert 0 <= x <= 14 and anchors.setdefault(y, texts[i][p + x : p + x + 6]) == texts[i][p + x : p + x + 6]


def test_equal_suffixes():
    r = np.random.default_rng(4)
    raw = r.integers(0, 2, 4000, dtype=np.uint8)
    starts, group = r.integers(0, 3980, 600), r.integers(0, 5, 600)
    for width in (7, 8, 11, 20):
        seen, later = set(), []
        for i, (g, s) in enumerate(zip(group.tolist(), starts.tolist())):
            w = (g, raw[s : s + width].tobytes())
            later += [i] * (w in seen)
            seen.add(w)
        assert sorted(suffix_radix.equal_suffixes(group, starts, raw, width).tolist()) == later
    assert len(suffix_radix.equal_suffixes(group[:0], starts[:0], raw, 8)) == 0

"""Operators on odd, repeated and empty tables, next to plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.llm import (
    decision_list,
    line_windows,
    piece_viterbi,
    queries,
    signature_join,
    spaced_seeds,
    span_doubling,
    string_kernel,
    tag_paths,
    token_resync,
    url_models,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def texts(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


def labels(spark):
    rows = [(k, k % 2, 0) for k in range(1, 15)] + [(None, 1, 0), (1, None, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def base(text):
    w = WORD.findall(text or "")
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd, empty):
    out = decision_list.judge(odd, labels(spark))
    expected = []
    for k, t in texts(odd):
        b = base(t)
        expected.append((k, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert plain(out, "doc_id", *decision_list.BASE, "base_failed") == sorted(expected, key=repr)
    assert out.filter("base_failed AND kept").count() == 0
    assert decision_list.judge(empty, labels(spark)).count() == 0
    assert decision_list.judge(odd, labels(spark).filter("false")).filter("NOT base_failed AND NOT kept").count() == 0
    kept = decision_list.passed(odd, labels(spark).filter("false"))
    assert kept.columns == odd.columns and kept.count() == out.filter("NOT base_failed").count()


def test_rules_are_learned(spark):
    rows = [(k, f"{'$' * (k % 2)}" + " ".join(f"w{k}{i}" + "$" * (k % 2) for i in range(60))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, quality int")
    out = decision_list.judge(docs, lab)
    assert out.filter("kept").count() == 100 and out.filter("kept AND doc_id % 2 = 1").count() == 0
    rules = decision_list.learn(decision_list.statistics(docs), lab)
    assert rules and all(c.feature.startswith("f_") for rule in rules for c in rule)


def lines_kept(rows):
    """(n_lines, n_removed, text) of each distinct row."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for k, t in rows:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for j in range(len(at) - 2):
            w = tuple(lines[i] for i in at[j : j + 3])
            gone |= set(at[j : j + 3]) if w in seen else set()
            seen.add(w)
        out[k, t] = len(at), len(gone), t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(odd, empty):
    expected = lines_kept(texts(odd))
    got = line_windows.dedup(odd)
    assert [c for c in odd.columns if c not in got.columns] == []
    rows = plain(got, "doc_id", "n_lines", "n_removed", "text")
    assert rows == sorted(((k, *expected[k, t]) for k, t in texts(odd)), key=repr)
    assert sum(r[2] for r in rows) > 0
    assert line_windows.dedup(empty).count() == 0


def test_token_counts(odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = token_resync.tokenizer(path)
    got = token_resync.token_counts(odd, path, chunk=2000, overlap=64)
    expected = [(k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in texts(odd)]
    assert plain(got, "doc_id", "n_bytes", "n_tokens") == sorted(expected, key=repr)
    assert token_resync.token_counts(empty, path).count() == 0


def test_encoding(odd, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, library = piece_viterbi.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_viterbi.decode(piece_viterbi.encode(odd, pieces), pieces).collect()
    assert sorted((repr(r.doc_id), r.text, r.ids) for r in got if r.text) == sorted(
        (repr(k), t, library.encode(t)) for k, t in texts(odd) if t
    )
    assert all(r.decoded == (r.text or "") for r in got) and len(got) == len(texts(odd))
    assert piece_viterbi.encode(empty, pieces).count() == 0
    assert queries.encoded_digest(odd).filter("NOT round_trip").count() == 0


def words_kept(rows, width):
    split = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark, odd, empty):
    rows = texts(odd)
    for width, shortest in ((35, 18), (35, 5), (4, 18)):
        got = span_doubling.dedup(odd, width, shortest=shortest)
        assert plain(got, "doc_id", "n_words", "n_removed", "kept") == words_kept(rows, width)
    assert span_doubling.dedup(empty).count() == 0
    # shared passages at all offsets, so that windows of runs met once and twice mix
    p = " ".join(f"p{i}" for i in range(120))
    made = [(k, " ".join([f"a{k}"] * (k % 7) + p.split()[k * 3 : 120 - k] + [f"b{k}"] * 5)) for k in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert plain(span_doubling.dedup(docs, 35), "doc_id", "n_words", "n_removed", "kept") == words_kept(made, 35)


def test_texts_under_one_id_whose_hashes_agree_in_half(spark):
    many = spark.range(300_000).select(F.concat(F.lit("word "), "id", F.lit(" end")).alias("t")).withColumn("h", F.shiftright(F.xxhash64("t"), 32))
    pair = many.groupBy("h").agg(F.sort_array(F.collect_list("t")).alias("t")).filter(F.size("t") > 1).first()["t"][:2]
    p = " ".join(f"p{i}" for i in range(12))
    rows = [(None, pair[0]), (None, pair[1]), (None, f"{p} {pair[0]} {p}"), (None, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(span_doubling.dedup(docs, 4), "doc_id", "n_words", "n_removed", "kept") == words_kept(rows, 4)
    both = spark.createDataFrame([(None, pair[0] * 9), (None, pair[1])], "doc_id long, text string")
    assert plain(span_doubling.dedup(both, 2), "doc_id", "n_words", "n_removed", "kept") == words_kept([tuple(r) for r in both.collect()], 2)


def components(rows, width, percent):
    sets = [signature_join.word_shingles(t or "", width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else k
        out.append((k, len(sets[i]), least, k is not None and k == least))
    return sorted(out, key=repr)


def test_near_duplicates(spark, odd, empty):
    rows = texts(odd)
    got = signature_join.near_duplicates(odd, width=2)
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == components(rows, 2, 80)
    assert signature_join.near_duplicates(empty).count() == 0
    left = signature_join.representatives(odd)
    assert left.columns == odd.columns and {2, 3} & {r.doc_id for r in left.collect()} == set()


def test_near_duplicate_chains(spark):
    """Copies of copies: only neighbours are similar, and one group is far larger than the rest."""
    import random

    r = random.Random(3)
    w = [f"w{i}" for i in range(100)]
    made = []
    for k in range(60):
        w = list(w)
        for _ in range(3):
            w[r.randrange(100)] = f"v{k}{r.randrange(10_000)}"
        made.append((k, " ".join(w)))
    base_ = [f"u{i}" for i in range(60)]
    for k in range(60, 160):
        c = list(base_)
        c[r.randrange(60)] = f"x{k}"
        c[r.randrange(60)] = f"y{k}"
        made.append((k, " ".join(c)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = signature_join.near_duplicates(docs, width=2, rounds=3)
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == components(made, 2, 80)


@pytest.mark.parametrize("rounds", [0, 2])
def test_loose_copies_of_one_text(spark, rounds):
    """One large group on both sides of the similarity, whose deviations recur; without stars the bitmaps see all pairs."""
    import random

    r = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    made = [(k, " ".join(w if r.random() > 0.07 else f"v{r.randrange(12)}" for w in base)) for k in range(150)]
    made += [(200 + k, made[k][1]) for k in range(5)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = signature_join.near_duplicates(docs, width=2, rounds=rounds)
    want = components(made, 2, 80)
    assert 20 < sum(row[3] for row in want) < 150
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == want


@pytest.mark.parametrize("rounds", [0, 3])
def test_links_of_loose_copies_are_not_all_compared(spark, monkeypatch, rounds):
    """Copies on both sides of the similarity, most of them linked to the least changed ones: pairs grow with the copies."""
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    made = []
    for k in range(400):
        w = list(base)
        for p in r.sample(range(150), r.randrange(1, 10)):
            w[p] = f"v{r.randrange(40)}"
        made.append((k, " ".join(w)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    confirmed, compared = signature_join._confirmed, []

    def counted(pairs, *args):
        compared.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(signature_join, "_confirmed", counted)
    got = signature_join.near_duplicates(docs, width=2, rounds=rounds)
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == components(made, 2, 80)
    assert sum(compared) < 5 * len(made)


def test_leaks(spark, odd, empty):
    item = " ".join(f"Q{i}," for i in range(30))
    changed = item.replace("Q5,", "other").replace("Q17,", "words")
    docs = [
        (1, "before " + item + " after"),
        (2, "start, " * 5 + changed),
        (3, " ".join(item.split()[:10])),
        (4, " ".join(reversed(item.split()))),
        (5, " ".join(item.split()[3:29])),
        (None, item.upper()),
        (6, None),
        (7, ""),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("at", F.lit(2))
    items = spark.createDataFrame([(100, item), (101, None), (102, "too short"), (103, "")], "item_id long, text string")
    got = plain(spaced_seeds.leaks(docs, items), "doc_id", "item_id", "n_matched", "n_compared", "start")
    assert [g[:2] for g in got] == [(1, 100), (2, 100), (5, 100), (None, 100)]
    assert got[0][2:] == (24, 24, 1)
    cleaned = spaced_seeds.clean(docs, items)
    assert cleaned.columns == docs.columns and plain(cleaned, "doc_id") == [(3,), (4,), (6,), (7,)]
    assert spaced_seeds.leaks(empty, items).count() == spaced_seeds.leaks(docs, items.filter("false")).count() == 0
    assert spaced_seeds.leaks(odd, items).count() == 0


def test_rows_are_cleaned_by_their_own_text(spark):
    """A leaking and a clean row under one id and under none."""
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(k, t) for k in (1, None) for t in (item, "a " + item, "clean text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(100, item)], "item_id long, text string")
    expected = sorted([(1, "clean text"), (1, None), (None, "clean text"), (None, None)], key=repr)
    assert plain(spaced_seeds.clean(docs, items), "doc_id", "text") == expected
    assert plain(spaced_seeds.leaks(docs, items), "doc_id", "start") == [(1, 0), (None, 0), (None, 1)]


def test_every_place_of_a_repeated_phrase_is_compared(spark):
    """A phrase comes several times in an item; the document has it with what follows one of them, whichever that is."""
    phrase = [f"p{i}" for i in range(12)]
    after = [[f"a{k}x{i}" for i in range(12)] for k in range(3)]
    item = " ".join(["intro"] * 12 + sum((phrase + a for a in after), []))
    rows = [(k, " ".join([*phrase, "w", "x", "y", "z", *a[4:]])) for k, a in enumerate(after)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(100, item)], "item_id long, text string")
    got = plain(spaced_seeds.leaks(docs, items), "doc_id", "n_matched", "n_compared", "start")
    assert got == [(k, 20, 24, 0) for k in range(3)]


def all_leaks(docs, items, window, percent):
    """Every stretch of every item at every place of every document."""
    found = {}
    for d, text in docs:
        t = text.split()
        for i, item in items:
            b = item.split()
            n = min(len(b), window)
            for s in range(len(b) - n + 1):
                for p in range(len(t) - n + 1):
                    same = sum(x == y for x, y in zip(t[p : p + n], b[s : s + n]))
                    if 100 * same >= percent * n:
                        found[d, i] = max(found.get((d, i), (0, 0, 0)), (same, -p, n))
    return sorted(((*k, n, length, -p) for k, (n, p, length) in found.items()), key=repr)


def test_leaks_equal_brute_force(spark):
    """Items of any length with as many words replaced, anywhere, as the rule allows, and with one more."""
    import random

    r = random.Random(7)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 31)]
    docs = []
    for n, item in items:
        part = item.split()[r.randrange(max(1, n - 23)) :][:24]
        for extra in (0, 0, 0, 0, 0, 0, 1):
            w = list(part)
            for k in r.sample(range(len(w)), min(len(w), len(w) // 5 + extra)):
                w[k] = "other"
            docs.append((len(docs), " ".join(["before"] * r.randrange(4) + w + ["after"] * r.randrange(4))))
    got = spaced_seeds.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    expected = all_leaks(docs, items, 24, 80)
    assert len(expected) >= 180
    assert plain(got, "doc_id", "item_id", "n_matched", "n_compared", "start") == expected


def test_every_leak_keeps_a_mask():
    """All ways to replace as many words as the rule allows leave one mask untouched."""
    from itertools import combinations

    for n in range(1, 26):
        masks = [set(m) for m in spaced_seeds.masks(n, 80)]
        assert masks and all(m <= set(range(n)) for m in masks)
        assert all(any(m.isdisjoint(c) for m in masks) for c in combinations(range(n), n // 5))


def test_large_benchmarks_give_the_same_leaks(spark, monkeypatch):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    items = queries.table(spark, "/root/testdata/sf0.001", "benchmark")
    small = plain(spaced_seeds.leaks(docs, items), "*")
    monkeypatch.setattr(spaced_seeds, "BROADCAST_BYTES", 0)
    assert small and plain(spaced_seeds.leaks(docs, items), "*") == small


def test_language(spark, odd, empty):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = string_kernel.fit(docs.filter(~held))
    got = string_kernel.predict(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert n > 20 and right >= 0.97 * n
    out = string_kernel.predict(odd, model, F.lit(True)).collect()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {4, 5, 6, 13} and all(0 <= r.score <= 1 for r in out)
    assert string_kernel.predict(empty, model, F.lit(True)).count() == 0
    assert string_kernel.fit(odd.filter("lang IS NULL")) is None
    assert {r.lang_pred for r in string_kernel.predict(odd, None, F.lit(True)).collect()} == {"und"}


def test_urls(spark):
    urls = [
        (1, "https://WWW.Example.com/en/x?y=/es/"),
        (2, "http://a.example.com/en/"),
        (3, "http://example.com/en"),
        (4, "http://b.net/es/1#top"),
        (5, "http://notcom/x"),
        (6, "http://com"),
        (7, None),
        (8, ""),
        (9, "no scheme/en/"),
        (10, "https://host.org?x://y/z"),
        (10, "https://host.org?x://y/z"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("score", F.lit("x"))
    got = {r.page_id: r for r in url_models.judge(pages, queries.URL_RULES).collect()}
    assert [got[k].rule for k in range(1, 11)] == [
        "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None,
    ]
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/x")
    assert (got[10].host, got[10].path) == ("host.org", "") and (got[9].host, got[9].path) == ("", "")
    assert [got[k].verdict for k in (1, 2, 3, 4)] == ["allow", "block", "allow", "block"]
    assert url_models.judge(pages.filter("false"), queries.URL_RULES).count() == 0
    learned = url_models.judge(queries.table(spark, "/root/testdata/sf0.01", "pages"), queries.URL_RULES)
    assert learned.filter("rule IS NULL").select("verdict").distinct().count() == 2


def test_url_scores_equal_counts_of_strings(spark, monkeypatch):
    """Both ways to score, next to counts kept by the strings themselves."""
    import math
    import random
    import zlib

    r = random.Random(5)
    made = ["http://" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24)) + e for e in (".com/a", ".net/es/") for _ in range(2000)]
    pages = spark.createDataFrame([*enumerate([*made, made[0], "", "none", None])], "page_id long, url string")
    seen = {k: (u or "").split("://")[-1] for k, u in enumerate([*made, made[0], "", "none", None])}
    n = Counter()
    for k in seen:
        if k < 4001 and zlib.crc32(seen[k].encode()) % 5:
            text = "\0" * 5 + seen[k]
            for at in range(5, len(text)):
                for o in range(6):
                    n.update([(".com" in text, text[at - o : at + 1], 1), (".com" in text, text[at - o : at], 0)])

    def score(text):
        total, padded = 0.0, "\0" * 5 + text
        for at in range(5, len(padded)):
            p = {c: 1 / 256 for c in (True, False)}
            for o in range(6):
                p = {c: (n[c, padded[at - o : at + 1], 1] + 2 * p[c]) / (n[c, padded[at - o : at], 0] + 2) for c in p}
            total += math.log(p[True] / p[False])
        return total / max(len(text), 1)

    expected = {k: score(t) for k, t in seen.items()}
    for size in (url_models.runtime.BROADCAST_BYTES, 0):
        monkeypatch.setattr(url_models.runtime, "BROADCAST_BYTES", size)
        got = {x.page_id: x.score for x in url_models.judge(pages, queries.URL_RULES).collect()}
        assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) < 1e-9


def test_pages(spark):
    rows = [(1, "u", "<p>Some text, here.</p>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = plain(tag_paths.extract(pages), "page_id", "url", "text", "n_chars")
    assert got == [(1, "u", "Some text, here.", 16), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0)]
    assert tag_paths.extract(pages.filter("false")).count() == 0


def test_page_texts_of_the_table(spark):
    """All pages of the table are articles: the text is what the article holds."""
    from html import unescape

    rows = queries.table(spark, "/root/testdata/sf0.001", "pages").collect()
    got = {r.page_id: r.text for r in queries.queries()["op1_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    items = [r.text for r in queries.table(spark, folder, "benchmark").collect()]
    for start in (docs, docs.filter("false")):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            before = texts(rows)
            rows = corpus_pipeline.stored(stage(spark, rows, folder))
            if name == "quality_rules":
                expected = [(k, t) for k, t in before if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]]
            elif name == "line_dedup":
                kept = lines_kept(before)
                expected = [(k, kept[k, t][2]) for k, t in before]
            elif name == "near_dedup":
                stay = {c[0] for c in components(before, 5, 80) if c[3]}
                expected = [(k, t) for k, t in before if k is None or k in stay or not WORD.search(t or "")]
            elif name == "decontaminate":
                # no row holds half of the words of a window of an item, so none can be a leak
                split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
                for own in (set(split(t)) for _, t in before):
                    for item in items:
                        assert max(sum(x in own for x in split(item)[i : i + 24]) for i in range(len(split(item)))) < 12
                expected = before
            if name != "encode":
                assert rows.columns == docs.columns
                assert sorted(texts(rows), key=repr) == sorted(expected, key=repr)
        assert rows.count() == len(expected) and rows.filter("NOT round_trip").count() == 0
        assert bool(expected) == (start is docs)


def test_pipeline_stages_on_the_table(spark):
    """Each stage's decisions against plain Python on the rows it was given."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    steps = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.stored(steps["quality_rules"](spark, docs, folder))
    judged = queries.queries()["op5_quality_rules"](spark, folder).filter("kept")
    assert plain(kept, "doc_id") == plain(judged, "doc_id")
    lines = corpus_pipeline.stored(steps["line_dedup"](spark, kept, folder))
    expected = lines_kept(texts(kept))
    assert plain(lines, "doc_id", "text", "n_chars") == sorted(
        ((k, expected[k, t][2], len(expected[k, t][2])) for k, t in texts(kept)), key=repr
    )
    near = corpus_pipeline.stored(steps["near_dedup"](spark, lines, folder))
    ids = {c[0] for c in components(texts(lines), 5, 80) if c[3]}
    assert {r.doc_id for r in near.collect()} == ids

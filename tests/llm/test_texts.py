"""Parts that need no Spark: held to the libraries or to plain definitions."""

import random

import numpy as np
import public_tokenizers
import pytest

from seqloom.llm import piece_viterbi, signature_join, span_doubling, string_kernel, tag_paths, token_resync, url_models

PARTS = ["a", "é", " ", "  ", "\n", "\n\n  ", "'s", "'ll", "'l", "<|endoftext|>", "<|endof", "<0x41>", "<s>", "!!", "123", "漢字", "😀", "\t", "x" * 40, " the", "ing"]


def mixed(n: int) -> list[str]:
    r = random.Random(5)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 400))) for _ in range(n)]
    return [*out, "", " ", "a" * 3000, " " * 3000, "<|endoftext|>" * 200, "'s" * 500, "the" * 400, *[" " * k + "the" for k in range(1, 40)]]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 40), (1000, 64)])
def test_spliced_ids_equal_one_call(chunk, overlap):
    tok = token_resync.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for text in mixed(60):
        whole = tok.encode(text, add_special_tokens=False).ids
        assert [i for run in token_resync.spliced_ids(tok, text, chunk, overlap) for i in run] == whole


@pytest.fixture(scope="module")
def pieces():
    return piece_viterbi.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_equal_the_library(pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*mixed(150), "The quick brown fox jumps over the lazy dog. " * 20, "internationalisation unbelievable étonnamment"]
    for text, raw in zip(texts, piece_viterbi.Encoder(pieces).encode(texts)):
        ids = np.frombuffer(raw, "<i4")
        assert ids.tolist() == library.encode(text)
        assert pieces.decode(ids) == text


def test_scores_are_summed_in_unigram_models(pieces):
    """The same pieces read as a unigram model, next to the best sum over all cuts."""
    import copy

    model = copy.copy(pieces)
    model.merges, model.score = False, np.where(np.isfinite(pieces.score), np.maximum(pieces.score, -1e6), 0.0)
    at = {int(h): int(i) for h, i in zip(model.keys, model.ids)}
    for word in ["▁the", "▁another", "▁winding", "abcabc", "▁😀x"]:
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - model.longest), end):
                i = at.get(model._hash(word[start:end]), model.n if end - start == 1 else None)
                if i is not None:
                    options.append((best[start][0] + model.score[i], best[start][1] + [i]))
            best.append(max(options, key=lambda o: o[0]))
        got = model.search([word])[0]
        assert sum(model.score[i] for i in got) == pytest.approx(best[-1][0])


def test_pages():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="home">
    <header><h1>Site</h1></header><div id="menu"><ul><li><a href="/">Home</a><li><a href="/x">Other things</a></ul></div>
    <div class="ad">Buy this, now. It is good.</div><!-- <p>gone</p> --><div class="page"><div class="content">
    <h2>A &amp; B</h2><p>First paragraph, with <a href=x>a link</a> and&nbsp;more
    text. It goes on.<p>Second one.</p><ul><li>Point one is here, too.</li><li>Point two, as well.</li></ul>
    <p>if (a < b) stop.</p><script>var x = "</p>";</script></div>
    <div class="comments"><p>I like it, thanks.</p></div><aside>Aside.</aside></div>
    <form><p>Your name, please.</p></form><div class="cookie-notice">We use cookies.</div><footer>&copy; us.</footer>"""
    assert tag_paths.main_text(page).split("\n\n") == [
        "A & B",
        "First paragraph, with a link and more text. It goes on.",
        "Second one.",
        "Point one is here, too.",
        "Point two, as well.",
        "if (a < b) stop.",
    ]


STORY = ["The first paragraph of the story, with a comma.", "The second one is here. It goes on, and on.", "The end."]


@pytest.mark.parametrize(
    "holder",
    [
        '<body class="home has-sidebar"><div>{}</div>',
        '<html class="no-menu"><body><div>{}</div>',
        '<body><div id="content" class="no-sidebar">{}</div>',
        '<body><article class="post comments-open">{}</article>',
        '<body><main class="with-ads">{}</main>',
        '<body><div class="page has-sidebar"><div class="social-story">{}</div></div>',
        '<body><div class="a">Short.</div><article class="post comments-open">{}</article>',
    ],
)
def test_names_of_containers_do_not_cut_the_story(holder):
    story = "".join(f"<p>{x}</p>" for x in STORY)
    ad = '<div class="ad"><p>Buy this, now.</p></div><div class="share">Tell a friend.</div>'
    got = tag_paths.main_text(holder.format(story + ad)).split("\n\n")
    assert [x for x in got if x != "Short."] == STORY


def test_long_prose_stays_whatever_its_name():
    """A name lowers the ratio of a block, and does not remove it."""
    long = "A long part of the story, with commas, and with more than one sentence. It goes on, and on. " * 6
    page = "<body><div>" + "<p>Short words here.</p>" * 40 + f'<div class="related-story"><p>{long}</p></div></div>'
    assert long.strip() in tag_paths.main_text(page)


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<!--", "<a href='", "</p></div>", "<nav>x</nav>", "<script>x"])
def test_pages_without_text(page):
    assert tag_paths.main_text(page) == ""


def test_pages_of_text_only():
    assert tag_paths.main_text("just  text\n&lt;b&gt;") == "just text <b>"


def test_windows_of_words():
    r = random.Random(1)
    words = [r.choice("abc") * r.randint(1, 3) for _ in range(200)]
    t = span_doubling.Text("\t" + "  \n".join(words), [span_doubling.Hashes(0)])
    h = t.windows(3).tolist()
    triples = [tuple(words[i : i + 3]) for i in range(198)]
    assert len(set(zip(h, triples))) == len(set(h)) == len(set(triples))
    lead, _ = t.leaders(3, 8)
    assert all(0 <= p - i <= 5 for i, p in enumerate(lead.tolist())) and len(lead) == 193


def test_lengths():
    assert span_doubling.lengths(35) == [18, 35]
    assert span_doubling.lengths(35, 5) == [5, 9, 18, 35]
    assert span_doubling.lengths(3) == [3]


def test_signatures_estimate_similarity():
    maker = signature_join.Shingles(2, 512)
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(60, 460))
    s, t = signature_join.word_shingles(a, 2), signature_join.word_shingles(b, 2)
    assert len(maker.of(a)) == len(s)
    agree = (maker.signature(maker.of(a)) == maker.signature(maker.of(b))).mean()
    assert abs(agree - len(s & t) / len(s | t)) < 0.07
    assert 30 < signature_join.least_matches(64, 80) < 45
    assert signature_join.word_shingles("One", 2) == {("one",)} and signature_join.word_shingles(" ", 2) == set()


def test_kernel_of_equal_texts_is_one():
    spectrum = string_kernel.Spectrum()
    sets, known = spectrum.sets(["the winter river", "la rivière d'hiver", "123", None])
    assert known.tolist() == [True, True, False, False]
    model = string_kernel.fit_sets(spectrum, np.packbits(sets[:2], axis=1), ["en", "fr"], 1, 1.0)
    k = model.kernel(sets[:2])
    assert np.allclose(np.diag(k), 1) and k[0, 1] < 0.6
    assert model.predict(["the winter river", "la rivière d'hiver", "1", None])[0] == ["en", "fr", "und", "und"]


def test_url_counts_and_scores():
    hashing = url_models.Hashing(3, 16)
    owner, joint, alone = hashing.slots([b"abab", b"", b"ab"])
    assert owner.tolist() == [0, 0, 0, 0, 2, 2]
    assert joint[0][0] == joint[0][2] and joint[1][0] == joint[1][4] and joint[1][0] != joint[1][2]
    counts = np.zeros((2, 1 << 16), np.float32)
    for c, text in ((0, b"abab"), (1, b"cdcd")):
        _, j, a = hashing.slots([text])
        for s in (j, a):
            np.add.at(counts[c], s.ravel(), 1)
    score = url_models.log_ratio([b"abab", b"cdcd", b""], counts, hashing, 2.0)
    assert score[0] > 0 > score[1] and score[2] == 0


LONG = [f"Sentence {k} of the story goes on for a while, with a comma, and then it ends. Another one follows it." for k in range(3)]


def as_paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_reader_comments_longer_than_the_story_go():
    said = [f"Comment {k}: I have read this, and I do not agree with it at all, as I said before. It is wrong." for k in range(30)]
    for name in ('class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"'):
        page = f'<body><div class="story">{as_paragraphs(LONG)}</div><div {name}>{as_paragraphs(said)}</div>'
        assert tag_paths.main_text(page).split("\n\n") == LONG


def test_comments_marked_up_as_articles_go():
    said = "".join(f'<article class="comment c{k}"><p>I like it, and I say so. Thanks, number {k}.</p></article>' for k in range(4))
    page = f"<body><main><section>{as_paragraphs(LONG)}{said}</section></main>"
    assert tag_paths.main_text(page).split("\n\n") == LONG


def test_a_story_beside_teasers_in_articles_stays():
    teasers = "".join(f"<article><h3>Teaser {k}</h3><p><a href=x>Read what happened next, here.</a></p></article>" for k in range(2))
    page = f'<body><div class="story">{as_paragraphs(LONG)}</div><div class="more">{teasers}</div>'
    got = tag_paths.main_text(page).split("\n\n")
    assert got[:3] == LONG


def test_linked_paragraphs_and_references_stay():
    linked = "<p><a href=x>A paragraph that is one link, from its start to its end.</a></p>"
    refs = "<ol>" + "".join(f"<li><a href=x>Reference number {k}, a title.</a></li>" for k in range(6)) + "</ol>"
    for holder in ("<body><article>{}</article>", '<body><div class="story">{}</div>'):
        got = tag_paths.main_text(holder.format(as_paragraphs(LONG) + linked + refs)).split("\n\n")
        assert len(got) == 10 and got[:3] == LONG and got[3].startswith("A paragraph") and got[-1].startswith("Reference number 5")


def test_formulas_and_drawings_inside_a_sentence_stay():
    page = "<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><text>a curve</text></svg>, or <object>a film</object>.</p></article>"
    assert tag_paths.main_text(page) == "Let x=2 and a curve, or a film."


def test_menus_of_links_before_the_story_go():
    menu = "<ul>" + "".join(f"<li><a href=x>Section {k}</a></li>" for k in range(12)) + "</ul>"
    page = f'<body><div class="top">{menu}</div><div class="story">{as_paragraphs(LONG * 3)}</div>'
    assert tag_paths.main_text(page).split("\n\n") == LONG * 3


def test_numerals_are_no_letters():
    spectrum = string_kernel.Spectrum()
    assert spectrum.sets(["½ ²", "Ⅷ", "①②", "a½", "漢"])[1].tolist() == [False, False, False, True, True]


def test_kernel_and_ridge_equal_plain_sets():
    """Scores next to kernels of Python sets, a whitened landmark map and ridge equations, all written out."""
    spectrum = string_kernel.Spectrum()
    r = random.Random(9)
    words = {"en": "the of and river stone winter market".split(), "fr": "le la les rivière hiver marché jardin".split()}
    texts, langs = [], []
    for k in range(40):
        a = ("en", "fr")[k % 2]
        texts.append(" ".join(r.choice(words[a]) for _ in range(8)))
        langs.append(a)
    order = sorted(range(40), key=lambda i: langs[i])
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    sets, _ = spectrum.sets(texts)
    model = string_kernel.fit_sets(spectrum, np.packbits(sets, axis=1), langs, 5, 1.0)
    grams = [set(spectrum.places(t).tolist()) for t in texts]
    marks = [i for a in ("en", "fr") for i in [j for j in range(40) if langs[j] == a][:5]]
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    plain = np.array([[kernel(g, grams[m]) for m in marks] for g in grams])
    assert np.allclose(model.kernel(sets), plain)
    values, vectors = np.linalg.eigh(plain[marks])
    features = np.c_[plain @ (vectors / np.sqrt(values)), np.ones(40)]
    for name, column in zip(model.langs, model.weights.T):
        y = np.array([1.0 if a == name else -1.0 for a in langs])
        beta = np.linalg.inv(features.T @ features + np.eye(11)) @ features.T @ y
        assert np.allclose(np.c_[plain, np.ones(40)] @ column, features @ beta)
    fresh = ["the river and the stone", "la rivière et le jardin", "of winter", "les hiver"]
    assert model.predict(fresh)[0] == ["en", "fr", "en", "fr"]


def test_coordinates_of_different_sets_differ():
    """Least values have small leading bits: cut to those, thousands of unrelated sets would share some by chance."""
    maker, rng = signature_join.Shingles(5, 64), np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(3000)]
    sigs = np.stack([maker.signature(x) for x in sets])
    assert sum(len(sigs) - len(np.unique(c)) for c in sigs.T) <= 2
    near = np.concatenate([sets[0][:270], rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
    assert abs((maker.signature(near) == sigs[0]).mean() - 270 / 330) < 0.2

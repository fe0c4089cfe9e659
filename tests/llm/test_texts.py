"""Merge-dropout, language model and pages: exact round trips and brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from strataspark.llm import log_bilinear, merge_dropout, pages

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b ", "The thing.\n\nIs\tthere", " lead", "trail ", "中文字😀 ü", "\x00\x01", "a" * 400,
    "the " * 200, "Eraning of a and thersh erorst; ciónezado ungheit", "éàü" * 50, "word" * 60,
]


@pytest.fixture(scope="module")
def model():
    return merge_dropout.PieceModel(PIECES)


@pytest.mark.parametrize("text", TEXTS)
def test_without_dropout_pieces_are_the_models(model, text):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert np.frombuffer(model.encode(text), "<u4").tolist() == whole.encode(text)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.6, 1.0])
@pytest.mark.parametrize("text", [*TEXTS, "▁ mark▁in ▁▁", "▁"])
def test_decoding_gives_the_text_back(text, share):
    model = merge_dropout.PieceModel(PIECES)
    for seed in (1, 2):
        for variant in (0, 1):
            ids = model.encode(text, seed, variant, share)
            assert model.decode(ids) == text
            model.words.clear()
            assert model.encode(text, seed, variant, share) == ids
            model.words.clear()


def test_agendas_agree_and_vary(model):
    found = set()
    for key in range(60):
        for word in ("▁internationalization", "▁thereheing", "ß😀x", "▁"):
            for share in (0.0, 0.2, 0.7):
                ids = model.merge(word, key, share)
                assert ids == model.spell(model.merge_long(word, key, share))
                if share:
                    found.add(tuple(ids))
    assert len(found) > 60
    words = ["▁" + w for t in TEXTS for w in t.split(" ") if w and len(w) < 90] + ["▁", "x", "▁ß😀", "▁\x00é"]
    for share in (0.0, 0.1, 0.6, 1.0):
        keys = [model.key(w, 7, 1) for w in words]
        together = model.merge_many(words, keys, share)
        assert [np.frombuffer(b, "<u4").tolist() for b in together] == [
            model.merge(w, k, share) for w, k in zip(words, keys, strict=True)
        ]
    assert model.merge_many([], [], 0.1) == []
    assert len(model.merge("▁internationalization", 1, 1.0)) == len("▁internationalization")


def test_known_words_change_nothing(monkeypatch):
    monkeypatch.setattr(merge_dropout, "_WORDS_KEPT", 5)
    learned, plain = merge_dropout.PieceModel(PIECES), merge_dropout.PieceModel(PIECES)
    learned.known(7, 1, 0.3).learn(TEXTS)
    for text in TEXTS * 2:
        assert learned.encode(text, 7, 1, 0.3) == plain.encode(text, 7, 1, 0.3)


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (90, None, None, None)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, ids string, variant int")
    found = merge_dropout.encode(docs, PIECES, seed=3, share=0.2, with_ids=True)
    assert all(r.lossless for r in found.collect())
    back = merge_dropout.decode(found, PIECES).collect()
    assert sorted(((r[0], r[1]) for r in back), key=repr) == sorted(
        ((r[0], r[1] or "") for r in [*rows, rows[3]]), key=repr
    )
    assert merge_dropout.encode(docs.limit(0), PIECES, seed=3, share=0.2).count() == 0


def test_occurrences_of_a_word_are_cut_each(spark, model):
    docs = spark.createDataFrame([(i, "internationalization " * 200) for i in range(20)], "doc_id long, text string")
    found = merge_dropout.encode(docs, PIECES, seed=7, share=0.1, with_ids=True).collect()
    assert len({r.variant for r in found}) == len({tuple(r.ids) for r in found}) == 20
    assert all(r.lossless for r in found)
    cuts = set()
    for place in range(200):
        key = model.key("▁internationalization", 7, found[0].variant, place)
        cuts.add(tuple(model.merge("▁internationalization", key, 0.1)))
    assert len(cuts) > 5


@pytest.mark.parametrize("share", [0.0, 0.1, 0.6, 1.0])
def test_remembered_decisions_change_nothing(share, monkeypatch):
    monkeypatch.setattr(merge_dropout, "_TOGETHER", 50)
    model = merge_dropout.PieceModel(PIECES)
    texts = [*TEXTS, "thereheing of thereheing a  thereheing " * 30, "x" * 99 + " " + "y" * 98] * 3
    variants = [-(1 << 63) + 5, (1 << 62) + 1] * len(texts)
    found = model.encode_many(texts, variants[: len(texts)], 7, share)
    for text, variant, ids in zip(texts, variants, found, strict=False):
        wanted = []
        for place, word in enumerate(re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁")) if text else []):
            wanted += model.merge(word, model.key(word, 7, variant, place), share)
        assert np.frombuffer(ids, "<u4").tolist() == wanted


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 40))
        at = (rng.zipf(1.4, n) + np.arange(n) * (i % 2)) % 300
        rows.append((i, " ".join(names[k] for k in at), "x", 1))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, "w1 Only_here É é", None, None), rows[0], rows[9]]
    rows += [(902, "W1 " * 20_000 + "x" * 300, None, None)]
    return rows


def test_scores_follow_their_definition(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, words string, n long")
    learned = log_bilinear.learn(docs)
    found = log_bilinear.score(docs, learned).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in corpus}
    counts = Counter()
    for i, text, *_ in corpus:
        if not held[i]:
            counts.update(words_of(text))
            counts[""] += 1
    total, distinct = sum(counts.values()), len(counts)
    own = learned.vocabulary.own
    table = learned.bilinear.table()
    assert np.allclose((10.0**table).sum(axis=2), 1)
    members = {}
    for w in counts:
        if w and w.encode() not in own:
            members.setdefault(log_bilinear.ending(w.encode()), []).append(counts[w])
    wanted = []
    for i, text, *_ in corpus:
        tokens = [*words_of(text), ""]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        score, before, last = 0.0, 0, 0
        for w in tokens:
            c = 0 if not w else own.get(w.encode()) or log_bilinear.ending(w.encode())
            score += table[before, last, c]
            if w and w.encode() not in own:
                all_of = members.get(c, [])
                score += math.log10((counts[w] + 1) / (sum(all_of) + len(all_of) + 1))
            before, last = last, c
        wanted.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    got = sorted((tuple(r) for r in found), key=lambda r: (repr(r[0]), r[1]))
    wanted.sort(key=lambda r: (repr(r[0]), r[1]))
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4] for g in got], [w[4] for w in wanted])
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-6)


def test_model_learns_order_and_small_vocabularies_are_joined(spark, monkeypatch, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, words string, n long")
    whole = log_bilinear.score(docs, log_bilinear.learn(docs)).collect()
    monkeypatch.setattr(log_bilinear, "SENT", log_bilinear.OWN + 5)
    joined = log_bilinear.score(docs, log_bilinear.learn(docs)).collect()
    key = lambda r: (repr(r[0]), r[1], round(r[4], 6))
    for a, b in zip(sorted(whole, key=key), sorted(joined, key=key), strict=True):
        assert a[:4] == b[:4]
        assert np.allclose(a[4:], b[4:])
    held = [r for r in whole if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    learned = log_bilinear.learn(docs)
    assert log_bilinear.score(docs, learned).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = log_bilinear.score(one, learned).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


SIDES = """<html><head><title>T</title><style>p{}</style><script>var a="</p>x<b>";</script></head><body>
<header><h1>Site</h1></header><div id="cookie-banner">We use cookies, really.</div>
<nav><ul><li><a href="/">Home</a><li><a href="/x">News &amp; more</a></ul></nav>"""
END = """<section class="comments"><h2>Comments</h2><p>I liked this a lot, it was good, I say.</p></section>
<aside><p>Related things that you may like to read, too.</p></aside><footer>&copy; 2020</footer></body></html>"""
PAGE = (
    SIDES + "<article><h1>A  title</h1><p>First <b>bold</b> text, with words\n and more,&nbsp;yes &lt;3."
    "<p>Second one<br>goes on.<div class='ad'>Buy now, buy cheap things today.</div>"
    "<form><label>Mail</label><button>Send</button></form><p>Third, and last: it ends here.</p></article>" + END
)


def test_blocks_of_a_page():
    found = pages.blocks(PAGE)
    texts = [b.text for b in found]
    assert "First bold text, with words and more, yes <3." in texts
    assert "Second one goes on." in texts
    assert "News & more" in texts
    assert not any("var a" in t or "p{}" in t for t in texts)
    assert pages.blocks("") == [] and pages.blocks("<p") == []
    assert [b.text for b in pages.blocks("a < b <p title='x>y'>c<!-- no --><unclosed")] == ["a < b", "c"]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("""<p title="it's">One sentence.</p><p>Two.</p><p>I don't know.</p><p>End.</p>""",
         ["One sentence.", "Two.", "I don't know.", "End."]),
        ("""<div><img alt="Bob's > Al's">One.</div><p title='say "x>'>Two's.</p>""", ["One.", "Two's."]),
        ("<p title=it's>One.</p><p data-a=x=\"y'>Two.</p>It's", ["One.", "Two.", "It's"]),
        ("<p title = 'a>b' id=x>One.</p><p title=\"never closed>Two.", ["One.", "Two."]),
        (f"<p title=\"{'>' * 20_000}'\">One.</p><p>It's.</p>", ["One.", "It's."]),
        ("<svg viewBox='0 0 1 1'/><p>One.</p><math /><p>Two.</p><svg><path/>x</svg><p>End.</p>",
         ["One.", "Two.", "End."]),
        ("<p>One.</p><svg class=x/>left out</svg><p>End.</p>", ["One.", "End."]),
    ],
)
def test_tags_end_outside_quotes(page, texts):
    assert [b.text for b in pages.blocks(page)] == texts


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    model = pages.Labeller.new()
    sizes = np.array([3, 1, 4])
    x, y = rng.random((8, pages.INPUTS)), rng.integers(0, 2, 8).astype(float)

    def loss():
        z = model.run(x, sizes)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    slopes = model.slopes(x, sizes, y)
    for name in ("wx", "wh", "b", "wo", "bo"):
        values = getattr(model, name)
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in values.shape)
            kept = values[at]
            values[at] = kept + 1e-5
            up = loss()
            values[at] = kept - 1e-5
            down = loss()
            values[at] = kept
            assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-6


def test_pages_are_extracted(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = pages.learn(given)
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", None), (1, "u", PAGE, "x"),
            (3, "w", "<article>" + "<p>One more paragraph, of some words." * 3000, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(docs, labeller).select("page_id", "main.text").collect()
    texts = {r[0]: r[1] for r in got}
    assert len(got) == len(rows)
    assert texts[1] == (
        "A title\n\nFirst bold text, with words and more, yes <3.\n\nSecond one goes on."
        "\n\nThird, and last: it ends here."
    )
    assert texts[2] == texts[None] == ""
    assert texts[3].count("\n\n") == 2999
    assert pages.extract(docs.limit(0), pages.learn(docs.limit(0))).count() == 0


def test_given_pages_give_their_articles(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = pages.extract(given, pages.learn(given)).select("html", "main.text").collect()

    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:h1|p|div|ul|li)\b[^>]*>", re.sub(r"</?(?:b|i)>|<br>", " ", inner))
        return [w for p in parts for w in pages.html.unescape(re.sub("<[^>]*>", "", p)).split()]

    right = sum(r["text"].split() == article(r["html"]) for r in found)
    assert right >= 0.98 * len(found)

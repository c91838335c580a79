"""Language, toxicity, page text and GIF columns."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clauseframe.llm import gif_media, language_id, main_text, toxicity

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(public_tokenizers.path(language_id.VOCABULARY))
    prob = np.random.default_rng(1).random((len(pieces.names), 2))
    prob /= prob.sum(axis=0)
    ids = {p: i for i, p in enumerate(pieces.names)}

    def brute(word):
        if not word:
            return np.ones(2)
        out = brute(word[1:]) * np.exp(language_id.UNKNOWN)
        for k in range(1, min(len(word), pieces.longest) + 1):
            if word[:k] in ids:
                out = out + prob[ids[word[:k]]] * brute(word[k:])
        return out

    words = ["▁the", "▁ungen", "▁日x", "▁a", "▁stations"]
    assert np.allclose(pieces.log_prob(words, prob), [np.log(brute(w)) for w in words])
    long = "▁" + "ab" * 2000
    assert np.isfinite(pieces.log_prob([long], prob)).all()


def _vocabulary():
    """The normal pieces of the model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(language_id.VOCABULARY))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def test_sums_with_all_pieces_of_the_model_file():
    names = _vocabulary()
    pieces = language_id.Pieces(public_tokenizers.path(language_id.VOCABULARY))
    assert pieces.names == names and pieces.longest == max(map(len, names)) == 16
    prob = np.random.default_rng(1).random((len(names), 2))
    prob /= prob.sum(axis=0)
    ids = {p: i for i, p in enumerate(names)}

    def chart(word, p, unknown):
        out = [Fraction(1)]  # exact numbers do not underflow
        for t in range(1, len(word) + 1):
            out.append(out[t - 1] * unknown + sum(out[k] * p[word[k:t]] for k in range(max(0, t - 16), t) if word[k:t] in p))
        return math.log(out[-1].numerator) - math.log(out[-1].denominator)

    # the borders of 256, of a stretch and of `longest` lie inside pieces
    long = ["▁" + "x" * k + "information" * 40 for k in range(3)]
    words = ["▁something", "▁different", "▁information", "▁responsibility", *long]
    tables = [{n: Fraction(float(prob[ids[n], j])) for n in ids} for j in range(2)]
    want = [[chart(w, t, Fraction(float(np.exp(language_id.UNKNOWN)))) for t in tables] for w in words]
    assert np.allclose(pieces.log_prob(words, prob), want, rtol=1e-9)


def test_stretches_change_nothing(monkeypatch):
    pieces = language_id.Pieces(public_tokenizers.path(language_id.VOCABULARY))
    prob = np.random.default_rng(2).random((len(pieces.names), 2))
    prob /= prob.sum(axis=0)
    words = ["▁" + "information" * 30, "▁" + "differenttalk" * 26 + "s", "▁short", "▁日本語"]
    whole, uses = pieces.log_prob(words, prob), pieces.expected(words, np.array([1.0, 2.0, 3.0, 1.0]), prob[:, 0])
    monkeypatch.setattr(language_id, "STRETCH", 32)
    assert np.allclose(pieces.log_prob(words, prob), whole) and np.allclose(pieces.expected(words, np.array([1.0, 2.0, 3.0, 1.0]), prob[:, 0]), uses)
    # expected uses are the derivatives of the log sums
    k = pieces.names.index("information") if "information" in pieces.names else int(uses.argmax())
    step = 1e-6
    up, down = (np.where(np.arange(len(prob)) == k, prob[:, 0] * (1 + d), prob[:, 0])[:, None] for d in (step, -step))
    slope = (pieces.log_prob(words, up) - pieces.log_prob(words, down))[:, 0] @ [1.0, 2.0, 3.0, 1.0] / (2 * step)
    assert uses[k] > 0 and uses[k] == pytest.approx(slope, rel=1e-3)


def test_languages_without_spaces(spark):
    import random

    rng = random.Random(5)
    kinds = {"ja": "のにはをたがでてとしれさある", "zh": "的一是不了人我在有他这中大来"}
    text = lambda k: "".join(rng.choice(kinds[k]) for _ in range(120))
    rows = [(i, text(k), k) for i, k in enumerate(["ja", "zh"] * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table, public_tokenizers.path(language_id.VOCABULARY), rounds=1)
    assert np.abs(model.prob[:, 0] - model.prob[:, 1]).max() > 0.01
    new = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(["ja", "zh"] * 10)], "doc_id long, text string, lang string")
    got = language_id.predict(new, model).collect()
    assert all(r["lang"] == r["lang_pred"] and r["lang_score"] > 0.99 for r in got)


def test_language(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op5_language_id(spark, SF).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got["doc_id"], got["held_out"]))
    model = language_id.fit(table, public_tokenizers.path(language_id.VOCABULARY), per_language=50, rounds=1)
    odd = language_id.predict(docs, model)
    assert set(docs.columns) < set(odd.columns) and {r["lang_pred"] for r in odd.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(table.limit(0), public_tokenizers.path(language_id.VOCABULARY))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


def _abuse():
    from tests.llm.conftest import sentence

    bad = ["gromblar", "skuntel", "vexidork"]
    rows, labels = [], []
    for i in range(300):
        w = sentence(i, 60).split()
        if i % 5 == 0:
            w[10], w[40] = bad[i % 3], bad[(i // 3) % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_of_other_scripts_and_long_words(spark):
    plain = ["яблоко", "дерево", "солнце", "дорога", "письмо", "окно", "река", "город", "книга", "зима"]
    rows, labels, rng = [], [], np.random.default_rng(1)
    for i in range(240):
        words = [plain[a] + plain[b][:c] for a, b, c in zip(*(rng.integers(0, n, 30) for n in (10, 10, 4)))]
        if i % 5 == 0:
            words[8] = ["дурачина", "дурачище", "x" * 40 + "дурачина"][i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [toxicity.fit(t, marks) for t in (table, table.repartition(7, "text"))]
    assert np.allclose(models[0].weights, models[1].weights) and np.isclose(models[0].bias, models[1].bias)
    margin = toxicity.word_margins(models[0], ["дурачина", "дура-чина", "дуррачина", *plain])
    assert margin[:3].min() > margin[3:].max()
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(table, models[0]).collect()}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels]) > 0.95


def test_witnesses_are_the_strongest_words(spark):
    rows, labels = _abuse()
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    for r in toxicity.witnesses(spark.createDataFrame([(t, m) for (_, t), (_, m) in zip(rows, labels)] + [("", 0), (None, 1)], "text string, toxic int"), model).collect():
        assert np.isclose(r["margin"], toxicity.word_margins(model, [r["word"]])[0], atol=1e-5)
    want = sum(toxicity.word_margins(model, t.split()).max() > toxicity.FLOOR for _, t in rows)
    assert toxicity.witnesses(table.join(marks, "doc_id"), model).count() == want


def test_an_insult_of_two_harmless_words(spark):
    """Both words stand in clean rows as often, but never side by side; some toxic rows have a telling word instead."""
    from tests.llm.conftest import sentence

    rows, labels = [], []
    for i in range(400):
        w = sentence(i, 40).split()
        toxic = i % 4 == 0
        if toxic and i % 8 == 0:
            w[9] = "gromblar"
        elif toxic:
            w[9:11] = ["Walking,", "carpet!"]
        else:
            w[9], w[20] = "walking", "carpet"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    assert ("wa", "ca") in model.pairs
    new = [(1, sentence(900, 30) + " walking carpet " + sentence(901, 30)), (2, sentence(902, 30) + " walking carpets " + sentence(903, 9))]
    new += [(3, sentence(904, 30) + " carpet walking " + sentence(905, 30)), (4, "walking " + sentence(906, 30) + " carpet"), (5, "w a l k i n g"), (6, None)]
    got = {r["doc_id"]: r["toxic_score"] >= toxicity.THRESHOLD for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    seen = {r["doc_id"]: r["toxic_score"] >= toxicity.THRESHOLD for r in toxicity.score(table, model).collect()}
    assert np.mean([seen[i] == bool(t) for i, t in labels]) > 0.97


@pytest.mark.parametrize("start", [20, 4_000])
def test_no_clean_word_of_the_sample_is_left_out(spark, start):
    rows, labels = _abuse()
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marks, start=start)
    clean = sorted({w for (_, text), (_, toxic) in zip(rows, labels) if not toxic for w in text.split()})
    assert toxicity.word_margins(model, clean).max() < 0 < toxicity.word_margins(model, ["gromblar", "skuntel", "vexidork"]).min()


def test_toxicity(spark, docs, none):
    rows, labels = _abuse()
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(table, model).collect()}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels]) > 0.97
    margin = dict(zip(["gromblar", "grom-blar", "gromblaar", "groomblar", "amberb", "ceddara"], toxicity.word_margins(model, ["gromblar", "grom-blar", "gromblaar", "groomblar", "amberb", "ceddara"])))
    assert min(margin["gromblar"], margin["grom-blar"], margin["gromblaar"], margin["groomblar"]) > max(margin["amberb"], margin["ceddara"])
    out = toxicity.score(docs, model)
    assert out.where("toxic_score IS NULL OR toxic_score NOT BETWEEN 0 AND 1").count() == 0 and out.count() == docs.count()
    assert toxicity.score(none, model).count() == 0
    plain = toxicity.fit(table, marks.where("toxic = 0"))
    assert {r["toxic_score"] for r in toxicity.score(docs, plain).collect()} == {0.0}


def test_kernel_is_the_sum_over_subsequences():
    from itertools import combinations

    def brute(word):
        code, out = "^^" + word + "$", {}
        for i, j, k in combinations(range(len(code)), 3):
            if k - i < toxicity.SPAN:
                u = (code[i] if code[i] != "$" else "^", code[j], code[k] if code[k] != "$" else "^")
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def value(a, b):
        x, y = brute(a), brute(b)
        dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    marks, words = ["idiot", "loser", "aa"], ["idiot", "idxiot", "closer", "aaaa", "zz"]
    assert np.allclose(toxicity.Kernel(marks).values(words), [[value(w, m) for m in marks] for w in words], atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="with-sidebar">
<header><h2>Site name</h2><div class="menu"><a href="/">Home</a> <a href="/b">News</a></div></header><nav><ul><li><a href="/x">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you.</div>
{start}<h1>A fine &amp; long title</h1><p>The <b>first</b> paragraph has quite a few words in it,<br>so that it counts.</p><div class="ad">Buy now the best thing ever made by anyone here.</div>
<p>The second&nbsp;paragraph   is here, with a <a href="/l">link</a> &lt;tag&gt;.</p>{end}
<aside class="sidebar"><p>Other stories that you may like to read some time soon.</p></aside><form><label>Mail</label><input><button>Send</button></form>
<section id="comments"><p>A reader says that this is all wrong and that he knows better.</p></section><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
TEXT = "A fine & long title The first paragraph has quite a few words in it, so that it counts. The second paragraph is here, with a link <tag>."


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="wrap"><article>', "</article></div>")])
def test_main_text(start, end):
    assert main_text.main_text(PAGE.replace("{start}", start).replace("{end}", end)) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><article><p>One two three.</p></article></body></html>", "One two three."),
        ("<title>t</title><meta charset=utf-8><style>p{}</style><article><p>One two three.</article>", "One two three."),
        ("<html><head><title>t</title>" + "plain words " * 12, ("plain words " * 12).strip()),
        ("<article><p>The <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>Next.</p></article>", "The x=2 holds. Next."),
        ("<article><p>Seen.</p><video src=v>No video here.</video><object data=o>No object.</object></article>", "Seen. No video here.No object."),
        ('<article><p>First.</p><p class="more">More of it.</p><div class="legal"><p>A law.</p></div><div class="ad">Buy now.</div></article>', "First. More of it. A law."),
        ("<body><noscript>Please enable scripts in order to see all of this fine page as it was meant to be seen</noscript><article><p>Words.</p></article>", "Words."),
        ("<article></article>", ""),
        ("<article><p>Same.</p><p>Same.</p></article>", "Same. Same."),
    ],
)
def test_odd_pages(page, text):
    assert main_text.main_text(page) == text


def test_no_pages(spark):
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<article><p>Cut off in the middle of a ta<b"), (4, "u", "<article><p>Long. " + "word " * 50000 + "</p></article>"), (5, "u", "plain words")]
    got = {r["page_id"]: r for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "Cut off in the middle of a ta" and got[4]["n_chars"] == len("Long. " + "word " * 50000) - 1


def test_minimum_cut_is_minimal():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 6
        source, sink = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost(s) for s in product([True, False], repeat=n))
        assert cost(main_text.minimum_cut(list(source), list(sink), edges)) == pytest.approx(best)


def test_minimum_cut_of_a_long_chain():
    rng = np.random.default_rng(4)
    for spread in (0.3, 1.0, 3.0):
        n = 3000
        net = rng.normal(0, spread, n)
        source, sink, w = np.maximum(net, 0), np.maximum(-net, 0), rng.random(n - 1)
        kept, dropped = sink[0], source[0]  # the least cost by the last node's side
        for i in range(1, n):
            kept, dropped = sink[i] + min(kept, dropped + w[i - 1]), source[i] + min(dropped, kept + w[i - 1])
        side = np.array(main_text.minimum_cut(list(source), list(sink), [(i, i + 1, float(w[i])) for i in range(n - 1)]))
        assert np.where(side, sink, source).sum() + w[side[1:] != side[:-1]].sum() == pytest.approx(min(kept, dropped))


@pytest.mark.parametrize(("odd", "around", "keeps"), [('<p><a href="/x">line</a> more ab</p>', "<p>" + "word " * 30 + "</p>", True), ("<p>" + "word " * 12 + "</p>", '<p><a href="/x">' + "link " * 4 + "</a></p>", False)])
def test_labels_do_not_depend_on_the_place_in_a_long_page(odd, around, keeps):
    for at in (5, 398, 399, 400, 401, 799, 800):
        page = "<html><body><div><section>" + around * at + odd + around * (900 - at) + "</section></div></body></html>"
        labels = [kept for _, kept in main_text.labelled(page)]
        assert len(labels) == 901 and labels[at] is keeps, at


def test_gif_columns(docs, texts):
    for r in gif_media.media_columns(docs).collect():
        if r["doc_id"] not in (None, 1):
            data = (dict(texts)[r["doc_id"]] or "").encode()
            payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    files = {r["doc_id"]: bytes(r["media"]) for r in gif_media.media_files(docs).collect()}
    gif = gif_media.decode([files[10]])[0]
    shown = b"".join(canvas[: f.height, :, 0].tobytes() for f, canvas in gif_media.composed(gif))
    assert shown.decode().rstrip() == dict(texts)[10] and len(gif.frames) > 5
    # the samples alone are not the text: what is transparent comes from the frames before
    assert {f.transparent for f in gif.frames[1:]} == {gif_media.UNSEEN} and b"".join(f.indices.tobytes() for f in gif.frames) != shown


def test_gif_of_no_documents(none):
    assert gif_media.media_columns(none).count() == 0


def _lzw(samples, least):
    """A plain encoder with growing codes, for the decoder."""
    table = {bytes([i]): i for i in range(1 << least)}
    clear, following = 1 << least, (1 << least) + 2
    width, out, now = least + 1, [(1 << least, least + 1)], b""
    for s in samples:
        if now + bytes([s]) in table:
            now += bytes([s])
            continue
        out.append((table[now], width))
        if following < 4096:
            table[now + bytes([s])] = following
            following += 1
            if following > 1 << width and width < 12:
                width += 1
        now = bytes([s])
    out += [(table[now], width), (clear + 1, width)]
    bits, n = 0, 0
    for code, w in out:
        bits |= code << n
        n += w
    return bits.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize(("least", "n"), [(2, 50), (8, 300), (8, 20000), (4, 9000)])
def test_lzw_with_growing_codes(least, n):
    samples = (np.random.default_rng(n).integers(0, 1 << least, n) // 2).astype(np.uint8)
    assert (gif_media.lzw_decode([_lzw(samples.tolist(), least)], least, [n])[0] == samples).all()


def test_frames_disposal_and_transparency():
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes([255, 0, 0, 0, 255, 0])
    frame = lambda kind, index, px: struct.pack("<BBBBHBB", 0x21, 0xF9, 4, kind, 7, index, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 2, 1, 0) + b"\x02" + gif_media._sub_blocks(_lzw(px, 2))  # noqa: E731, SLF001
    gif = gif_media.decode([head + frame(1 << 2, 0, [0, 1]) + frame(3 << 2 | 1, 1, [1, 0]) + frame(2 << 2, 0, [1, 1]) + frame(1 << 2 | 1, 0, [0, 1]) + b"\x3b"])[0]
    shown = [(f.delay, c[0].tolist()) for f, c in gif_media.composed(gif)]
    red, green, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert shown == [(7, [red, green]), (7, [red, red]), (7, [green, green]), (7, [clear, green])]
    with pytest.raises(ValueError):
        gif_media.decode([b"nothing"])


def test_encoded_streams_equal_a_plain_encoder():
    rng = np.random.default_rng(7)
    streams = [rng.integers(0, top, n).astype(np.uint8) for n in (1, 2, 3, 192, 3072, 3700) for top in (1, 2, 5, 256)]
    coded = gif_media.lzw_encode(streams)
    assert coded == [_lzw(s.tolist(), 8) for s in streams]
    assert all((a == b).all() for a, b in zip(gif_media.lzw_decode(coded, 8, list(map(len, streams))), streams))


def test_full_tables_and_unseen_samples():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, top, 30_000).astype(np.uint8) for top in (3, 256)]  # tables are cleared on the way
    assert all((a == b).all() for a, b in zip(gif_media.lzw_decode(gif_media.lzw_encode(streams), 8, [30_000] * 2), streams))
    for top in (255, 256):  # with samples of 255, nothing is transparent
        samples = rng.integers(0, top, 192 * 40).astype(np.uint8)
        gif = gif_media.decode(gif_media.encode([samples]))[0]
        assert b"".join(c[: f.height, :, 0].tobytes() for f, c in gif_media.composed(gif)) == samples.tobytes()
    text = np.frombuffer(b"the same words again " * 192 * 4, dtype=np.uint8)
    assert len(gif_media.encode([text])[0]) < len(text) / 2
    with pytest.raises(ValueError):
        gif_media.lzw_decode([_lzw([1, 2, 3], 8)], 8, [9])


def test_frame_rows(spark, docs):
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes([255, 255, 255, 0, 0, 0])
    frame = lambda kind, index, px: struct.pack("<BBBBHBB", 0x21, 0xF9, 4, kind, 7, index, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 2, 1, 0) + b"\x02" + gif_media._sub_blocks(_lzw(px, 2))  # noqa: E731, SLF001
    media = head + frame(1 << 2, 0, [0, 1]) + frame(1 << 2 | 1, 1, [1, 0]) + b"\x3b"
    got = gif_media.frame_rows(spark.createDataFrame([(1, media), (2, None)], "doc_id long, media binary")).orderBy("frame").collect()
    assert [(r["doc_id"], r["frame"], r["delay"], r["histogram"][0], r["histogram"][63]) for r in got] == [(1, 0, 7, 1, 1), (1, 1, 7, 0, 2)]
    bare = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0, 0, 0) + frame(1 << 2, 0, [0, 1])
    rows = [(0, media), (1, b""), (2, b"GIF89a"), (3, bare), (4, head + b"?"), (5, media.replace(b"\x02" + gif_media._sub_blocks(_lzw([1, 0], 2)), b"\x0c\x00"))]  # noqa: SLF001
    rows += [(100 + k, media[:k]) for k in range(len(media) - 1)]
    got = gif_media.frame_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    errors = {r["doc_id"]: r["error"] for r in got if r["error"]}
    assert {i: errors.get(i) for i in range(6)} == {0: None, 1: "not a GIF", 2: "the file ends early", 3: "a frame without a palette", 4: "an unknown block", 5: "an unknown code size"}
    assert sum(r["doc_id"] == 0 for r in got) == 2 and all(r["frame"] is None for r in got if r["error"])


FIRST = "The first paragraph of the article tells at length what happened on that day in the town and who was there to see it all."
SECOND = "The second paragraph goes on with the story, naming the people and the places, and ends the matter for all of its readers."
ASIDE = "Twenty four words or more stand here which are not a part of the story at all but still look much like a paragraph of it to machines."


@pytest.mark.parametrize("begin", ["<aside>", "<footer>", "<form>", "<nav>", '<div class="advert">', '<div class="comments">', '<div id="comment-list">', '<div class="newsletter">', '<div class="cookie-notice">', '<div style="display:none">', "<section hidden>", '<div class="sidebar-content">'])
def test_what_is_no_part_of_an_article_goes_from_inside_it(begin):
    tag = begin[1:].split()[0].strip(">")
    page = f"<html><body><article><p>{FIRST}</p>{begin}<p>{ASIDE}</p><div><div><p>{ASIDE}</p></div></div></{tag}><p>{SECOND}</p></article></body></html>"
    assert main_text.main_text(page) == f"{FIRST} {SECOND}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="post-comments-enabled entry-content"><p>{a}</p><p>{b}</p></div>',
        '<body class="no-sidebar comments-open"><form id="aspnetForm"><div><p>{a}</p><p>{b}</p></div><div class="footer"><p>Terms and so on</p></div></form></body>',
        '<form class="search"><article class="has-newsletter"><p>{a}</p><p>{b}</p></article></form>',
        '<div class="social"><div><p>{a}</p><p>{b}</p></div></div><div class="sidebar"><p>Some few words</p></div>',
    ],
)
def test_a_name_or_a_form_round_the_page_keeps_it(page):
    assert main_text.main_text(page.format(a=FIRST, b=SECOND)) == f"{FIRST} {SECOND}"


def test_readers_comments_are_no_text_however_long():
    page = f'<div class="content"><p>{FIRST}</p></div><div class="comments">' + f"<p>{ASIDE}</p>" * 20 + "</div>"
    assert main_text.main_text(page) == FIRST


def test_deep_pages_take_time_by_their_length():
    import time

    for page in ("<div><p>hi there" * 8000, "<div>" * 8000 + "</x>" * 8000 + "<p>hi there", "<p>hi" + "</div>" * 8000):
        began = time.time()
        main_text.main_text(page)
        assert time.time() - began < 5


def test_labels_are_a_minimum_cut_of_the_page():
    """Small mixed pages: no other labelling of the blocks costs less, and blocks that can't be content never are."""
    from itertools import product

    rng = np.random.default_rng(9)
    parts = ["<p>{}</p>", "<div>{}</div>", '<p><a href="/x">{}</a></p>', '<div class="ad">{}</div>', "<aside>{}</aside>", "<h2>{}</h2>"]
    for _ in range(30):
        page = "".join(rng.choice(parts).format("word " * int(rng.integers(1, 25)) + f"n{k}") for k in range(int(rng.integers(2, 8))))
        found = main_text.blocks(page)
        scores = [main_text.score(*b[:3]) for b in found]
        costs = [(min(np.log1p(np.exp(min(s, 30))), 30), 1000 if s == main_text.HARD else np.log1p(np.exp(-s))) for s in scores]  # of leaving out, of keeping
        edges = [(i - 1, i, found[i][3] / max(found[i - 1][0].depth, found[i][0].depth, 1)) for i in range(1, len(found))]
        last = {}
        for i, b in enumerate(found):
            if last.get(b[0].parent, i - 1) != i - 1:
                edges.append((last[b[0].parent], i, 0.5))
            last[b[0].parent] = i
        cost = lambda side: sum(c[1] if kept else c[0] for c, kept in zip(costs, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        got = [kept for _, kept in main_text.labelled(page)]
        assert cost(got) == pytest.approx(min(map(cost, product([True, False], repeat=len(found)))))
        assert not any(kept and s == main_text.HARD for kept, s in zip(got, scores))

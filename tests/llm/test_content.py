import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import audio, entries, html, lattice


def test_resample_equals_convolution():
    x = np.random.default_rng(1).normal(size=997).astype(np.float32)
    for up, down in ((1, 4), (3, 8), (3, 2), (2, 3), (1, 1)):
        taps = audio.filter_taps(up, down)
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        full = np.convolve(spread, taps)[len(taps) // 2 : len(taps) // 2 + len(spread)][::down]
        assert np.abs(full - audio.resample(x, up, down)).max() < 1e-5


def test_segments_have_hysteresis():
    level = np.zeros((60, audio.MELS), np.float32)
    level[20:40] += 2
    level[30] -= 1.2  # between the two limits: the segment goes on
    assert audio.segments(level) == [(20, 40)]
    assert audio.segments(np.zeros((5, audio.MELS), np.float32)) == []


def test_media_round_trip(spark):
    texts = ["héllo", None, "", "x" * 64, "y" * 65, "z" * 70_000, "héllo"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    data = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    rows = {r["doc_id"]: r for r in audio.audio_features(audio.encode_wav(data, "data"), keep=("doc_id", "media")).collect()}
    for i, t in enumerate(texts):
        want = audio.pad((t or "").encode())
        assert bytes(rows[i]["payload"]) == want == audio.from_wav(bytes(rows[i]["media"])) and bytes(rows[i]["media"]) == audio.to_wav(want)
        blocks = audio.tensor_table(bytes(rows[i]["tensors"]))
        assert blocks.schema == audio.TENSORS and blocks.column("values").type.shape == [audio.BLOCK, audio.MELS]
        mel = audio.log_mel(audio.resample((np.frombuffer(want, np.uint8).astype(np.float32) - 128) / 128))
        stored = np.concatenate([c.to_numpy_ndarray() for c in blocks.column("values").chunks]).reshape(-1, audio.MELS)
        assert sum(blocks.column("frames").to_pylist()) == rows[i]["n_frames"] == len(mel) and (stored[: len(mel)] == mel).all() and not stored[len(mel) :].any()
        assert blocks.column("start_s")[0].as_py() == 0 and (np.diff(blocks.column("start_s").to_numpy()) > 0).all()
    assert rows[0]["feature"] == rows[6]["feature"] != rows[3]["feature"]
    assert audio.tensor_table(bytes(rows[5]["tensors"])).num_rows > 1
    assert audio.audio_features(audio.encode_wav(data.limit(0), "data")).count() == 0


def test_media_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = entries.op10_audio_features(spark, str(tmp_path)).where("doc_id = 1").first()
    payload = b"abc" + bytes(61)
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (3, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert row["media_sha256"] == hashlib.sha256(audio.to_wav(payload)).hexdigest() and row["media_bytes"] == 108


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="wrap"><div class="sidebar"><p>Other things, that nobody, reads at all, really.</p></div>
<article><h1>Title &amp;   more</h1><p><b>First, paragraph&nbsp;with <a href="x">a link</a> and
commas, to be long enough.<br>Same block.<p>Second paragraph, unclosed, with &eacute; and &#8212; enough text to score.
<div class="ad-slot">Buy now, cheap, good.</div><ul><li>Point one, of the list.</li><li>Point two.</li></ul>
<form><p>Your mail, please, now.</p></form></article>
<div class="comments"><p>Nice article, thanks, a lot, to everyone here.</p></div></div>
<footer>&copy; me, you, them</footer></body></html>"""


def test_main_text():
    want = ["Title & more", "First, paragraph with a link and commas, to be long enough. Same block.", "Second paragraph, unclosed, with é and — enough text to score.", "Point one, of the list.", "Point two."]
    assert html.main_text(PAGE) == "\n\n".join(want)
    plain = "<body><div><div class='menu'><a href=a>x</a></div><div class=story><p>One, two, three, four and five and six.</p><p>Seven, eight, nine, ten, eleven.</p></div><div class=related><a href=1>a</a></div></div>"
    assert html.main_text(plain) == "One, two, three, four and five and six.\n\nSeven, eight, nine, ten, eleven."
    assert html.main_text("<p>short") == "short" and html.main_text("<script>x</script>") == "" and html.main_text("a < b") == "a < b"


LONG = "A paragraph, of some length, with commas, that is worth keeping as a whole."


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<html><head><title>İstanbul</title></head><body><p>{LONG}</p><p>{LONG} İ</p></body></html>", f"{LONG}\n\n{LONG} İ"),
        (f"<body><STYLE>p{{}}</style>İ<p>{LONG}<Script>x</SCRIPT></p></body>", f"İ\n\n{LONG}"),
        (f"<div class='layout has-sidebar'><p>{LONG}</p><div class='sidebar'><p>Other.</p></div></div>", LONG),
        (f"<div class='post tags-open'><p>{LONG}</p></div>", LONG),
        (f"<nav>menu</nav><div class='widget'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", ""),
        (f"<article><section>{f'<p>{LONG}</p>' * 20}</section><section><p>One short paragraph that stays with the rest of it.</p><h2>End</h2></section></article>", "\n\n".join([LONG] * 20 + ["One short paragraph that stays with the rest of it.", "End"])),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><a href='/x'><p>{LONG}</p></a><a href='/y'><p>{LONG}</p></a></div>", f"{LONG}\n\n{LONG}"),
        (f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<p>{LONG * 400}</p>", LONG * 400),
    ],
)
def test_main_text_of_odd_pages(source, want):
    assert html.main_text(source) == want


def marked_page(rng):
    """A page of random parts, each with words of its own, and the parts that belong to its article."""
    n, kept = [0], []

    def words(count, keep=False):
        n[0] += 1
        text = ", ".join(f"w{n[0]}x{i}" for i in range(count))
        if keep:
            kept.append(text)
        return text

    links = lambda k: "<ul>" + "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(k)) + "</ul>"
    outside = [lambda: f"<nav>{links(5)}</nav>", lambda: f"<footer>{words(6)}</footer>", lambda: f"<div class='sidebar'><p>{words(9)}</p></div>", lambda: f"<div id=cookie-banner>{words(7)}</div>", lambda: f"<form><p>{words(5)}</p></form>", lambda: f"<section class='comments'><p>{words(12)}</p></section>", lambda: f"<script>{words(3)}</script>", lambda: f"<aside>{words(8)}</aside>"]
    inside = [lambda: f"<p>{words(20, True)}</p>", lambda: f"<p>{words(30, True)}", lambda: f"<h2>{words(3, True)}</h2>", lambda: f"<ul><li>{words(4, True)}</li><li>{words(4, True)}</li></ul>", lambda: f"<blockquote>{words(10, True)}</blockquote>", lambda: f"<div class=ad-slot>{words(5)}</div>", lambda: f"<p>{words(15, True)}</p>", lambda: f"<section><p>{words(9, True)}</p></section>"]
    before = [rng.choice(outside)() for _ in range(rng.randint(0, 4))]
    tag = rng.choice(["article", "main", "div class=story"])
    body = [f"<p>{words(40, True)}</p>", *(rng.choice(inside)() for _ in range(rng.randint(1, 12)))]
    after = [rng.choice(outside)() for _ in range(rng.randint(0, 4))]
    return f"<html><body>{''.join(before)}<{tag}>{''.join(body)}</{tag.split()[0]}>{''.join(after)}</body></html>", "\n\n".join(kept)


def test_page_query_equals_marked_pages(spark, tmp_path):
    rng = random.Random(9)
    pages = [marked_page(rng) for _ in range(200)]
    rows = [(i, "u", source) for i, (source, _) in enumerate(pages)] + [(0, "u", pages[0][0]), (500, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in entries.op5_html_main_text(spark, str(tmp_path)).collect())
    want = sorted([*((i, text, len(text)) for i, (_, text) in enumerate(pages)), (0, pages[0][1], len(pages[0][1])), (500, "", 0)])
    assert got == want


def test_extraction_on_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (3, "u", "", "x"), (4, "u", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html.extract_main_text(df).collect()}
    assert rows[1]["text"].startswith("Title & more") and rows[2]["text"] == rows[3]["text"] == "" and rows[4]["text"] == "deep"
    assert html.extract_main_text(df.limit(0)).count() == 0


WORDS = ["▁the", "▁internationalization", "foo", "▁", "日本語テキスト", "\n", "▁naïve—quote", "aaaaaaaaaaaaaaaaaaaaaaaa", "▁don't", "x\ty", "😀"]


def best_score(word):
    pieces, _, fallback, _ = lattice.piece_table(lattice.default_path())
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + fallback * len(word[end - 1].encode())
        for start in range(end):
            if word[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[word[start:end]][1])
    return best[-1]


def test_relational_lattice_equals_the_fold_and_the_best_path(spark):
    pieces, byte0, fallback, texts = lattice.piece_table(lattice.default_path())
    fold = lattice.Folder(lattice.default_path())
    got = {r["word"]: list(r["ids"]) for r in lattice.encode_words(lattice.session_words(spark, WORDS)).collect()}
    assert got.keys() == set(WORDS)
    for w in WORDS:
        assert got[w] == fold(w)
        score = sum(fallback if byte0 <= i < byte0 + 256 else pieces[texts[i]][1] for i in got[w])
        assert score == pytest.approx(best_score(w))


def test_words_folded_side_by_side_take_the_same_paths():
    rng = random.Random(12)
    fold = lattice.Folder(lattice.default_path())
    parts = ["the", "▁", "ing", "tion", "日本", "é", "😀", "x", "qz", "anti", "▁▁", "0", "ö"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(800)] + WORDS + ["a" * 300]
    assert [list(np.frombuffer(x, np.int32)) for x in fold.many(words)] == [fold(w) for w in words]
    for w in words[:100]:
        pieces, byte0, fallback, spelled = lattice.piece_table(lattice.default_path())
        score = sum(fallback if byte0 <= i < byte0 + 256 else pieces[spelled[i]][1] for i in fold(w))
        assert score == pytest.approx(best_score(w))
    assert fold.many([]) == []


def test_encode_decode_round_trip(spark):
    texts = ["Hello  world\nfoo\tbar ", "", None, "naïve 日本語 😀 end", " lead", "z" * 5000, "the cat " * 300, "\n\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r["decoded"] for r in lattice.decode(lattice.encode(df.unionByName(df), dictionary=5)).collect()}
    assert rows == {i: t or "" for i, t in enumerate(texts)}
    assert lattice.encode(df.unionByName(df), dictionary=5).count() == 2 * len(texts)  # repeated rows, each once more
    assert lattice.encode(df.limit(0)).count() == 0
    assert all(r["round_trip"] for r in lattice.encode(df, dictionary=5, checked=True).collect())


def test_main_text_keeps_the_whole_article():
    long = "One sentence of the story, with commas, and enough words to earn its points in the tree. " * 2
    short = "A single closing paragraph of some sixty characters in all"
    page = f"<body><article><h2>Start</h2><section>{f'<p>{long}</p>' * 20}</section><h2>End</h2><section><p>{short}</p></section><ul><li>Last point</li></ul><nav><a href=x>Menu</a></nav></article></body>"
    assert html.main_text(page).split("\n\n") == ["Start", *[long.strip()] * 20, "End", short, "Last point"]
    loose = f"<body><div><h2>Start</h2><div>{f'<p>{long}</p>' * 20}</div><p>no full stop</p><blockquote>Quoted</blockquote><ul><li>Point</li></ul><div><a href=x>linked text</a></div></div></body>"
    assert html.main_text(loose).split("\n\n") == ["Start", *[long.strip()] * 20, "no full stop", "Quoted", "Point"]


def test_encoding_is_the_best_path_of_the_whole_text(spark):
    texts = ["a" + " " * k + "b" for k in (2, 3, 4, 17, 40)] + ["日本語テキスト" * 30, "https://example.org/" + "internationalization" * 9, "  lead\n\n   code", "x" * 47 + "international"]
    pieces, byte0, fallback, spelled = lattice.piece_table(lattice.default_path())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dictionary in (0, 100):
        coded = lattice.encode(df, keep=("doc_id", "text"), dictionary=dictionary)
        for r in coded.collect():
            score = sum(fallback if byte0 <= i < byte0 + 256 else pieces[spelled[i]][1] for i in r["ids"])
            assert score == pytest.approx(best_score("▁" + r["text"].replace(" ", "▁")))
        assert {r["doc_id"]: r["decoded"] for r in lattice.decode(coded.drop("text")).collect()} == dict(enumerate(texts))

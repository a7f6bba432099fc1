import math
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from talewright.llm import embeddings, html, pieces, templates
from talewright.llm.components import connected_components

from .conftest import LONG, sentence

# -- components


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (160, 199), (199, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert set(got.values()) == {7} and len(got) == 61 + 61 + 1
    assert connected_components(df.limit(0)).count() == 0


# -- embeddings


def _brute_links(vectors):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {i: {j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9} for i in good}
    low = {i: i for i, _ in vectors}
    changed = True
    while changed:
        changed = False
        for i in good:
            for j in links[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return {i: (len(links.get(i, ())), low[i], low[i] == i) for i, _ in vectors}


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 60] + rng.normal(size=24) * 0.3).tolist()) for i in range(120)]
    rows += [(400 + i, (base[0] + rng.normal(size=24) * 0.05).tolist()) for i in range(600)]  # a bucket of several blocks
    rows += [(2000, base[3].tolist()), (2001, (base[3] * 2).tolist()), (2002, [0.0] * 24), (2003, None), (2004, [float("nan")] * 24), (2005, [1.0, None]), (2006, []), (2007, [1.0, 2.0]), (2008, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n_links", "'x' AS kept")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = _brute_links(rows)
    links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert all(got[i][0] <= want[i][0] for i in got) and found >= 0.99 * links and len(got) == len(rows)
    assert np.mean([got[i] == want[i] for i in want]) > 0.97
    assert all(got[i] == want[i] for i in range(2000, 2009))


def test_sketches_lose_no_link_and_tables_share_no_bucket():
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for d in (2, 3, 16, 64, 100):
        x = unit(rng.standard_normal((400, d)))
        off = rng.standard_normal((400, d))
        off = unit(off - (off * x).sum(1, keepdims=True) * x)
        y = 0.9 * x + math.sqrt(1 - 0.81) * off  # at the threshold
        assert (x * y).sum(1).min() > 0.9 - 1e-9
        may = embeddings.may_link(embeddings.sketches(np.concatenate([x, y])))
        assert may[np.arange(400), 400 + np.arange(400)].all() and may.diagonal().all()
        if d == 64:
            assert may[:400, :400].sum() < 400 + 0.005 * 400 * 400
    keys = embeddings.codes(unit(rng.standard_normal((2000, 64))), 2).reshape(2000, embeddings.TABLES, -1)
    assert len(np.unique(keys)) == sum(len(np.unique(keys[:, t])) for t in range(embeddings.TABLES))


def test_embeddings_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(None, [1.0, 2.0]), (1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links) for r in embeddings.near_duplicates(bad).collect()) == [("1", 0), ("2", 0), ("None", 0)]
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(twice).collect()} == {(2, 0)}


def test_rotation_keeps_lengths_and_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 16))
    y = embeddings.rotate(x, np.random.default_rng(2))
    assert np.allclose(x @ x.T, y @ y.T)
    h = embeddings.hadamard(np.eye(8)) * np.sqrt(8)
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h.round(9))) == {-1, 1}


# -- HTML

_PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side bar text</aside>
<article><h1>The &amp; title</h1><p>First   paragraph
of the <b>text</b> is rather long &mdash; it goes on for a while.<br>Second line here.<p>Third.<div class="ad">Buy now</div><form><input> Name <button>Go</button></form>
<section id="comments"><p>Nice post</p></section></article><div class="sidebar"><p>Other</p></div><footer>&copy; X</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html.extract(_PAGE) == "The & title\nFirst paragraph of the text is rather long — it goes on for a while.\nSecond line here.\nThird."


def _plain_article(page):
    """The article of a given page by its markup: what stands between the tags that open and close it, cut at its blocks."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br|ul|li|div)[^>]*>", body))
    return "\n".join(b for b in blocks if b)


def test_html_query_against_a_plain_version(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html.op4_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, _plain_article(pages[r.page_id].html), len(r.text))


@pytest.mark.parametrize(
    ("name", "instead"),
    [("threshold", lambda values: -math.inf), ("ratios", lambda length, linked, tags: np.full(len(length), 50.0))],
    ids=["every line over the cut", "constant ratio"],
)
def test_html_ratios_and_clusters_decide(spark, sf_dir, monkeypatch, name, instead):
    """With one part of the method made void, and nothing else changed, most pages come out wrong."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    texts = [html.extract(p) for p in pages]
    monkeypatch.setattr(html, name, instead)
    assert sum(html.extract(p) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)


def test_html_without_hints_finds_prose_among_menus(monkeypatch):
    """Menus of short links, plain divs, no article, and no weights: ratios alone tell the content."""
    monkeypatch.setattr(html, "_weights", lambda page, length: np.ones(len(page.lines)))
    rng = random.Random(11)
    menu = lambda n: f"<ul>{''.join(f'<li><a href=/{i}>{rng.choice(_LINKS)}</a></li>' for i in range(n))}</ul>"
    line = lambda n: "<div>" + " ".join(f"<a href=/{i}>{rng.choice(_LINKS)}</a>" for i in range(n)) + "</div>"
    right = 0
    for _ in range(200):
        body = [" ".join(rng.choice(_LINKS) + rng.choice("aeiou") for _ in range(rng.randint(12, 80))) for _ in range(rng.randint(3, 12))]
        prose = "".join(rng.choice((f"<p>{p}</p>", f"<div>{p}</div>", f"<p>{p[:9]}<b>{p[9:14]}</b>{p[14:]}</p>")) for p in body)
        page = f"<body><div>{menu(rng.randint(4, 20))}{line(rng.randint(3, 9))}</div><div>{prose}</div><div>{menu(rng.randint(4, 20))}{line(5)}</div></body>"
        right += html.extract(page) == "\n".join(body)
    assert right > 0.9 * 200


_LINKS = "home news about contact archive search history letters river market".split()


@pytest.mark.parametrize("broken", ["<a href='", "<!--", "<![CDATA[", "<!DOCTYPE ", "<?", "</a ", '<a b="', "<p ", "&#", "<p><!--", "<a href='>", "<", "<textarea>"])
@pytest.mark.parametrize("end", ["", "> end</p>"])
def test_html_of_broken_markup_takes_linear_time(broken, end):
    began = time.perf_counter()
    text = html.extract("<p>The text before it is kept, whatever comes then.</p>" + broken * 30_000 + end)
    assert time.perf_counter() - began < 5 and text.startswith("The text before it is kept")


def test_html_of_a_page_that_is_hinted_at_as_a_whole():
    assert html.extract(f'<body><div class="dialog">{_MENU}{_PROSE}</div></body>') == "\n".join(_BODY)


_BODY = [f"Paragraph {i} with a good number of words to read in it, so that it is dense." for i in range(6)]
_PROSE = "".join(f"<p>{p}</p>" for p in _BODY)
_MENU = f"<ul>{'<li><a href=q>some link</a></li>' * 9}</ul>"


@pytest.mark.parametrize(
    ("page", "around"),
    [
        (f'<article class="social-post">{_PROSE}</article>', []),
        (f"<form>{_PROSE}</form>", []),
        (f'<div class="content has-sidebar">{_PROSE}</div>', []),
        (f'<div id="page" class="header-fixed">{_PROSE}</div>', []),
        (f"<nav>{_MENU}</nav><form><article>{_PROSE}</article></form><footer>A footer of some words</footer>", []),
        (f'<article><h1>Title</h1><div class="ad">Buy now{_PROSE}</article><footer>foot</footer>', ["Title"]),
        (f"{_MENU}<div>{_PROSE}</div>{_MENU}<div class=site-footer>(c) some company of the world</div>", []),
        (f"<article><a href=x>A teaser card</a></article><div id=main>{_PROSE}</div>", []),
        (f"{_PROSE}<section id=comments><article class=comment-body><p>{'I liked this post very much. ' * 9}</p></article></section>", []),
        (f"<header><h1>Site</h1></header><article><header><h1>The title</h1><p>by me</p></header>{_PROSE}</article>", ["The title"]),
    ],
)
def test_html_finds_the_content(page, around):
    assert html.extract(f"<html><body>{page}</body></html>") == "\n".join([*around, *_BODY])


def test_html_keeps_several_articles_and_short_blocks_inside():
    items = "".join(f"<li>{w}</li>" for w in "one two three four five six".split())
    page = f"<body>{_MENU}<main><article><h2>A</h2>{_PROSE}<ul>{items}</ul>{_PROSE}</article><article><h2>B</h2>{_PROSE}</article></main><aside>Side</aside></body>"
    assert html.extract(page).split("\n") == ["A", *_BODY, "one", "two", "three", "four", "five", "six", *_BODY, "B", *_BODY]


def test_html_without_end_tags_takes_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 40_000, "<div>" * 40_000 + "</b></p>" * 40_000, "<div class=ad>x" * 20_000):
        html.extract(page + "<p>text")
    assert time.perf_counter() - began < 15


def test_html_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<p>" + LONG + "</p>"), (5, "u", "<article><p>a</article></p></b><p>z"), (None, None, "<article>x &#65; &bogus; <!-- c --></article>"), (3, "u", "plain"), (7, "u", "<script>only"), (8, "u", "<<<>>&&")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = html.extract_text(df).collect()
    assert len(got) == 9 and {r.page_id: r.text for r in got}[3] == "plain" and {r.page_id: r.text for r in got}[None] == "x A &bogus;"
    assert {r.page_id: r.text for r in got}[1] == "" and len({r.page_id: r.text for r in got}[4]) == len(LONG.strip())
    assert html.extract_text(df.limit(0)).count() == 0


# -- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.MODEL)


def _all_paths(v, unit):
    """Every segmentation by plain recursion: (score, ids)."""
    if not unit:
        return [(0.0, [])]
    out = []
    for n in range(1, min(len(unit), v.longest) + 1):
        if unit[:n] in v.score:
            i, s = v.score[unit[:n]]
            out += [(s + t, [i, *ids]) for t, ids in _all_paths(v, unit[n:])]
        elif n == 1:
            out += [(v.fallback + t, [*(v.byte[b] for b in unit[0].encode()), *ids]) for t, ids in _all_paths(v, unit[1:])]
    return out


@pytest.mark.parametrize("unit", ["▁the", "▁▁house", "▁été", "▁🙂a", "x", "▁", "▁thetion"])
def test_n_best_matches_all_paths(vocabulary, unit):
    want = sorted((s for s, _ in _all_paths(vocabulary, unit)), reverse=True)
    got = pieces.n_best(vocabulary, unit, 6)
    assert [s for s, _ in got] == pytest.approx(want[:6])
    paths = {(round(s, 6), tuple(ids)) for s, ids in _all_paths(vocabulary, unit)}
    assert all((round(s, 6), tuple(ids)) in paths for s, ids in got) and len({tuple(ids) for _, ids in got}) == len(got)
    score, cost, ids = pieces.solve(vocabulary, [unit])
    assert score[0] == pytest.approx(want[0]) and (round(score[0], 6), tuple(ids[0])) in paths
    assert cost[0] == pytest.approx(want[0] - want[1]) if len(want) > 1 else math.isinf(cost[0])
    assert pieces.n_best_long(vocabulary, unit)[:2] == pytest.approx((score[0], cost[0]))


def test_encoding_round_trip_and_n_best_of_texts(spark, odd_documents, no_documents, vocabulary):
    texts = ["the house", "  two  spaces ", "line\nbreak\r\n\ttab", "▁ mark ▁▁", "日本語 🙂", "", None, "a" * 300, "été the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(df)
    got = {r.doc_id: r for r in coded.collect()}
    back = {r.doc_id: r.decoded for r in pieces.decode(coded).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    for i in (0, 8):
        sums = [(0.0, 0)]
        for u in pieces.units_of(texts[i]):
            sums = [(a + s, n + len(x)) for a, n in sums for s, x in _all_paths(vocabulary, u.replace(" ", "▁"))]
        assert got[i].scores == pytest.approx(sorted((s for s, _ in sums), reverse=True)[: pieces.N_BEST])
    assert got[5].n_tokens == 0 and got[6].scores == [0.0] and all(r.n_tokens == r.lengths[0] for r in got.values())
    odd = pieces.decode(pieces.encode(odd_documents)).collect()
    assert len(odd) == 10 and [r.decoded for r in odd if r.doc_id == 5] == [LONG]
    assert [r.decoded for r in odd if r.doc_id == 7] == ["日本語の文。Ünïcödé 🙂 ▁mark\x00end"]
    assert pieces.encode(no_documents).count() == 0


def test_ids_of_all_segmentations(spark, vocabulary):
    """Against a search over the lattice of the whole text."""
    texts = ["ab the river", "walked", "", None, "stone  light\nx", "harbour keeper quiet"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(docs, all_ids=True, keep=("text",)).collect()
    for r in coded:
        got = [np.frombuffer(x, "<u2").tolist() for x in r.n_best]
        assert got[0] == np.frombuffer(r.ids, "<u2").tolist() and [len(x) for x in got] == r.lengths and len({tuple(x) for x in got}) == len(got)
        assert all(b"".join(vocabulary.bytes[i] for i in x)[1:].decode() == (r.text or "") for x in got)
        if r.text and "\n" not in r.text:
            want = pieces.n_best(vocabulary, pieces._lattice_text(" " + r.text), pieces.N_BEST)
            assert r.scores == pytest.approx([s for s, _ in want]) and sum(vocabulary_score(vocabulary, got[-1])) == pytest.approx(r.scores[-1])


def vocabulary_score(v, ids):
    of = {i: s for i, s in v.score.values()}
    return [of[i] for i in ids]


# -- templates


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_contamination_by_copies_and_new_parameters(spark, rng):
    item = "A train leaves the old station at 40 km per hour and meets Anna Berg after 3 hours; how far did Anna Berg walk from the 40 stones?"
    other = sentence(rng, 30)
    bench = spark.createDataFrame([(1, item), (2, other), (2, other), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    texts = [
        f"{sentence(rng, 40)} {item} {sentence(rng, 40)}",
        item.upper().replace(",", " , "),
        item.replace("40", "65").replace(" 3 ", " 7 ").replace("Anna Berg", "Otto Lang"),  # the same question with other values
        item.replace("at 40 km", "at 65 km").replace("after 3", "after 9").replace("meets Anna Berg", "meets Otto Lang"),  # values that do not agree
        " ".join(other.split()[:8]) + " " + sentence(rng, 60),
        sentence(rng, 300), None, "", "one two three four", other,
        other.replace(other.split()[10], "changed", 1),
    ]
    got = {(r.doc_id, r.item_id) for r in templates.contamination(_docs(spark, texts), bench).collect()}
    assert {(0, 1), (1, 1), (2, 1), (9, 2), (10, 2)} <= got and not {d for d, _ in got} & {3, 4, 5, 6, 7, 8}
    kept = templates.decontaminate(_docs(spark, texts).selectExpr("*", "1 AS hash", "2 AS pos"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8] and kept.columns == ["doc_id", "text", "hash", "pos"]


def test_templates_and_words_of_a_text(spark):
    df = spark.createDataFrame([("He saw Anna Berg, 12.5 kg and 3 cats in\nRome.",), ("",), ("5km x1y  Z",)], "text string")
    rows = df.select(templates.values(templates.F.col("text")).alias("v")).select("v", templates.F.transform("v", templates.template).alias("t"), templates.F.transform("v", templates.word).alias("w")).collect()
    n, d, u = templates.NAME, templates.NUMBER, templates.UNIT
    assert rows[0].t == [n, "saw", n, n, d, u, "and", d, "cats", "in", n]
    assert rows[0].w == ["he", "saw", "anna", "berg", d, u, "and", d, "cats", "in", "rome"]
    assert [v for v in rows[0].v if v >= d] == [f"{d}12.5{templates.END}", f"{u}kg{templates.END}", f"{d}3{templates.END}"]
    numbers = spark.createDataFrame([("Twelve men, twenty-five TWO ones",)], "text string").select(templates.values(templates.F.col("text")).alias("v")).first().v
    assert [x[0] if x >= n else x for x in numbers] == [d, "men", d, d, d, "ones"] and numbers[0] == f"{d}twelve{templates.END}"
    assert rows[1].v == [] and rows[2].w == [d, u, "x", d, "y", "z"]


_APPLES = "Alice has 12 red apples. Bob has 7 green pears. Alice gives away 3 apples. Bob buys 5 more pears. Who has more fruit now?"


@pytest.mark.parametrize(
    ("item", "text", "caught"),
    [
        (_APPLES, _APPLES.replace("Alice", "Carol").replace("Bob", "David").replace("12", "40").replace("7", "9"), True),
        (_APPLES, _APPLES.lower(), True),
        (_APPLES, _APPLES.replace(". ", ".\n"), True),
        (_APPLES, _APPLES.replace("Alice", "Carol").replace("Bob", "Carol").replace("12", "40"), False),  # two names became one
        ("What is 3 4 5 6 7 8 9 10?", "Rain in mm: 31 18 4 0 12 7 55 20 3 41 9 10 2 17 8 6 1 30", False),
        ("What is 3 4 5 6 7 8 9 10?", "so what is 31 18 4 0 12 7 55 20 then", True),
        ("A farmer owns twelve sheep and sells five of them at the market", "A farmer owns twenty sheep and sells six of them at the market", True),
        ("A farmer owns twelve sheep and sells five of them at the market", "a farmer owns 20 sheep and sells 6 of them at the market", True),
        ("Twelve sheep and twelve goats eat the grass of two fields", "Ninety sheep and forty goats eat the grass of two fields", False),  # one number became two
        ("Who wrote Hamlet?", "who wrote hamlet", True),
        ("Who wrote Hamlet?", "Who wrote Faust?", False),
        ("What is 2+2?", "so what is 7 + 7 then", True),
        ("What is 2+2?", "so what is 7 + 8 then", False),
        ("capital of Peru", "the capital of Chad is old", True),
        ("red apples", "some red apples fall", True),
        ("red apples", "some red fallen apples", False),
        ("apples", "some red apples fall", False),  # a single word says nothing
        ("Anna Berg und Otto Lang kaufen 3 Karten im Park am See", "Emma Kurz und Karl Roth kaufen 8 Karten im Park am See", True),
    ],
)
def test_contamination_of_questions(spark, item, text, caught):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert templates.contamination(_docs(spark, [text, f"before it {text} and after it"]), bench).count() == 2 * caught


def test_contamination_of_rows_that_share_an_id(spark, rng):
    item = sentence(rng, 20)
    docs = spark.createDataFrame([(1, item), (1, "other words of no item at all here"), (None, item), (2, "nothing to be found in this text")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in templates.contamination(docs, bench).collect()] == [(1, 5, 1.0)]
    assert sorted(map(str, (r.doc_id for r in templates.decontaminate(docs, bench).collect()))) == ["2", "None"]


def test_contamination_of_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "lorem lorem lorem lorem lorem lorem")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in templates.contamination(odd_documents, bench).collect()] == [(5, 1)]
    assert templates.contamination(no_documents, bench).count() == 0
    assert templates.contamination(odd_documents, bench.limit(0)).count() == 0
    assert templates.decontaminate(odd_documents, bench).count() == 9

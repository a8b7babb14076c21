"""Main text, alignment of tokenisers and whitening: odd inputs, and against plain versions."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rivulet.llm import alignment, html_blocks, html_main, whitening

JSON_FILE, PIECE_FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


# ---------------------------------------------------------------- main text
def blocks(page):
    return [b.text for b in html_blocks.text_blocks(page)]


def test_blocks_follow_the_markup():
    assert blocks(None) == blocks("") == blocks("  <p> </p>") == []
    assert blocks("a<b>b</b>c<br>d<p>e  \n f&nbsp;g") == ["abc d", "e f g"]
    assert blocks("<script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes</p>") == ["yes"]
    assert blocks("<p>1 < 2 &amp; 3 &lt; 4 &#8364; &am</p>") == ["1 < 2 & 3 < 4 € &am"]
    assert blocks("<p>open<p>again<!-- never closed <p>lost") == ["open", "again"]
    assert blocks("<p>cut off <a href=") == ["cut off"]
    assert blocks("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<div hidden>x</div><div style='display: none'>y</div><svg><path d=''/><text>t</text></svg>z") == ["z"]


def test_blocks_know_their_links_and_surroundings():
    nav, head, text, note = html_blocks.text_blocks("<nav><a href=x>one two</a> three</nav><article><h1>Head</h1><p>Text <a>link</a></p><aside>Note</aside></article>")
    assert (nav.words, nav.linked, nav.noise, nav.main) == (3, 2, True, False)
    assert head.heading and head.main and not head.noise
    assert (text.words, text.linked, text.noise) == (2, 1, False)
    assert note.noise and note.main
    assert not html_blocks.text_blocks("<form><main><p>in a page-wide form</main></form>")[0].noise
    assert html_blocks.text_blocks("<form><p>Your name</form>")[0].noise
    assert html_blocks.text_blocks("<div class='postComments'><p>x</div>")[0].noise
    assert not html_blocks.text_blocks("<div class='content with-sidebar'><p>x</div>")[0].noise


def test_the_scan_takes_time_in_proportion_to_the_page():
    for part in ("<!--", "<a href=\"", "<p><b>", "<", "</", "<div class='x'>", "&amp", "<script>"):
        html_blocks.text_blocks(part * 50_000)


def test_tree_separates_the_labelled_table_and_pages_left_out():
    tree = html_main.default_tree()
    x, y = html_main.labelled_table(html_main.PAGES)
    assert all(html_main.judge(tree, row) == bool(label) for row, label in zip(x, y))
    right = 0
    for k, page in enumerate(html_main.PAGES):
        other = html_main.grow(*html_main.labelled_table([p for i, p in enumerate(html_main.PAGES) if i != k]))
        right += sum(html_main.judge(other, row) == bool(label) for row, label in zip(*html_main.labelled_table([page])))
    assert right / len(y) >= 0.85


def test_tree_takes_the_best_split():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [3.0, 9.0], [4.0, 9.0]])
    assert html_main.grow(x, np.array([0, 0, 1, 1])) == (0, 2.5, (0.0,), (1.0,))
    assert html_main.grow(x, np.array([1, 1, 1, 1])) == (1.0,)
    assert html_main.grow(np.zeros((3, 2)), np.array([0, 0, 1]))[0] == pytest.approx(1 / 3)


def test_main_text_leaves_out_what_surrounds_the_article():
    page = """<body><header><a href=/>Site</a></header><div class="cookie-banner">We use cookies and like to tell you so in a very long sentence that nobody ever reads to its end, as you know.</div>
    <article><h1>Title</h1><p>First.</p><p>The second paragraph has a few more words in it.</p><div class="advert">Buy now</div></article>
    <section class="comments"><p>A reader says a great many things about this article and about the world as such, at length, in one sentence.</p></section><form>Search</form></body>"""
    assert html_main.main_text(page, html_main.default_tree()) == "Title First. The second paragraph has a few more words in it."


def test_extract_defines_odd_pages(spark):
    rows = [(1, None, "x", 5), (1, "", "x", 5), (2, "<article><p>A&amp;B</article>", None, 7), (2, "<article><p>A&amp;B</article>", None, 7), (None, "plain " * 60, "y", 1), (9, "<p>" + "word " * 300_000, "z", 2)]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string, n_chars int")
    out = html_main.extract(pages)
    assert [c.lower() for c in out.columns] == ["page_id", "html", "text", "n_chars"]
    got = sorted(out.select("page_id", "text", "n_chars").collect(), key=lambda r: (r[0] or 0, r[2]))
    assert [(r[0], r[2]) for r in got] == [(None, 359), (1, 0), (1, 0), (2, 3), (2, 3), (9, 1_499_999)]
    assert got[3][1] == "A&B"
    assert html_main.extract(pages.where("false")).count() == 0


def test_extract_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_main.extract(pages).collect():
        inside = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]))
        assert r["text"] == " ".join(html.unescape(inside).split())
        assert r["n_chars"] == len(r["text"])


# ---------------------------------------------------------------- alignment
def plain_alignment(texts):
    """Groups, links and counts token by token, with the two libraries themselves."""
    a_model, b_model = Tokenizer.from_file(JSON_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    documents = []
    for t in texts:
        groups = []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False), b_model.encode(t)
            bytes_a = [bytes(byte[c] for c in x) for x in a.tokens]
            bytes_b = [bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, b_model.id_to_piece(b))]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                start = 0
                for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
                    groups.append(([i for i, e in zip(a.ids, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end]))
                    start = end
        documents.append(groups)
    counts = Counter(p for groups in documents for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for groups in documents:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


ODD = [None, "", " ", "  two  spaces ", "word", "a▁b", "a\x00b", "ﬁ ① ß 日本語 🙂🙂", "<s> </s> <|endoftext|> <unk>", "a" * 3_000, "\n\n\t tabs\r\n", "same", "same", " wide", "x" + "\u0301" * 20]


@pytest.mark.parametrize("frequent", [0, 5, 100, alignment.FREQUENT])
def test_alignment_equals_the_plain_version_however_counts_travel(spark, frequent):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["the", " ", "er", "Über", "12", "!", "\n", "日", "'s", "  "]) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs int").repartition(3)
    got = alignment.align(docs, JSON_FILE, PATTERN, PIECE_FILE, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((None if i == 3 else i // 2, *row) for i, row in enumerate(plain_alignment(texts)))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_alignment_of_long_and_no_texts(spark):
    words, run = "lorem ipsum dolor " * 20_000, "a" * 20_000
    docs = spark.createDataFrame([(1, words), (2, run)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align(docs, JSON_FILE, PATTERN, PIECE_FILE).collect()}
    once = plain_alignment(["lorem ipsum dolor " * 20])[0]
    twice = plain_alignment(["lorem ipsum dolor " * 40])[0]
    for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):  # linear in the repeats
        assert got[1][name] == once[k] + (twice[k] - once[k]) * 999
    assert got[2]["n_a"] * got[2]["n_b"] >= got[2]["n_links"] >= max(got[2]["n_a"], got[2]["n_b"]) > 0
    assert alignment.align(docs.where("false"), JSON_FILE, PATTERN, PIECE_FILE).count() == 0


# ---------------------------------------------------------------- whitening
def test_inertia_counts_negative_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20):
        a = rng.standard_normal((n, n))
        a = a + a.T
        assert whitening.negative_pivots(a) == int((np.linalg.eigvalsh(a) < 0).sum())
    assert whitening.negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.negative_pivots(np.zeros((3, 3))) == 0


def test_components_equal_those_of_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in (np.arange(40.0), np.logspace(-8, 4, 40), np.r_[np.full(10, 5.0), np.full(20, 1.0), np.zeros(10)], np.ones(40), np.r_[1e6, np.ones(39) + np.arange(39) * 1e-3]):
        v = turn @ np.diag(spectrum) @ turn.T
        v = (v + v.T) / 2
        values, axes = whitening.leading_components(spark, v, 32)
        assert np.allclose(values, np.sort(spectrum)[::-1][:32], rtol=0, atol=1e-12 * spectrum.sum())
        assert np.abs(axes.T @ axes - np.eye(32)).max() < 1e-12
        assert np.abs(v @ axes - axes * values).max() < 1e-11 * spectrum.sum()


def test_whitening_equals_a_dense_solver(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    want = c @ axes[:, ::-1][:, :32] / np.sqrt(e[::-1][:32])
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).toPandas()
    assert len(got) == 32 * n and (got["n"] == n).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-9
    assert (got.groupby("vec_id")["deviation"].first().loc[[r[0] for r in rows]].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()
    assert np.allclose(got.groupby("component")["explained"].first(), e[::-1][:32] / np.trace(v), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_defines_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, x string, component int"
    odd = [(1, None, "a", 1), (2, [], "a", 1), (3, [1.0, None], "a", 1), (4, [float("nan"), 1.0], "a", 1), (5, [float("inf"), 1.0], "a", 1), (6, [1.0, 2.0, 3.0], "a", 1)]
    good = [(None, [0.0, 0.0], "a", 1), (7, [1.0, 1.0], "a", 1), (7, [1.0, 1.0], "a", 1), (8, [2.0, 2.0], "b", 2)]
    got = whitening.whiten(spark.createDataFrame(odd + good, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["n"] == 4 for r in got)
    assert {round(r["explained"], 12) for r in got} == {1.0, 0.0}
    assert whitening.whiten(spark.createDataFrame(odd[:5], schema)).count() == 0
    equal = whitening.whiten(spark.createDataFrame([(1, [3.0, 4.0], "a", 1)] * 3, schema)).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in equal} == {(None, 0.0, None, 0)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0], "a", 1), (2, [-1e300, 2.0], "a", 1), (3, [1e300, -7.0], "a", 1)], schema)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)

import random

import pytest

from logwarden.llm.html_extract import Weights, best_region, extract_pages, fit_weights, label_counts, main_text

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def weights(spark):
    return fit_weights(spark.read.parquet(f"{SF}/pages.parquet"))


def test_best_region_matches_brute_force():
    draw = random.Random(7)
    for _ in range(300):
        scores = [draw.choice([-3, -1, -0.5, 1, 2, 4]) for _ in range(draw.randrange(12))]
        first, last = best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[first:last]) == max([0, *sums])


def test_labels_count_words_and_tags_by_context():
    page = "<body><nav><a href='/'>Home page</a></nav><article><p>one two three</article>"
    counts = label_counts(page)
    assert counts[("word", "nav", "nav", False)] == 2 and counts[("word", "?", "p", True)] == 3
    assert counts[("tag", "nav", "a", False)] == 2 and counts[("tag", "?", "p", True)] == 1
    assert not label_counts("<p>no article</p>") and not label_counts("<article>a</article><article>b</article>")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
CASES = [
    ("<article><p>one &amp; two&nbsp;three<p>four</article>", "one & two three\nfour"),
    ("<article><h1>T</h1><p>a<br>b <b>c</b>d</p></article><footer><p>x y z</footer>", "T\na b cd"),
    ("<article><header><h1>Head</h1></header><p>text here</p><footer>written by</footer></article>", "Head\ntext here"),
    (f"<article><p>{WORDS}</p><aside>side bar</aside><p>{WORDS}</p></article>", f"{WORDS}\n{WORDS}"),
    (f"<article><p>{WORDS}</p><div class='ad'>buy now</div><p>{WORDS}</p></article>", f"{WORDS}\n{WORDS}"),
    (f"<article><p>{WORDS}</p><p class=notice>we use cookies<p>{WORDS}</article>", f"{WORDS}\n{WORDS}"),
    (f"<article><p>{WORDS}</p><form>name <button>send</button></form></article>", WORDS),
    (f"<article><p>{WORDS}</article><section id='comments'><article><p>{WORDS} {WORDS}</article></section>", WORDS),
    (f"<body class='has-sidebar'><nav>menu of the page</nav><div id=content><p>{WORDS}</p><ul><li>x<li>y</ul></div><footer>f</footer>",
     f"{WORDS}\nx\ny"),
    (f"<main><h2>No article</h2><p>{WORDS}</p></main>", f"No article\n{WORDS}"),
    ("<article><script>if (a < b) { '</p>' }</script><p>kept<!-- <p>gone --> too</article>", "kept too"),
    ("<article><p>a < b and 3 > 2 &am</article>", "a < b and 3 > 2 &am"),
    ("<article><p>open <b>ends <p>here", "open ends\nhere"),
    ("<article><p>before</p><script>never closed <p>x</p>", "before"),
    ("<nav><a href=/>Home</a></nav><footer>only this</footer>", ""),
    ("", ""), (None, ""), ("<", "<"), ("<!--", ""), ("&lt;p&gt;", "<p>"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_text_of_a_page(weights, html, text):
    assert main_text(html, weights) == text


def test_long_pages_and_deep_nests_take_linear_time(weights):
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>", weights).count("word") == 50_000
    deep = "<article>" + "<div>" * 50_000 + " ".join(["word"] * 500_000) + "</nav>" * 50_000
    assert main_text(deep, weights).count("word") == 500_000
    for broken in ("<a" * 100_000, "<a '" * 100_000, "<!--" * 100_000, "</" * 100_000, '<a "' * 99_999):
        main_text(broken, weights)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = extract_pages(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == pages.count()


def test_without_labels_empty_repeats_and_clashing_columns(spark):
    assert extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "u", f"<p>{WORDS}</p>", "x"), (1, "u", f"<p>{WORDS}</p>", "y"), (None, None, None, None)]
    found = extract_pages(spark.createDataFrame(rows, SCHEMA + ", text string"))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "u", WORDS, len(WORDS))] * 2 + [(None, None, "", 0)]


def test_weights_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one, many = fit_weights(pages.repartition(1)), fit_weights(pages.repartition(7))
    assert one == many and one.every
    assert Weights().share("word", "?", "p", False) == 0.5

import html as entities
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from tabgauge.llm import extraction
from tabgauge.llm.html_dom import FEATURES, Forest, Page, log_chances
from tabgauge.llm.html_layouts import Layouts


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def trees(spark, pages):
    return extraction.fitted(spark, pages)


def article(html):
    """The article of the given pages by its marks, without any tree."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = (
        " ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())
        for b in re.split(r"</?(?:p|h1)>", inner)
    )
    return "\n\n".join(b for b in blocks if b)


def test_pages_against_their_marks(spark, pages, trees):
    rows = pages.collect()
    found = extraction.main_texts([r.html for r in rows], trees)
    same = sum(f == article(r.html) for f, r in zip(found, rows))
    assert same >= 0.97 * len(rows)


COMMENTS = (
    '<section class="comments"><h3>Three replies</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>',
    '<div id="comments"><ul><li class="comment"><b>Ann</b><p>{}</p></li><li class="comment"><p>{}</p></li></ul></div>',
    '<section id="discussion"><article class="comment"><p>{}</p></article><article class="reply"><p>{}</p></article></section>',
)


@pytest.mark.parametrize("spot", ["in the article", "after it"])
def test_titles_in_headers_and_comments(pages, trees, spot):
    """The article's header belongs to it, readers' comments do not, wherever they stand."""
    rows = [r.html for r in pages.collect() if "<h1>" in r.html]
    layouts, right = Layouts(99), 0
    changed = []
    for k, html in enumerate(rows):
        comments = COMMENTS[k % len(COMMENTS)].format(layouts.prose(2, 6), layouts.prose(1, 4))
        html = html.replace("<h1>", "<header><h1>", 1).replace("</h1>", "</h1></header>", 1)
        closing = "</article>" if spot == "in the article" else "<footer>"
        changed.append(html.replace(closing, comments + closing, 1))
    for found, html in zip(extraction.main_texts(changed, trees), rows):
        right += found == article(html)
    assert right >= 0.95 * len(rows)


def test_labels_leave_unsure_parts_out(trees):
    page = Page(
        "<nav>n</nav><article><header><h1>t</h1></header><p>a</p><div class=comments><p>c</p><article>d</article></div>"
        "<aside>s</aside></article><section id=comments><article>e</article></section><footer>f</footer>"
    )
    kept, sure = extraction._marked(page)
    by_text = {t: (kept[k], sure[k]) for k, t in enumerate(page.texts) if t is not None}
    assert [t for t, (k, _) in by_text.items() if k] == ["t", "a"]
    assert [t for t, (_, s) in by_text.items() if not s] == ["c", "d"]
    assert extraction._marked(Page("<p>x</p>")) is None


def test_unseen_layouts(trees):
    layouts = Layouts(12345)
    right = wrong = lost = 0
    for html, main in (layouts.page() for _ in range(150)):
        found = Counter(b for b in extraction.main_texts([html], trees)[0].split("\n\n") if b)
        both = sum((found & Counter(main)).values())
        right, wrong, lost = right + both, wrong + sum(found.values()) - both, lost + len(main) - both
    assert right / (right + wrong) > 0.96 and right / (right + lost) > 0.96


def test_blocks():
    html = (
        "<body><p>One &amp; <b>two<br>three<p>four\n\t five&nbsp;</p><ul><li>a<li>b <i>c</i></ul>"
        "<script>var x='<p>no</p>'</script><div>x<div>y</div>z &lt;&#233;&eacute;</div><select><option>o</select>"
        "<table><tr><td>1<td>2<tr><td>3</table><p>tail"
    )
    texts = [t for t in Page(html).texts if t is not None]
    assert texts == ["One & two three", "four five", "a", "b c", "x", "y", "z <éé", "1", "2", "3", "tail"]


def test_hidden_elements_end_where_html_ends_them():
    def texts(html):
        return [t for t in Page(html).texts if t is not None]

    body = "<p>one</p><div>two</div>"
    for start in (
        "<html><head><title>t</title><meta name=a><body>", "<head><title>t</title><script>x</script>", "<head><noscript><link><body>",
        "<head><style>x</style>\n<body class=a>", "<head>\n</head><body>", "<body><svg><g><path d=1>", "<body><svg/>", "<math><mrow>",
        "<svg><svg><circle>",
    ):
        assert texts(start + body) == ["one", "two"], start
    assert texts("<head><title>t</title>plain <b>words</b>") == ["plain words"]
    assert texts("<head><title>t</title><a href=x>link</a> text") == ["link text"]
    hidden = "<head><title>t</title><noscript><p>no</p></noscript></head><svg><desc><p>no</p></desc><text>no</text></svg>"
    assert texts(hidden + body) == ["one", "two"]
    assert texts("<template><head><body><p>no</p></template>" + body) == ["one", "two"]


def test_page_without_end_of_head(trees):
    html, main = Layouts(77).page()
    open_head = "<html><head><title>t</title>" + html[html.index("<body") :] if "<body" in html else "<head><title>t</title>" + html
    assert extraction.main_texts([open_head], trees)[0]


def test_decoding_is_the_best_choice():
    rng = np.random.default_rng(1)
    forest = Forest([Page("<div>a<p>b</p><ul><li>c<li>d</ul></div>"), Page("<p>x</p>")])
    parents = forest.parents
    for _ in range(40):
        yes, no = log_chances(rng.normal(size=len(parents)))
        chosen = forest.decoded(yes, no)
        best = max(
            (c for c in itertools.product([False, True], repeat=len(parents)) if all(c[parents[k]] or not c[k] for k in range(len(parents)))),
            key=lambda c: sum(y if on else n for y, n, on in zip(yes, no, c)),
        )
        assert chosen.tolist() == list(best)


def test_features_of_a_page_do_not_depend_on_its_neighbours():
    layouts = Layouts(3)
    pages = [Page(layouts.page()[0]) for _ in range(5)]
    together = Forest(pages)
    features = together.features()
    assert features.shape[1] == len(FEATURES)
    for page, (a, b) in zip(pages, together.bounds):
        assert np.allclose(Forest([page]).features(), features[a:b])


def test_edges(spark, trees):
    deep = "<div>" * 3000 + "<p>" + "Deep words here. " * 30 + "</p>"
    htmls = [None, "", " ", "plain words only", "<", "<p", "</p></b>", "<!-- x", deep, "<p>&#0;&bogus;</p>", "x" * 500_000]
    assert extraction.main_texts(htmls, trees)[:3] == ["", "", ""]
    rows = [(i, f"u{i}", h, 1, "t", "l") for i, h in enumerate(htmls)] + [(None, None, None, 1, "t", "l")] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string, label string")
    found = extraction.extract(table).collect()
    assert sorted((r.page_id, r.url) for r in found if r.url) == sorted((i, f"u{i}") for i in range(len(htmls)))
    assert len(found) == len(rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert extraction.extract(table.limit(0)).collect() == []


def test_tasks_of_the_fit_do_not_carry_the_rows_to_learn_from(spark, pages, monkeypatch):
    class Seen(Exception):
        pass

    def fit(self, table):
        raise Seen(table)

    monkeypatch.setattr(extraction, "LAYOUTS", 5)
    monkeypatch.setattr(extraction.GBTClassifier, "fit", fit)
    with pytest.raises(Seen) as seen:
        extraction.fitted(spark, pages)
    table = seen.value.args[0]
    plan = table._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "LocalRelation" not in plan
    assert table.rdd.getNumPartitions() == 1
    before = extraction._learned_from(spark, pages).collect()
    assert [(r.features.toArray().tolist(), r.label) for r in table.collect()] == [tuple(r[:2]) for r in before]

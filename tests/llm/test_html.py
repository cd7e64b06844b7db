import html as std
import re

import pytest
from pyspark.sql import functions as F

from labelproof.llm import html

PAGE = """<html><head><title>t</title></head><body><header><a href=/>Site</a> Top</header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a>x</a><li><a>y</a></ul></nav><main><div class="sidebar"><p>Related things, lots of them to read here today.</p></div>
<article><h1>Title of it</h1><p>The first   paragraph has some words, and goes on for a while.</p><aside class=ad>Buy now</aside>
<p>Second &amp; last paragraph, with <a href=x>a link</a><br>in it.</p><form><label>Mail</label><input></form></article>
<section id="comments"><p>Great article, thanks!</p></section></main><script>var a = "<p>no</p>";</script><footer>c</footer></body></html>"""
TEXT = "Title of it\nThe first paragraph has some words, and goes on for a while.\nSecond & last paragraph, with a link in it."


@pytest.fixture(scope="module")
def fitted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return pages, html.fit(pages)


def test_articles_of_the_table(fitted):
    pages, model = fitted
    rows = html.extracted(pages.withColumn("source", F.col("html")).withColumn("text", F.lit("clash")), model).collect()
    assert len(rows) == pages.count()
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row["source"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n".join(b for b in blocks if b)


def test_marks_and_no_marks(fitted):
    _, model = fitted
    for source in (PAGE, PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>")):
        page = html.parse(source)
        assert html.main_text(page, model(html.features(page))) == TEXT


def test_odd_pages(spark, fitted):
    _, model = fitted
    texts = [None, "", "<p>", "<<<>>>", "</p></div>", "<a href='x", "<script>never closed", "<!-- open", "x" * 200_000, "<div>" * 3000 + "deep" + "</div>"]
    rows = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)] * 2, "page_id long, url string, html string")
    got = html.extracted(rows, model).collect()
    assert len(got) == 2 * len(texts) and all(r["text"] is not None for r in got) and {r["text"] for r in got if r["page_id"] in (0, 1, 2, 6)} == {""}
    assert html.extracted(rows.limit(0), model).count() == 0 and html.fit(rows.limit(0)).trees == []


def test_decoding_is_the_best_consistent_choice():
    import itertools

    import numpy as np

    page = html.parse("<body><div><p>a</p><p>b</p></div><section><p>c</p></section></body>")
    n, rng = len(page.tag), np.random.default_rng(3)
    for _ in range(200):
        p = np.clip(rng.random(n), 1e-3, 1 - 1e-3)
        best = (-1e9, None)
        for states in itertools.product((0, 1, 2), repeat=n):
            if states[0] != 2 or any(states[page.parent[i]] != 2 and states[i] != states[page.parent[i]] for i in range(1, n)):
                continue
            own = {node for node, _, _ in page.runs}
            score = sum(
                np.log(p[i]) if s == 0 else np.log1p(-p[i]) if s == 1 else -html.MIXED + (max(np.log(p[i]), np.log1p(-p[i])) if i in own else 0)
                for i, s in enumerate(states)
            )
            kept = [states[i] == 0 or states[i] == 2 and p[i] >= 0.5 for i, _, _ in page.runs]
            best = max(best, (score, kept), key=lambda b: b[0])
        assert html.decode(page, p) == best[1]


def test_trees_equal_the_library(spark, fitted):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((200, 6))
    rows = spark.createDataFrame([(r.tolist(), float(r[0] + r[3] > 1)) for r in x], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=5, maxDepth=html.DEPTH, seed=1).fit(rows)
    mine = html.Trees([html._flat(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))(x)
    theirs = [r[0][1] for r in model.transform(rows).select(vector_to_array("probability")).collect()]
    assert np.allclose(mine, theirs)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>one <svg/> two</p><p>three</p></article>", "one two\nthree"),
        ("<article><p>one <svg><title>no</title></svg> two</p></article>", "one two"),
        ("<article><p>a</p><object><p>b</p><p>c</p></article>", "a\nb\nc"),
        ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
        ("<article><p>a</p><svg><p>b</p><select><p>c</p></article>", "a\nb\nc"),
        ("<article><p>a</p><script>b", "a"),
    ],
)
def test_no_text_is_lost_behind_embedded_tags(source, text):
    page = html.parse(source)
    assert "\n".join(t for _, t, _ in page.runs) == text


def test_many_unclosed_tags_take_linear_time():
    assert len(html.parse("<svg>" * 100_000 + "<p>end</p>").runs) == 1

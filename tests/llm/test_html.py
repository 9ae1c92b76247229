"""The tag scanner, and the labeller on containers that it hasn't seen."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizforge.llm import html_blocks

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p title="a>Hello', ["Hello"]), ('<a href="x"y">link</a> end', ["link end"]), ("<p>a < b <3 & c</p>", ["a < b <3 & c"]), ("<p title='it is > x' id=\"k\">z</p>", ["z"]),
        ("<p title=\"it's > x\">z", ["z"]), ("<p title='\"' alt=\">\">q</p>", ["q"]), ("a<!-- x > -->b<!-- never", ["ab"]), ("<SCRIPT>var a='<p>x</p>'</Script>y", ["y"]), ("<script>never ends <p>x", []),
        ("<p>one<p>two<ul><li>three<li>four</ul>five", ["one", "two", "three", "four", "five"]), ("x</div></p></b>y", ["xy"]), ("<!doctype html><?xml a?>t", ["t"]), ("<p>open <b", ["open <b"]), ("", []),
        ("<select><option>no</select><p>&lt;yes&gt;&nbsp;&amp; \n so", ["<yes> & so"]),
    ],
)
def test_broken_markup(page, texts):
    assert [t for _, t, _ in html_blocks.blocks(page)] == texts


def test_scanner_is_linear():
    took = {}
    for n in (10_000, 40_000):
        began = time.process_time()
        for page in ("<a href=\"x" + "<div>" * n, "<p title='" * n, "<a" * n, "<div>" * n + "</p>" * n, "<div a='\"' b=c>" * n, "<script>" * n, "<!--" * n):
            html_blocks.blocks(page)
        took[n] = time.process_time() - began
    assert took[40_000] < 10 * took[10_000] + 1


def test_shares_against_plain_sums():
    page = html_blocks.blocks("<body><div><p>aaaa</p><p>bb</p></div><section><div><p>cc</p></div></section>tail</body>")
    out = html_blocks.vectors(page)[:, html_blocks.INPUT - html_blocks.SHARES :]
    assert np.allclose(out[:, 0], [6 / 12, 6 / 12, 2 / 12, 1]) and np.allclose(out[:, 1], [1, 1, 2 / 12, 1])
    assert out[:, 2].tolist() == [1, 1, 0, 0] and out[1, 3] == 1 and out[2, 3] == 0


def test_labels_of_pages_without_a_telling_container():
    told = html_blocks.blocks("<nav>Home</nav><article><p>x</p></article><div><p>y</p></div>")
    untold = html_blocks.blocks("<nav>Home</nav><div class=zz><p>x</p></div>")
    assert html_blocks.page_labels(told).tolist() == [0, 1, 0] and html_blocks.page_labels(untold).tolist() == [0, -1]


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    model = html_blocks.BlockLstm()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = html_blocks.padded([rng.random((n, html_blocks.INPUT), np.float32) for n in (5, 3)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    grads = model._gradients(x, mask, y)

    def loss():
        z = model.logits(x, mask)[0]
        return float((np.logaddexp(0, z) - y * z)[mask].sum() / mask.sum())

    for name, at in (("f", (2, 5)), ("f", (html_blocks.INPUT + 1, 25)), ("b", (7, 61)), ("bb", (3,)), ("o", (1,)), ("ob", (0,))):
        kept = model.w[name][at]
        sides = []
        for step in (1e-3, -1e-3):
            model.w[name][at] = kept + step
            sides.append(loss())
        model.w[name][at] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[name][at]) < 2e-3


def test_containers_with_unseen_names(spark):
    pages = spark.read.parquet(PAGES)
    renamed = F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="text-body">')), F.lit("</article>"), F.lit("</div>"))
    box = F.concat(F.lit('</article><div class="discussion">'), *[F.concat(F.lit("<div><p>I read this and thought "), F.substring("url", 1, 40), F.lit(f" of {w} for long.</p></div>")) for w in ("rivers", "old roads", "winter")], F.lit("</div>"))
    said = F.replace("html", F.lit("</article>"), box)
    every = pages.unionByName(pages.withColumns({"page_id": F.col("page_id") + 10_000, "html": renamed})).unionByName(pages.withColumns({"page_id": F.col("page_id") + 20_000, "html": said}))
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
    right = {0: [], 1: [], 2: []}
    for r in html_blocks.extract(every).collect():
        right[r.page_id // 10_000].append(r.text == want[r.page_id % 10_000])
    assert np.mean(right[0]) >= 0.98 and np.mean(right[1]) >= 0.9 and np.mean(right[2]) >= 0.9

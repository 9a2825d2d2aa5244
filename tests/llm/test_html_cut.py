"""The cut decides: weights from the sample, flow reached, and text F1 with the
cut against that of the block classifier alone."""

import random
import re

import numpy as np
import pytest

from jobsift.llm import html_mincut as M

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(500).collect()]


@pytest.fixture(scope="module")
def weights(spark):
    return M.train(spark.read.parquet(f"{SF}/pages.parquet"))


def tagless(page):
    """Without semantic tags and class, id and role."""
    page = re.sub(r"</?(article|nav|footer|aside|header|main)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
    return re.sub(r'\s(class|id|role)="[^"]*"', "", page)


def noisy(page, rng):
    """Blocks whose text misleads: short and linked ones in the article,
    sentences among the menu's entries."""
    def article(m):
        out = []
        for piece in re.split(r"(?=<p>)", m[0]):
            out.append(piece)
            if rng.random() < 0.25:
                out.append(rng.choice(["<p>Fig 2</p>", '<p><a href="/x">See more</a></p>', "<p>12</p>"]))
        return "".join(out)
    page = re.sub(r"<article>.*</article>", article, page, flags=re.S)
    return re.sub(r"<li>(<a[^>]*>)([^<]*)</a></li>",
                  lambda m: m[0] if rng.random() < 0.7 else f"<li>{m[2]} is a page, of this site, that we like to show.</li>", page)


def scores(given, truth, weights, monkeypatch):
    """Mean text F1 with the cut and without, and the share of pages whose cut
    reaches maximum flow."""
    calls, flow = [], M._max_flow
    with monkeypatch.context() as m:
        m.setattr(M, "_max_flow", lambda *a: calls.append(1) or flow(*a))
        with_cut, without = [], []
        for page, true in zip(given, truth, strict=True):
            shape = M.shape(M.blocks(page))
            shape = M.replace(shape, labels=M.shape(M.blocks(true)).labels)
            with_cut.append(M.text_f1(M.labelled(shape, weights), shape))
            without.append(M.text_f1((shape.features @ weights.block > 0).tolist(), shape))
    return np.mean(with_cut), np.mean(without), len(calls) / len(given)


def test_the_cut_betters_the_classifier(pages, weights, monkeypatch):
    rng = random.Random(1)
    odd = [noisy(p, rng) for p in pages]
    cut, alone, share = scores(pages, pages, weights, monkeypatch)
    assert cut == alone == 1 and share > 0.5
    cut, alone, share = scores([tagless(p) for p in pages], pages, weights, monkeypatch)
    assert cut > alone + 0.03 and share > 0.9
    cut, alone, share = scores(odd, odd, weights, monkeypatch)
    assert cut >= alone and cut > 0.9999 and share > 0.9
    cut, alone, share = scores([tagless(p) for p in odd], odd, weights, monkeypatch)
    assert cut > alone + 0.03 and share > 0.9


def test_weights_come_from_all_blocks_of_the_sample(spark):
    long = "<nav>" + "<p>Menu entry</p>" * 300 + "</nav><article>" + "<p>A long sentence, with commas, that goes on for a while.</p>" * 300 + "</article>"
    shapes = [M.shape(M.blocks(long))]
    assert len(shapes[0].features) == 600 and (shapes[0].labels == 1).sum() == 300
    df = spark.createDataFrame([(1, long)], "page_id long, html string")
    got, want = M.train(df), M.fitted(shapes)
    assert np.allclose(got.block, want.block) and np.allclose(got.edge, want.edge) and got.scale == want.scale
    assert not np.allclose(got.block, M.PRIOR)


def test_no_labels_leave_the_stated_weights(spark):
    for rows in ([], [(1, None)], [(1, "<div>one</div><div>two</div>")]):
        got = M.train(spark.createDataFrame(rows, "page_id long, html string"))
        assert np.allclose(got.block, M.PRIOR) and np.allclose(got.edge, M.EDGE_PRIOR) and got.scale == 1.0


def test_repeated_and_very_long_pages(spark):
    page = "<nav><ul><li><a href=/>Home</a></ul></nav><article><p>" + "word " * 200_000 + "end.</p></article>"
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (1, "u", page)], "page_id long, url string, html string")
    got = M.extract(rows, M.train(rows)).collect()
    assert len(got) == 3 and {len(r.text) for r in got} == {len("word " * 200_000 + "end.")}

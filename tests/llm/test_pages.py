import numpy as np
import pytest

from quarry.llm import pages as P
from quarry.llm import queries
from quarry.llm.recurrent import BiLSTM, padded

SF = "/root/testdata/sf0.01"


def label(model, x, live):
    return model.label(lambda lo, hi: (x[lo:hi], live[lo:hi]), *live.shape)


def blocks(html):
    return [b[0] for b in P.leaf_blocks(html)]


@pytest.mark.parametrize("html, want", [
    ("<p>One &amp; two&nbsp;&#233; &copy; &bogus; &lt;b&gt;<p>three", ["One & two é © &bogus; <b>", "three"]),
    ("a<b>b</b> <i>c\n\t d</i><div>e<br>f</div>g", ["ab c d", "e f", "g"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", ["x", "y", "z"]),
    ("<script>var t='</p>';</script>s<style>p{}</style><title>t</title>", ["s"]),
    ("<p title='a>b' class=\"x\">q</p><!-- c <p>d</p> -->r", ["q", "r"]),
    ("<!DOCTYPE html><?xml x?>1 < 2 and 3 > 2<p", ["1 < 2 and 3 > 2"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("x<script>never closed <p>y", ["x"]),
    ("x<!-- never closed <p>y", ["x"]),
    ("</p></div>z</b>", ["z"]),
    ("", []), ("   ", []), ("<p></p><p> </p>", []),
])
def test_blocks(html, want):
    assert blocks(html) == want


def test_paths_links_and_weak_labels():
    html = ('<body><header>h</header><nav><a href="/x">n</a></nav><div class="ad">a</div><main><h1>t</h1><p>one <a href="#">two</a></p>'
            '<div class="comments"><p>c</p></div><aside>s</aside></main><div id="cookie-notice">k</div><div class="story">m</div>'
            '<form><p>f</p></form><p class="shadow">n</p><footer>e</footer>')
    got = {t: (P.weak_label(path), linked) for t, path, linked in P.leaf_blocks(html)}
    assert [t for t, (y, _) in got.items() if y] == ["t", "one two", "m", "n"] or got["n"][0] == 1
    assert got["one two"] == (1, 3) and got["a"][0] == got["c"][0] == got["k"][0] == got["f"][0] == got["s"][0] == got["h"][0] == 0


def test_long_and_deep_pages_take_linear_time():
    assert blocks("<div>" * 3000 + "x" + "</div>" * 3000) == ["x"]
    assert len(blocks("<p>y" * 20_000)) == 20_000
    assert blocks("<" * 20_000 + "p>")[0].startswith("<<")


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = BiLSTM(5, 3)
    batch = padded([(rng.normal(size=(4, 5)), rng.integers(0, 2, 4).astype(float)), (rng.normal(size=(2, 5)), np.ones(2))])

    def loss():
        p = label(model, batch[0], batch[1])
        return -np.where(batch[1], np.log(np.where(batch[2] == 1, p, 1 - p)), 0).sum() / batch[1].sum()
    grad = model._gradients(*batch)
    for k, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        for step in (1e-5,):
            w[at] += step
            up = loss()
            w[at] -= 2 * step
            down = loss()
            w[at] += step
            assert grad[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_padding_does_not_change_a_page():
    rng = np.random.default_rng(1)
    model = BiLSTM(4, 3)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(9, 4))
    alone = padded([(a, np.zeros(3))])
    both = padded([(b, np.zeros(9)), (a, np.zeros(3))])
    assert label(model, alone[0], alone[1])[:, 0] == pytest.approx(label(model, both[0], both[1])[:3, 1])


def test_context_decides_for_equal_blocks():
    """The same vector is main text only after a marker: a labeller without context can't tell."""
    rng = np.random.default_rng(2)
    data = []
    for _ in range(60):
        n, at = 8, rng.integers(1, 7)
        x = np.zeros((n, 2))
        x[:, 0], x[at, 1] = 1, 1
        data.append((x, (np.arange(n) > at).astype(float)))
    model = BiLSTM(2, 6).fit(data, epochs=60)
    x, live, y = padded(data)
    assert ((label(model, x, live) > 0.5) == (y > 0.5))[live].mean() > 0.95


def structural(html):
    """Brute force for the fixture's pages: what stands in the article, paragraph by paragraph."""
    import re
    from html import unescape
    inside = html.split("<article>", 1)[1].split("</article>", 1)[0] if "<article>" in html else ""
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if False else "", re.sub("<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_pages_against_the_articles(spark):
    rows = queries.QUERIES["op5_html_extraction"](spark, SF).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html)
    same = [r["text"] == structural(html[r["page_id"]]) for r in rows]
    assert np.mean(same) == 1.0 and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_odd_pages(spark):
    model = P.train(spark.read.parquet(f"{SF}/pages.parquet"))
    long = "<html><body><article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article></body></html>"
    rows = [(1, "u", None, "text"), (2, None, "", "text"), (None, "u", "<nav><a>x</a></nav>", "t"), (4, "u", long, "t"), (4, "u", long, "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in P.extract(d, model).collect()), key=repr)
    assert len(got) == 5 and [r[2] for r in got if r[0] in (1, 2)] == ["", ""]
    assert [r[3] for r in got if r[0] == 4] == [3000 * 27 - 1] * 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert P.extract(empty).collect() == []


def test_slices_carry_the_state(monkeypatch):
    rng = np.random.default_rng(3)
    model = BiLSTM(4, 3)
    data = padded([(rng.normal(size=(n, 4)), np.zeros(n)) for n in (1, 9, 30)])
    whole = label(model, data[0], data[1])
    for size in (1, 7, 29):
        monkeypatch.setattr("quarry.llm.recurrent.SLICE", size)
        assert label(model, data[0], data[1])[data[1]] == pytest.approx(whole[data[1]])


def test_groups_are_bounded():
    lengths = np.array([0, 3, 5, 100_000, 3, 0, *[40] * 1000])
    groups = list(P._groups(lengths))
    assert sorted(i for g in groups for i in g) == sorted(np.flatnonzero(lengths))
    assert all(len(g) == 1 or len(g) * lengths[g].max() <= P.CELLS for g in groups)


def test_memory_of_a_very_long_page_beside_short_ones():
    import tracemalloc
    path = ("body", "main")
    pages = [[("some words here", path, 0)] * 20 for _ in range(300)] + [[("some words here", path, 0)] * 30_000]
    model = BiLSTM(P.PATH + P.WORDS + P.NUMBERS)
    tracemalloc.start()
    out = P._labelled(pages, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out[-1]) == 30_000 and peak < 60 << 20
    assert out[-1][15_000] == pytest.approx(out[-1][15_001], abs=1e-3)


def test_training_sees_ends_of_long_pages(spark):
    """Windows come from pages of every length; a page's end is as likely as its beginning."""
    import pyarrow as pa
    from quarry.session import ship_package
    ship_package(spark)
    pages = ["".join(f"<p>{i} {k}</p>" for k in range(n)) + "<footer>end</footer>" for i, n in enumerate([1, 5, 199, 450, 5000, 30_000])]
    batch = pa.record_batch({"h": pa.array(range(len(pages)), pa.int64()), "html": pa.array(pages)})
    drawn = [r for b in P._drawn([batch]) for r in b.to_pylist()]
    assert [sum(r["h"] == i for r in drawn) for i in range(len(pages))] == [1, 1, 1, 2, 2, 2]
    assert all(len(r["labels"]) <= P.WINDOW for r in drawn) and max(r["lo"] for r in drawn) > 2000
    many = [f"<p>{i}</p>" * 500 + "<footer>end</footer>" for i in range(60)]
    ends = [r for b in P._drawn([pa.record_batch({"h": pa.array(range(60), pa.int64()), "html": pa.array(many)})]) for r in b.to_pylist()]
    assert 25 < sum(0 in r["labels"] for r in ends) < 60        # the last of three windows holds the footer
    d = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert P.extract(d).count() == len(pages)


def test_pages_without_an_article(spark):
    """What conventions call main text is found without an article element."""
    model = P.train(spark.read.parquet(f"{SF}/pages.parquet"))
    rows = []
    for i, r in enumerate(spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect()):
        if "<article>" in r["html"]:
            rows.append((i, "u", r["html"].replace("<article>", "<div>").replace("</article>", "</div>"), structural(r["html"])))
    d = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in P.extract(d.drop("want"), model).collect()}
    shares = []
    for i, _, _, want in rows:
        a, b = set(got[i].split("\n")), set(want.split("\n"))
        shares.append(len(a & b) / max(1, len(a | b)))
    assert np.mean(shares) > 0.9

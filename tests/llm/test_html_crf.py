from tessera.llm import html_crf as h
from tessera.llm.html_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><div class="logo">Site name</div></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>World</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree.</div><!-- ad --><div class="ad">Buy this thing now, it is good.</div>
<article><h1>Fish &amp; chips</h1><p>First  para<b>graph</b>,\n with &eacute; and &#8212; dash.<br>Next line.<p>Second one, unclosed
<div class="advert">Another thing to buy today.</div><blockquote>A quote stands here.</blockquote></article>
<aside class="sidebar"><h3>More</h3><p>Something else to read over here.</p></aside>
<form action=x><label>Your mail</label><button>Send</button></form>
<section class="comments"><h3>2 comments</h3><article class="comment"><p>I do not agree with this at all.</p></article></section>
<footer>&copy; 2024 Someone. All rights.</footer></body></html>"""
WANT = "Fish & chips First paragraph, with é and — dash. Next line. Second one, unclosed A quote stands here."
KINDS = "page_id long, url string, html string, text string, n_chars int"


def test_article_text_only():
    assert h.main_text(PAGE, h.default_field()) == WANT


def test_held_out_block_accuracy():
    field, wrong, total = h.default_field(), 0, 0
    for page in labelled_pages(150, seed=77):
        blocks, labels = h.labelled_blocks(page)
        wrong += sum(a != b for a, b in zip(field.decode(field.scores(blocks)), labels))
        total += len(labels)
    assert wrong <= 0.03 * total


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(30):
        f = h.Field({})
        f.start, f.step = r.normal(size=2), r.normal(size=(2, 2))
        s = r.normal(size=6).tolist()
        score = lambda y: f.start[y[0]] + sum(s[k] * y[k] for k in range(6)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731,B023
        assert f.decode(s) == list(max(product((0, 1), repeat=6), key=score))
    assert h.Field({}).decode([]) == []


def test_rows_nulls_cut_pages_and_long_pages(spark):
    cut = PAGE[: PAGE.index("Second one")]
    long = "<article>" + "<p>Many words go here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "no tags at all &lt;"), (4, "u", cut), (5, "u", "<p <<< &am"), (6, "u", long), (1, "u", PAGE)]
    got = h.extract(spark.createDataFrame([(*x, "clash", 0) for x in rows], KINDS)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == WANT and by[1].n_chars == len(WANT)
    assert by[2].text == "" and by[3].text == "" and by[2].n_chars == 0
    assert by[4].text == WANT[: WANT.index(" Second one")]
    assert by[6].text.count("Many words go here.") == 20_000


def test_unclosed_unread_elements_end_where_a_block_starts():
    field = h.default_field()
    assert h.main_text(PAGE.replace("</head>", ""), field) == WANT
    assert h.main_text(PAGE.replace("</head><body>", ""), field) == WANT
    assert h.main_text(PAGE.replace("</title>", "").replace("</head>", ""), field) == WANT
    for junk in ("<select><option>One<option>Two", "<noscript>Turn scripts on.", "<object data=x>", "<svg><path d=x>", "<iframe src=x>", "<textarea>Yours", "<video src=x>", "<head><title>T", "<svg><noscript><select>"):
        assert h.main_text(PAGE.replace("<article><h1>", f"{junk}<article><h1>"), field) == WANT, junk
        assert h.main_text(PAGE.replace("<p>First", f"{junk}<p>First"), field) == WANT, junk
    # closed ones are not read, whatever is in them
    for tag in ("noscript", "object", "video", "canvas", "template"):
        assert h.main_text(PAGE.replace("<p>First", f"<{tag}><div><p>Not to be read at all.</p></div><hr></{tag}><p>First"), field) == WANT, tag
    assert [b[0] for b in h.leaf_blocks("<head><meta charset=x><noscript><p>No</p></noscript><title>No</title>Yes<p>And")] == ["Yes", "And"]


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], KINDS)).collect() == []


def test_gradient_is_that_of_all_labellings():
    """Forward-backward against the likelihood summed over every labelling, by finite differences."""
    from itertools import product

    import numpy as np

    r = np.random.default_rng(5)
    p, length, n = 3, 4, 2
    x, y = r.integers(0, 2, (p, length, n)).astype(np.float32), r.integers(0, 2, (p, length))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], float)
    theta = r.normal(size=n + 6)

    def likelihood(t):
        w, start, step = t[:n], t[n : n + 2], t[n + 2 :].reshape(2, 2)
        total = 0.0
        for i in range(p):
            m = int(mask[i].sum())
            score = lambda lab: start[lab[0]] + sum(x[i, k] @ w * lab[k] for k in range(m)) + sum(step[a, b] for a, b in zip(lab, lab[1:]))  # noqa: E731,B023
            total += score(y[i, :m]) - np.logaddexp.reduce([score(lab) for lab in product((0, 1), repeat=m)])
        return total / p

    f = h.Field({"a": 0, "b": 1})
    f.w, f.start, f.step = theta[:n], theta[n : n + 2], theta[n + 2 :].reshape(2, 2)
    got = h.gradient(f, x, y * mask.astype(int), mask)
    for k in range(len(theta)):
        d = np.zeros_like(theta)
        d[k] = 1e-4
        assert abs((likelihood(theta + d) - likelihood(theta - d)) / 2e-4 - got[k]) < 1e-3


def test_long_pages_of_unmatched_tags_take_one_pass():
    n = 100_000
    assert h.leaf_blocks("<i>" * n + "text" + "</b>" * n)[0][0] == "text"
    assert h.leaf_blocks("<div>" * 50 + "<i>" * n + "</p>" * n + "end")[0][0] == "end"


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 1), (None, None, None, None, None)], KINDS)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in h.extract(df).collect()) == [(0, "", 0), (1, WANT, len(WANT))]
    assert h.extract(df.where("false")).collect() == []

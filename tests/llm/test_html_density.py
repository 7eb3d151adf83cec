import math

import pytest

from quillon.llm.html_density import Page, densities, extract, extract_pages

PARAGRAPH = "This is a long run of plain text that says something at some length. " * 6
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<nav><ul>{''.join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))}</ul></nav>
<!-- c --><div class="ad">Buy</div>
<article><h1>Head line</h1><p>{PARAGRAPH}</p><p>Fish &amp; chips. {PARAGRAPH}<br>next</p><p>{PARAGRAPH}</p></article>
<footer><a href="/a">About</a> &copy; us</footer><script>var t="</p>";</script></body></html>"""


def tree(page):
    kids = {i: [] for i in range(len(page.tag))}
    for i in range(1, len(page.tag)):
        kids[page.parent[i]].append(i)
    return kids


def brute(markup):
    """The definition, by recursion over the tree."""
    page = Page(markup)
    kids = tree(page)
    own = {}
    for n, t in page.texts:
        own[n] = own.get(n, 0) + len(t)

    def inside(i):
        return i >= 0 and (page.tag[i] == "a" or inside(page.parent[i]))

    def below(i):
        return [i] + [x for k in kids[i] for x in below(k)]

    def counts(i):
        b = below(i)
        return sum(own.get(x, 0) for x in b), sum(own.get(x, 0) for x in b if inside(x)), len(b) - 1, sum(page.tag[x] == "a" for x in b[1:])

    cb, lcb, _, _ = counts(page.body)

    def density(i):
        c, lc, t, lt = counts(i)
        if not c:
            return 0.0
        t, lt = max(t, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + math.e)
        x = c / t * math.log(c / max(lc, 1) * t / lt)
        return x / math.log(base) if base > 1 else x

    d = [density(i) for i in range(len(page.tag))]
    s = [sum(d[k] for k in kids[i]) for i in range(len(page.tag))]
    top = max(below(page.body), key=lambda i: (s[i], -i))
    path, i = [], top
    while i != page.body:
        path.append(d[i])
        i = page.parent[i]
    threshold = min(path, default=d[top])
    marked = {top}

    def mark(i):
        if i in marked or d[i] < threshold:
            return
        marked.add(max(below(i), key=lambda x: (s[x], -x)))
        for k in kids[i]:
            mark(k)

    mark(page.body)
    kept = {x for m in marked for x in below(m)}
    return d, s, s[top], threshold, [t for n, t in page.texts if t and n in kept]


def test_against_recursion():
    others = [PAGE.replace("<article>", "<div>").replace("</article>", "</div>"), PAGE[: len(PAGE) // 2], "<p>a<p>b <b>c", f"<body><div>{PARAGRAPH}<a>x</a></div><div><p>{PARAGRAPH}</p><p>q</p></div>"]
    for markup in [PAGE, *others]:
        page = Page(markup)
        _, d, s = densities(page)
        bd, bs, top, threshold, texts = brute(markup)
        assert all(math.isclose(a, b) for a, b in zip(d, bd)) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(s, bs))
        text, n, total, limit = extract(markup)
        assert math.isclose(total, top, abs_tol=1e-9) and math.isclose(limit, threshold, abs_tol=1e-9)
        assert text.split() == " ".join(texts).split() and n == len(text)


def test_extracts_article():
    text = extract(PAGE)[0]
    assert "Fish & chips." in text and "Link" not in text and "Buy" not in text and "var t" not in text and "\nnext" in text


def test_parser():
    p = Page("<ul><li>a<li>b</ul><p>x<div>y</div></p>z<br/><table><tr><td>1<td>2</table><a b='>'>q</a>5 < 6")
    kids = tree(p)
    assert [p.tag[k] for k in kids[0]] == ["ul", "p", "div", "br", "table", "a"]
    assert [p.tag[k] for k in kids[1]] == ["li", "li"] and ("q" in [t for _, t in p.texts]) and "5 < 6" in [t for _, t in p.texts]


def test_odd_input(spark):
    assert extract(None) == extract("") == extract("  \n") == extract("<script>x</script>") == (None, 0, None, None)
    deep = "<div>" * 20000 + "text " * 10 + "</div>" * 20000
    assert extract(deep)[0] == ("text " * 10).strip()
    assert extract("<a " * 5000) is not None and extract("<!-- " + "x" * 10)[0] is None
    t = spark.createDataFrame([(1, PAGE, 1), (2, None, 2), (1, PAGE, 1), (None, "<p>a", 3)], "page_id long, html string, n_chars int")
    rows = extract_pages(t).collect()
    assert len(rows) == 4 and [r.n_chars for r in rows if r.page_id == 2] == [0]
    assert extract_pages(t.limit(0)).count() == 0


@pytest.mark.parametrize("markup", ["<div>" * 200_000 + "text", "<div>" + "</p></span>" * 100_000 + "text", "<p>" + "<table>" * 100_000 + "<div>" * 100_000 + "text", "<ul>" + "<li>" * 200_000 + "text", "<a><b><i>" * 60_000 + "text" + "</a>" * 60_000])
def test_deep_and_unmatched_tags_take_linear_time(markup):
    import time

    began = time.time()
    text, n, *_ = extract(markup)
    assert text == "text" and n == 4 and time.time() - began < 4

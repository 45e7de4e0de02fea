"""Wrapper induction: tree matching against plain recursion, and content of whole pages."""

import random

import pytest
from fixtures import DATA

from resemblage.llm import wrappers as w


def plain_match(a, b):
    if a[0] != b[0]:
        return 0

    def rows(xs, ys):
        if not xs or not ys:
            return 0
        return max(rows(xs[:-1], ys), rows(xs, ys[:-1]), rows(xs[:-1], ys[:-1]) + plain_match(xs[-1], ys[-1]))

    return 1 + rows(a[1], b[1])


def random_tree(r, depth=3):
    return r.choice("abc") if depth < 3 else "r", tuple(random_tree(r, depth - 1) for _ in range(r.randint(0, 3))) if depth else ()


def test_matching_equals_plain_recursion():
    r = random.Random(1)
    for _ in range(60):
        a, b = random_tree(r), random_tree(r)
        assert w.match(a, b, {}) == plain_match(a, b)
        steps = w.align(a[1], b[1], {})
        assert 1 + sum(w.match(a[1][i], b[1][j], {}) for i, j in steps if i is not None and j is not None) == w.match(a, b, {})
        assert [i for i, _ in steps if i is not None] == list(range(len(a[1]))) and [j for _, j in steps if j is not None] == list(range(len(b[1])))
        assert w.read(w.show(a)) == a


def test_merging_does_not_depend_on_order():
    r = random.Random(2)
    trees = [random_tree(r) for _ in range(8)]
    want = w.merge(trees)
    for _ in range(3):
        r.shuffle(trees)
        assert w.merge(trees) == want


def test_parser():
    page = w.Page("<!DOCTYPE html><body><p>a<p>b<br>c<ul><li>x<li>y</ul><script>var t='</p>'</script><!-- <b> --><div title='a>b'>d</span></div>e")
    assert page.tags == ["#root", "body", "p", "p", "br", "ul", "li", "li", "div"]
    assert [page.tags[n] + ":" + t for n, t in page.texts] == ["p:a", "p:b", "p:c", "li:x", "li:y", "div:d", "body:e"]
    deep = w.Page("<div>" * 5000 + "x")
    assert len(deep.tags) == 5001 and w.structure(deep, {})


@pytest.mark.parametrize("levels", [50, 98, 99, 100, 120, 5000])
def test_what_follows_a_deep_element_keeps_its_parent(levels):
    for inner in ("<i>", "<p>", "<div>"):
        end = inner.replace("<", "</")
        page = w.Page(f"<main><p>A</p>{inner * levels}deep{end * levels}<p>after</p></main><p>last</p>")
        place = {t: page.tags[page.parents[n]] + ">" + page.tags[n] for n, t in page.texts}
        assert place["after"] == "main>p" and place["last"] == "#root>p" and place["A"] == "main>p" and "deep" in place
    page = w.Page("<div>" * levels + "x" + "</div>" * (levels - 1) + "<b>y</b></div><b>z</b>")
    assert {t: page.parents[n] for n, t in page.texts if t != "x"} == {"y": 1, "z": 0}


def html(nav, title, paragraphs, foot):
    return f"<html><head><title>{title}</title></head><body><nav>{''.join(f'<a>{n}</a>' for n in nav)}</nav><article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>{foot}</footer></body></html>"


def site(n):
    pages = [html(["Home", "News"], f"Title {i}", [f"Paragraph {i}.{k} with <b>bold {i}</b> &amp; more {i}{k}" for k in range(i % 4 + 1)] + ["Sign up now"] * (i % 2), "© us") for i in range(n)]
    want = ["\n".join([f"Title {i}", *(f"Paragraph {i}.{k} with bold {i} & more {i}{k}" for k in range(i % 4 + 1))]) for i in range(n)]
    return pages, want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "no", "no", "no") for r in rows], "page_id long, url string, html string, host string, HTML string, chunk string")


def test_content_is_what_varies(spark):
    pages, want = site(12)
    df = frame(spark, [(i, f"https://www.Site.example.com:80/{i}", h) for i, h in enumerate(pages)] + [(99, "http://alone.example.com/", pages[0])])
    for options in ({}, {"broadcast": 0, "chunk": 5}):
        got = {r["page_id"]: r for r in w.extract(df.repartition(4), **options).collect()}
        assert [got[i]["text"] for i in range(12)] == want and got[0]["host"] == "site.example.com"
        assert got[99]["text"] == "Home News\nTitle 0\nParagraph 0.0 with bold 0 & more 00\n© us" and got[99]["template_parts"] == 0


def test_copies_and_shared_passages_stay(spark):
    """Copies differ in the frame around the article; two pages of 20 share a passage, all have one notice."""
    def page(i, paragraphs):
        return html(["Home", f"Link {i}"], f"Title {paragraphs[0]}", [*paragraphs, "All rights reserved"], f"Made in {i} s")

    texts = [[f"Own {i}", *(["Passage of two pages"] if i in (3, 4) else []), f"End {i}"] for i in range(20)]
    rows = [(i, page(i, t), t) for i, t in enumerate(texts)] + [(100 + i, page(100 + i, texts[7]), texts[7]) for i in range(60)]
    for options in ({}, {"broadcast": 0, "chunk": 9}):
        got = {r["page_id"]: r["text"].split("\n") for r in w.extract(frame(spark, [(i, f"http://a.com/{i}?ref=x", h) for i, h, _ in rows]).repartition(3), **options).collect()}
        assert all(got[i][-1 - len(t):-1] == t and "Home" not in got[i] and "All rights reserved" not in got[i] for i, _, t in rows)


def plain_extract(pages):
    """Content of one host's pages by definition: a value goes if half of the distinct contents, two at least, stand with it in its slot."""
    parsed = [w.Page(h) for h in pages]
    template = w.merge({w.structure(p, {}) for p in parsed}, {})
    found = [w.values(p, w.slots(template, tuple(p.tags), tuple(p.parents), {})) for p in parsed]

    def own(page, vs):
        def above(n, tags):
            while n >= 0:
                if page.tags[n] in tags:
                    return True
                n = page.parents[n]
            return False

        main = [t for _, n, t in vs if above(n, {"article", "main"})]
        return tuple(main or [t for _, n, t in vs if not above(n, {"nav", "header", "footer", "aside", "form"})] or [t for _, _, t in vs])

    contents = [own(p, vs) if vs else None for p, vs in zip(parsed, found)]
    n = len({c for c in contents if c is not None})
    out = []
    for vs in found:
        kept = [t for s, _, t in vs if (k := len({c for c, us in zip(contents, found) if any(u[0] == s and u[2] == t for u in us)})) < max(2, 0.5 * n)]
        out.append((kept, len(vs) - len(kept)))
    return out


def test_constant_or_varying_equals_brute_force(spark):
    r = random.Random(4)
    pages = []
    for i in range(40):
        paragraphs = [f"Own {i}.{k}" for k in range(r.randint(0, 3))] + r.sample(["Sign up now", "Read more", "Series A", "Series B", "All rights reserved"], r.randint(0, 4))
        r.shuffle(paragraphs)
        page = html(["Home", r.choice(["News", "Blog"]), f"Link {i}"], f"Title {i % 25}", paragraphs, r.choice(["© us", f"Made in {i} s"]))
        pages.append(page if r.random() < 0.7 else page.replace("<article>", "<div><article>").replace("</article>", "</article></div>"))
    pages += pages[:7] + ["", "<p>Home</p>"]
    got = {x["page_id"]: x for x in w.extract(frame(spark, [(i, f"http://a.com/{i}", h) for i, h in enumerate(pages)]).repartition(4)).collect()}
    for i, (kept, rest) in enumerate(plain_extract(pages)):
        assert got[i]["text"].replace("\n", " ") == " ".join(kept) and (got[i]["content_parts"], got[i]["template_parts"]) == (len(kept), rest)


def test_a_repeated_crawl_changes_nothing(spark):
    pages, want = site(12)
    once = [(i, f"http://a.com/{i}", h) for i, h in enumerate(pages)]
    again = once + [(100 + i, f"http://a.com/{i}?again", h) for i, h in enumerate(pages)] + [(200 + i, f"http://a.com/{i}", pages[3]) for i in range(30)]
    a, b = ({r["page_id"]: r["text"] for r in w.extract(frame(spark, rows).repartition(3)).collect()} for rows in (once, again))
    assert all(b[i] == a[i] == want[i] == b[100 + i] for i in range(12)) and all(b[200 + i] == want[3] for i in range(30))


def test_rounds_of_folding(spark):
    """Many structures on one host, a few at a time, in several rounds."""
    r = random.Random(9)
    pages = [html(["Home"], f"T {i}", [f"Own {i}.{k}" for k in range(2)], "foot").replace("</article>", "".join(f"<{t}>x{i}</{t}>" for t in r.choices(["h2", "ul", "table", "pre", "h3"], k=r.randint(0, 6))) + "</article>") for i in range(60)]
    rows = spark.createDataFrame([(i, "a.com", h) for i, h in enumerate(pages)], "page_id long, host string, html string").repartition(4)
    structures = {w.structure(w.Page(h), {}) for h in pages}
    for fold in (5, 1000):
        got = w.templates(rows, fold).collect()
        assert len(got) == 1 and got[0]["pages"] == 60
        tree = w.read(got[0]["tree"])
        assert len(structures) > 30 and all(w.match(t, tree, {}) == sum(1 for _ in nodes(t)) for t in structures)


def nodes(t):
    yield t
    for c in t[1]:
        yield from nodes(c)


def test_values_beside_recurring_ones_stay(spark):
    """Each page has a paragraph of its own, one beside it that all have and one that a third has."""
    pages = [html(["Home"], f"Title {i}", [f"Own {i}", "Sign up now", f"Series {i % 3}"], "© us") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in w.extract(frame(spark, [(i, f"http://a.com/{i}", h) for i, h in enumerate(pages)])).collect()}
    assert got == {i: f"Title {i}\nOwn {i}\nSeries {i % 3}" for i in range(12)}


def test_both_plans_agree_on_pages(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    a, b = (sorted(map(str, w.extract(df, **o).collect())) for o in ({}, {"broadcast": 0, "chunk": 3}))
    assert a == b and len(a) == df.count()


def test_hostile_table(spark):
    rows = [(1, None, "<p>x</p>"), (2, "no host", ""), (3, "http://a.com/", None), (None, "http://a.com/", "plain"), (4, "http://a.com/", "<p>" + "long text " * 50_000), (5, "http://a.com/", "<<<>>> </p></p><b"), (5, "http://a.com/", "<<<>>> </p></p><b"), (6, "http://a.com/", "<dt>a<dd>b" * 3000)]
    got = w.extract(frame(spark, rows)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[3]["text"] is None and by[2]["text"] == "" and by[1]["text"] == "x" and by[1]["host"] == "" and len(by[4]["text"]) == 499_999
    assert w.extract(frame(spark, [])).count() == 0

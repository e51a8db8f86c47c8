import random
from collections import defaultdict

import pytest

from spanloom.llm import html as H

SCHEMA = "page_id long, url string, html string, text string, host int"


def extract(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}


def test_article_alone(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><!-- x <p>no</p> --><article><h2>A &amp; B</h2><p><b>one&nbsp;\n two<br>three</b><p>four <span class='ad'>buy</span>five &lt;x&gt;"
        "<form><input>sub</form><ul><li>i<li>ii</ul><section class='comments'><p>nice</p></section></article><aside>side</aside><footer>&copy; me</footer>"
    )
    got = extract(spark, [(1, "http://a.b/c", page), (2, None, None), (3, "", ""), (4, "http://x", "plain   text"), (5, "http://y", "<p>a < b<p>c")])
    assert got == {1: "A & B\n\none two three\n\nfour five <x>\n\ni\n\nii", 2: "", 3: "", 4: "plain text", 5: "a < b\n\nc"}


@pytest.mark.parametrize("pages", [20, 3, 2])
def test_template_text_is_not_content(spark, pages):
    rng = random.Random(pages)
    rows, want = [], {}
    for i in range(pages):
        body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(rng.randrange(1, 5))]
        shown = "".join(f"<div class='par'>{p}</div>" for p in body)
        rows.append((i, f"https://www.host.example/{i}", f"<html><body><div class='wrap'><div class='top'>Welcome to our site</div><div class='txt'>{shown}</div><div>All rights reserved</div></div></body></html>"))
        kept = body if pages >= H.PAGES else ["Welcome to our site", *body, "All rights reserved"]
        want[i] = "\n\n".join(kept)
    assert extract(spark, rows) == want


def test_copies_keep_their_content(spark):
    page = "<body><article><p>same text</p></article></body>"
    assert set(extract(spark, [(i, "http://h/x", page) for i in range(12)]).values()) == {"same text"}


def test_menus_without_marks(spark):
    page = "<div><div><a>x</a> <a>y</a></div><div>The text has <a>a link</a> and more words.</div></div>"
    assert extract(spark, [(1, "http://h/", page)]) == {1: "The text has a link and more words."}


def test_unmarked_slots_are_judged_over_the_host(spark):
    """Menus whose links vary and notices that rotate stand in slots of their own; a page alone cannot tell."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(12):
        text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(2)]
        menu = f"<a>m{rng.randrange(10**6)}</a>" if i else "plain"  # the first page's menu is no link
        links = f"<ul><li><a>ref{i}</a></li></ul>"
        notice = ("Summer sale ends soon", "Free parking on Mondays")[i % 2]
        rows.append((i, f"http://h/{i}", f"<body><div class='one'>{menu}</div><div class='two'>{notice}</div><div class='three'><h1>t{i}</h1><p>{text[0]}</p><p>{text[1]}</p>{links}</div></body>"))
        want[i] = "\n\n".join([f"t{i}", *text, f"ref{i}"])
    assert extract(spark, rows) == want
    alone = extract(spark, [(i, f"http://{i}/", h) for i, _, h in rows])  # without a template
    assert all(alone[i] != want[i] for i in want)


def test_words_that_do_not_mark_boilerplate(spark):
    body = (
        "<div class='layout-with-sidebar'><article class='post share-enabled'><header><h1><a>Title</a></h1><p>by me</p></header><div class='entry-header'><h2>Second</h2>date</div>"
        "<section id='comment-policy-law'>law</section><p class='related-work'>work</p><div hidden>gone</div><div data-x='hidden'>seen</div><div class='post-comments'>c</div></article></div>"
    )
    want = "Title\n\nSecond\n\nlaw\n\nwork\n\nseen"
    assert extract(spark, [(1, "http://h/", f"<body>{body}</body>")]) == {1: want}
    assert extract(spark, [(1, "http://h/", "<body class='has-sidebar'><div class='sidebar'><article><p>all</p></article></div></body>")]) == {1: "all"}
    assert extract(spark, [(1, "http://h/", "<body><form><main><p>all</p></main></form><aside><article>teaser</article></aside></body>")]) == {1: "all"}


def test_templates_equal_explicit_vectors(spark):
    rng = random.Random(3)
    pages = []
    for i in range(40):
        items = "".join(f"<li>{rng.randrange(99)}</li>" for _ in range(rng.randrange(4)))
        pages.append((i, f"http://h{i % 3}/", f"<body><div>Top</div><ul>{items}</ul><p>{rng.random()}</p>{'<hr><h2>x</h2>' if i % 2 else ''}</body>"))
    got = {r.host: (set(r.tags), set(r.texts)) for r in H.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    found = []
    for h in range(3):
        vectors, place, is_tag, mine = defaultdict(lambda: defaultdict(int)), defaultdict(list), {}, [p for p in pages if p[0] % 3 == h]
        for i, _, html in mine:
            for at, (token, tag) in enumerate(H.Page(html).tokens()):
                vectors[token][i] += 1
                is_tag[token] = tag
                if vectors[token][i] == 1:
                    place[token].append(at)
        classes = defaultdict(list)
        for t, v in vectors.items():
            if len(v) >= H.PAGES and len(v) >= H.SUPPORT * len(mine):
                classes[tuple(sorted(v.items()))].append((t, sum(place[t]) / len(v), is_tag[t]))
        order = sorted(classes.items(), key=lambda c: (-len(c[0]), -len(c[1])))
        template = H.nest([c for _, c in order if any(tag for *_, tag in c)])
        found.append(({t for t, _, tag in template if tag}, {t for t, _, tag in template if not tag}))
    assert sorted(map(repr, ((sorted(a), sorted(b)) for a, b in got.values()))) == sorted(map(repr, ((sorted(a), sorted(b)) for a, b in found)))


def test_nesting_drops_interleaved_classes():
    outer, inner, crossing = [(1, 0.0, True), (2, 10.0, True), (3, 20.0, True)], [(4, 3.0, True), (5, 4.0, False)], [(6, 5.0, True), (7, 15.0, True)]
    assert {t for t, _, _ in H.nest([outer, inner, crossing])} == {1, 2, 3, 4, 5}


def test_empty_and_odd(spark):
    assert extract(spark, []) == {}
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "http://h/", long), (1, "http://h/", long), (None, None, "<p>a</p>"), (2, "not a url", "<p>b</p>")]
    got = extract(spark, rows)
    assert got[1] == ("word " * 200_000).strip() and got[None] == "a" and got[2] == "b"


@pytest.mark.parametrize("pages", [3, 7])
def test_template_text_of_small_hosts(spark, pages):
    rows = [(i, "http://h/", f"<body><div class='top'>Welcome</div><div><div class='par'>text {i} alone</div></div><div>All rights reserved</div></body>") for i in range(pages)]
    assert extract(spark, rows) == {i: f"text {i} alone" for i in range(pages)}


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_headings_that_every_article_repeats_stay(spark, n):
    """What stands in an article is kept on hosts of any size; what every page repeats outside of it is not."""
    page = "<html><body><div>All our papers</div><article><h1>Title {0}</h1><h2>Introduction</h2><p>Text {0} of it.</p><h2>Method</h2><p>How {0} was done.</p></article><div>Imprint</div></body></html>"
    rows = spark.createDataFrame([(i, "http://h.example/%d" % i, page.format(i)) for i in range(n)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(rows).collect()}
    assert got == {i: f"Title {i}\n\nIntroduction\n\nText {i} of it.\n\nMethod\n\nHow {i} was done." for i in range(n)}

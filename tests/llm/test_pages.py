"""Main texts of made-up pages of several hosts and templates."""

import random

from agorascope.llm import wrappers


def pages(n=40):
    r = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "naïve", "x&y", "a<b", "“q”", "ünï"]
    out = []

    def sentence(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    def safe(text):
        return text.replace("&", "&amp;").replace("<", "&lt;")

    for i in range(n):
        host = f"h{i % 3}.example.org"
        title, body = sentence(4) + str(i), [sentence(r.randint(1, 30)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:  # an article with company
            inner = f"<h1>{safe(title)}</h1>" + "".join(f"<p>{safe(b)}\n   </p>" for b in body)
            html = (
                f'<!DOCTYPE html><html><head><title>t</title><script>if (a < b) "</p>"</script><style>p {{}}</style></head><body>'
                f'<header><a href="/">Home</a> {sentence(2)}</header><nav><ul><li><a>one {i}</a></li></ul></nav>'
                f'<div class="cookie-notice">We use cookies {i}</div><article>{inner}'
                f'<div class="share">share {i}</div><section class="comments"><article class="comment"><p>reader {sentence(5)}</p></article></section>'
                f'</article><aside class="sidebar"><p>{sentence(6)}</p></aside><form><label>mail</label><input></form>'
                f'<footer>&copy; {i}</footer></body></html>'
            )
        elif i % 3 == 1:  # no article element: divs, a menu of links, a constant notice
            html = (
                f'<html><body><div class="top"><div id="logo">Site name</div><ul><li><a>x{i}</a></li><li><a>y{i}</a></li></ul></div>'
                f'<div class="story">' + f"<h2>{safe(title)}</h2>" + "".join(f"<p>{safe(b)}" for b in body)
                + f'</div><div class="advert-box">buy {sentence(3)}</div><div class="closing">All rights reserved by us</div>'
            )
        else:  # main element, inline markup and breaks
            html = (
                f"<body><menu>m {i}</menu><main><h1>{safe(title)}</h1>"
                + "".join(f"<div><b>{safe(b)}</b><br>  <i>end</i></div><!-- c -->" for b in body)
                + "</main><div role='contentinfo'>info</div>"
            )
            body = [b + " end" for b in body]
        out.append((i, f"https://{host}/p/{i}", html, "\n".join([title, *body])))
    return out


def test_main_texts(spark):
    found = pages()
    rows = [(i, u, h, "x", 1) for i, u, h, _ in found] + [(900, None, None, "x", 1), (901, "https://h0.example.org/", "", None, 1), (0, *found[0][1:3], "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int").repartition(4)
    got = {}
    for r in wrappers.extract(table).collect():
        assert got.setdefault(r.page_id, r.text) == r.text
    assert got.pop(900) == "" and got.pop(901) == ""
    assert got == {i: t for i, _, _, t in found}
    assert wrappers.extract(table.limit(0)).count() == 0


def test_large_wrappers_are_joined(spark, monkeypatch):
    found = pages(12)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    table = spark.createDataFrame([(i, u, h) for i, u, h, _ in found], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract(table).collect()} == {i: t for i, _, _, t in found}


def test_names_do_not_mark_the_page():
    text = "<h1>Title</h1><p>The whole article is here.</p>"
    for html in (
        f"<html class='comments-open'><body class='no-sidebar has-banner'>{text}</body></html>",
        f"<body><main id='has-sidebar'><article class='post comments-open'>{text}</article></main></body>",
        f"<body><nav>home</nav><div class='has-sidebar'><div class='sidebar'>aside</div>{text}</div></body>",
    ):
        assert wrappers.main_text(wrappers.parse(html), None) == "Title\nThe whole article is here.", html
    reader = "<p>" + "I say what many readers say. " * 20 + "</p>"
    html = f"<body><article>{text}<div class='comments'><article class='comment'>{reader}</article></div></article></body>"
    assert wrappers.main_text(wrappers.parse(html), None) == "Title\nThe whole article is here."


def test_copies_and_constant_siblings(spark):
    copy = "<body><h1>Same title</h1><div><p {}>Only text</p></div></body>"
    rows = [(i, f"https://copies.org/{i}", copy.format(f"id='p{i % 3}'" if i > 3 else "")) for i in range(8)]
    want = {i: "Same title\nOnly text" for i in range(8)}
    for i in range(10, 18):
        rows.append((i, f"https://own.org/{i}", f"<body><p>text {i}</p><p>more {i}</p><p>All rights reserved.</p></body>"))
        want[i] = f"text {i}\nmore {i}"
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in wrappers.extract(table).collect()} == want


def test_tree_matching():
    a = wrappers._folded([wrappers.parse("<div><p>a</p><ul><li>x</li></ul><h2>t</h2></div>")], {})
    b = wrappers._folded([wrappers.parse("<div><h1>n</h1><p>b</p><h2>t</h2></div>")], {})
    assert wrappers.match(a, a)[0] == 6  # page, div, p, ul, li, h2
    assert wrappers.match(a, b)[0] == 4
    merged = wrappers.merge(a, b).children[0]
    assert [(c.label, c.pages, c.text is None) for c in merged.children] == [
        ("h1", 1, False), ("p", 2, True), ("ul", 1, False), ("h2", 2, False)
    ]


def brute_match(a, b):
    """The largest mapping, by trying all ways to map the children in order."""

    def pairings(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        skip = max(pairings(i + 1, j), pairings(i, j + 1))
        x, y = a.children[i], b.children[j]
        return max(skip, brute_match(x, y) + pairings(i + 1, j + 1)) if x.label == y.label else skip

    return 1 + pairings(0, 0)


def test_matching_is_largest():
    r = random.Random(8)

    def tree(depth):
        return wrappers.Slot(r.choice("ab"), (r.randint(0, 2),), children=[tree(depth - 1) for _ in range(r.randint(0, 4) if depth else 0)])

    for _ in range(150):
        a, b = tree(2), tree(2)
        a.label = b.label = "r"
        size, pairs = wrappers.match(a, b)
        assert size == brute_match(a, b) == 1 + sum(wrappers.match(a.children[i], b.children[j])[0] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        again = wrappers.loads(wrappers.dumps(a))
        assert again == a


def only(html):
    return wrappers.main_text(wrappers.parse(html), None)


def test_deep_pages(spark):
    n = 100_000
    for tag in ("div", "span", "h4", "ul", "li", "b", "article"):
        assert only(f"<body><article>top{f'<{tag}>' * n}in{f'</{tag}>' * n}<p>more</p></article><p>out</p></body>").split() in (
            ["top", "in", "more"], ["topin", "more"]
        )
    for html in ("</b>" * n + "<p>x", "<p>x" + "<b>" * n + "</i>" * n, "<div>" * n + "x"):
        assert only(html) == "x"
    deep = "<body>" + "<div>" * 1500 + "text {}" + "</div>" * 1500 + "</body>"
    rows = [(i, f"https://deep.org/{i}", deep.format(i)) for i in range(6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert {r.page_id: r.text for r in wrappers.extract(table).collect()} == {i: f"text {i}" for i in range(6)}


def test_words_in_an_article_are_kept():
    assert only("<article>The <span class='notice-word'>key</span> word <em class='share-of'>x</em>.</article>") == "The key word x."
    assert only("<article><p class='related'>One</p><h2 id='share'>Two</h2><div class='share'>no</div></article>") == "One\nTwo"
    assert only("<title>Name</title><p>Text</p>") == "Text"


def test_constant_parts(spark):
    page = "<body><div>Legal words</div><article><h1>Dish {0}</h1><h2>Ingredients</h2><p>Take {0}</p><h3>Legal words</h3></article></body>"
    rows = [(i, f"https://food.org/{i}", page.format(i)) for i in range(9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract(table).collect()} == {i: f"Dish {i}\nIngredients\nTake {i}" for i in range(9)}


def test_unique_names_do_not_grow_the_wrapper():
    letters = "abcdefghij"
    wrapper, most = None, 0
    for i in range(3000):
        name = "".join(letters[int(d)] for d in str(i))
        html = f"<body><p>Always here</p>" + "".join(f"<div id='post-{name}{x}'>{i}</div>" for x in "xyz") + "</body>"
        slot = wrappers._folded([wrappers.parse(html)], {})
        wrapper = slot if wrapper is None else wrappers.merge(wrapper, slot)
        most = max(most, len(wrapper.children[0].children))
    assert most < 600
    assert [c.pages for c in wrapper.children[0].children if c.label == "p"] == [3000]
    half = wrappers.loads(wrappers.dumps(wrapper))
    assert wrappers.merge(wrapper, half).children[0].pages == 6000

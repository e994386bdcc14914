from heirloom.llm import html

PROSE = "One sentence of the article, with a comma, goes on for some time and ends here."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    got = html.extract(
        page(
            "<header><p>Site name</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
            "<div class='cookie-notice'>We use cookies, as all do, for long and short reasons.</div>"
            f"<!-- c --><article><h1>Title &amp; more</h1><p><b>{PROSE}<br>next line\n  here<p>{PROSE}</p>"
            "<script>var t='</p>';</script><form><p>Sign up, now, please, for all of it</p></form>"
            "<div class='ad'>Buy, buy, buy</div><ul><li>first<li>second</ul>"
            "<table><tr><td>a<td>b<tr><td>c</table><aside>side, note</aside>"
            "<section id='comments'><p>A reader said, at length, that this was good, or so.</p></section></article>"
            "<div id='sidebar'><p>Links, links</p></div><footer>&copy; all</footer>"
        )
    )
    assert got == "\n".join(["Title & more", f"{PROSE} next line here", PROSE, "first", "second", "a", "b", "c"])


def test_best_container_and_its_siblings_without_semantic_tags():
    got = html.extract(
        page(
            "<div class='menu'><a href=1>a</a> <a href=2>b</a></div><div class='post-content'>"
            + f"<p>{PROSE}</p>" * 3
            + f"</div><p>{PROSE} {PROSE}</p><div class='related'><p>{PROSE}</p></div>"
        )
    )
    assert got == "\n".join([PROSE] * 3 + [f"{PROSE} {PROSE}"])


def test_broken_markup_and_odd_input():
    assert html.extract(None) == "" and html.extract("") == "" and html.extract("<p></p>") == ""
    assert html.extract("just, text") == "just, text"
    assert html.extract("<article><p>a &#233;&nbsp;b&am &lt;x&gt;") == "a é b&am <x>"
    assert html.extract("<article><p>a</i></span> b</div></article> tail") == "a b"
    assert html.extract("<div><p>x < y, z</p><script>never closed <p>no") == "x < y, z"
    deep = "<div>" * 5000 + f"<p>{PROSE}</p>"
    assert html.extract(deep) == PROSE


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE}</p></article>"), "t"), (None, None, None, None), (1, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")
    got = sorted((tuple(r) for r in html.main_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", PROSE), (None, None, ""), (1, "u", "")], key=repr)
    assert html.main_text(df.limit(0)).collect() == []


def test_parts_of_an_article_stay_however_long_it_is():
    for tag in ("article", "main"):
        for times in (3, 200):
            head = "<h1>Title</h1>" if tag == "main" else "<header><h1>Title</h1></header>"
            got = html.extract(
                page(
                    f"<nav><a href=1>a</a></nav><{tag}>{head}bare text<p>Short.</p><div>"
                    + f"<p>{PROSE}</p>" * times
                    + "</div><section><h4>More</h4><p>Brief.</p></section><dl><dt>a<dd>b</dl>"
                    "<figure><img><figcaption>Caption</figcaption></figure>"
                    f"<ul><li><a href=2>linked</a></ul></{tag}><footer>all</footer>"
                )
            )
            assert got == "\n".join(
                ["Title", "bare text", "Short.", *[PROSE] * times, "More", "Brief.", "a", "b", "Caption"]
            )


def test_nothing_depends_on_the_length_of_a_part():
    for wrapper in ("div", "section", "article"):
        for times in (1, 3, 25, 300):
            got = html.extract(
                page(
                    f"<nav><a href=1>a</a></nav><{wrapper}><h4>Head</h4><dl><dt>term<dd>said</dl><p>Short.</p>bare text<div>"
                    + f"<p>{PROSE}</p>" * times
                    + f"</div><section><h5>More</h5><p>Brief.</p></section></{wrapper}><footer>all</footer>"
                )
            )
            assert got == "\n".join(["Head", "term", "said", "Short.", "bare text", *[PROSE] * times, "More", "Brief."])


def test_names_of_comments_shares_and_sidebars_win():
    for name in ("post-comments", "comment-body", "comment-content", "entry-share", "content-sidebar"):
        for tag in ("article", "div"):
            body = f"<{tag}><h1>Title</h1><p>{PROSE}</p><div class='{name}'>" + f"<p>{PROSE} {PROSE}</p>" * 9 + f"</div></{tag}>"
            assert html.extract(page(body)) == f"Title\n{PROSE}"
    own = f"<div class='content has-sidebar'><h1>Title</h1><p>{PROSE}</p></div><div class='comments'><p>{PROSE}</p></div>"
    assert html.extract(page(own)) == f"Title\n{PROSE}"


def test_time_is_in_proportion_to_the_page():
    import time

    parts = ["</b>", "</div>", "</p>", "<li>x", "<hr>", "<td>y", "<p>z", "</i><b>", "<thead><td>", "<ul><li>"]
    for part in parts:
        for around in ("<div>" * 3000, "<b>" * 3000, "<i><p><b>" * 1000, ""):
            start = time.process_time()
            html.parse(around + part * (400_000 // len(part)))
            assert time.process_time() - start < 20


def plain_scores(root):
    """The points of every element, paragraph by paragraph."""
    score = {}

    def text(node, linked=None):
        if isinstance(node, str):
            return len(node.strip())
        return sum(text(c) for c in node.children if isinstance(c, str) or not c.dropped)

    def links(node):
        if isinstance(node, str):
            return 0
        return text(node) if node.tag == "a" else sum(links(c) for c in node.children if isinstance(c, str) or not c.dropped)

    def visit(node, above):
        score[id(node)] = score.get(id(node), 0) + html.HEAD_START.get(node.tag, 0)
        score[id(node)] += 25 if node.name and html.LIKELY.search(node.name) else 0
        direct = [c for c in node.children if isinstance(c, str) and c.strip()]
        if node.tag in html.PARAGRAPH_TAGS or (direct and node.tag in html.CONTAINERS):
            words = text(node) - links(node)
            if words > 0:
                points = 1 + sum(c.count(",") for c in node.children if isinstance(c, str)) + min(words / 100, 3)
                chain = [node, *above[::-1]] if node.tag in html.CONTAINERS else above[::-1]
                share = 1.0
                for depth, to in enumerate(chain[:5], 1):
                    if to.tag in html.CONTAINERS or depth <= 2:
                        score[id(to)] = score.get(id(to), 0) + points * share
                    share = 0.5 if depth == 1 else share / (depth * 1.5)
        for c in node.children:
            if not isinstance(c, str) and not c.dropped:
                visit(c, [*above, node])

    visit(root, [])
    return score


def test_scores_against_plain_ones():
    import random

    rng = random.Random(8)
    tags = ["div", "p", "a", "b", "section", "ul", "li", "td", "h2", "blockquote", "article", "nav"]
    for _ in range(150):
        text = "".join(
            rng.choice([f"<{t}>" if rng.random() < 0.8 else f"<{t} class='post'>", f"</{t}>", "word, ", "x" * 70])
            for t in rng.choices(tags, k=60)
        )
        root = html.parse(text)
        nodes = html._order(root)
        html._measure(nodes)
        want = plain_scores(root)
        assert all(abs(n.score - want[id(n)]) < 1e-9 for n in nodes)

from __future__ import annotations

from tableweave.llm import html_density as H

TEXT = "The first paragraph of the article has a number of words, and <b>some</b> are bold &amp; strong. " * 3
PAGE = f"""<!doctype html><html><head><title>t</title><style>.x{{}}</style></head><body><header class="top"><nav><a href=/>Home</a> <a href=/b>B</a></nav></header>
<div class="sidebar"><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>
<div id="content"><h1>Head &lt;line&gt;</h1><p>{TEXT}</p><script>var a = "<p>no</p>";</script><p>Second   paragraph
with&nbsp;space and <a href=x>a link</a>.</p><div class="advert">Buy now</div></div>
<div class="comments"><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><footer>Imprint</footer></body></html>"""


def test_article_without_what_surrounds_it():
    text = H.main_text(PAGE)
    plain = " ".join(TEXT.replace("<b>", "").replace("</b>", "").replace("&amp;", "&").split())
    assert text == f"Head <line> {plain} Second paragraph with space and a link."


def test_sibling_sections_without_article_or_main():
    links = "<ul>" + "".join(f"<li><a href={k}>link number {k}</a>" for k in range(20)) + "</ul>"
    section = lambda k, n: f"<div class=section><h2>Part {k}</h2>" + f"<p>{TEXT}</p>" * n + "</div>"
    sections = [section(k, n) for k, n in enumerate((5, 2, 4))]
    for wrap in ("<div id=content>{}</div>", "<div><div id=content>{}</div></div>", "{}"):
        text = H.main_text(f"<body><div class=links>{links}</div>{wrap.format(''.join(sections))}<div class=more>{links}</div></body>")
        assert text.count("The first paragraph") == 33 and all(f"Part {k}" in text for k in range(3)) and "link number" not in text


def test_names_are_no_evidence_against_most_of_the_page():
    menu = "<div class=menu><ul>" + "<li><a href=x>some link</a>" * 20 + "</ul></div>"
    for name in ("layout has-sidebar", "social-policy", "notice", "post promoted", "related-work"):
        text = H.main_text(f'<body>{menu}<div class="{name}"><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div><div>Copyright</div></body>')
        assert text.count("The first paragraph") == 6 and "some link" not in text
        assert H.main_text(f'<body><div><h1>Head</h1><p>{TEXT}</p></div><div class="{name}"><p>{TEXT}</p></div></body>').count("The first paragraph") == 3


def test_broken_and_empty_pages():
    assert [H.main_text(x) for x in (None, "", "   ", "<div>", "<!-- c -->", "<script>x")] == [""] * 6
    assert H.main_text("just text") == "just text"
    assert H.main_text("<p>one<p>two<b>three</p>four") == "one twothree four"
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_densities_prefer_text_to_links():
    tree = H.Tree()
    tree.feed("<div><a>" + "link " * 50 + "</a></div><div>" + "text " * 50 + "</div>")
    tree.close()
    nodes = H.pruned(tree.root)
    H.set_densities(nodes)
    links, text = tree.root.children
    assert text.density > links.density and abs(tree.root.sum - links.density - text.density) < 1e-9


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, None), (2, "v", "<p>\U0001f600é</p>", "x", "y")], schema)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in H.extract_main_text(pages).collect()]
    assert len(got) == 4 and (2, "v", "\U0001f600é", 2) in got and (None, None, "", 0) in got
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_densities_and_choice_against_a_plain_recursion():
    import math
    import random

    def counts(n):
        c, t, lc, lt = 0, 0, 0, 0
        for x in n.children:
            if isinstance(x, str):
                c += len("".join(x.split()))
            else:
                a, b, d, e = counts(x)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
        return c, t, (c if n.tag == "a" else lc), lt

    def density(n, root):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        bc, _, blc, _ = counts(root)
        base = math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / (math.log(base) if base > 1 else 1.0)

    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href=x>{prose(2)}</a></li>" for _ in range(n)) + "</ul>"
    for _ in range(30):
        parts = ["".join(f"<p>{prose(r.randint(20, 60))}</p>" for _ in range(r.randint(3, 6))) for _ in range(r.randint(1, 3))]
        html = f"<body><div class=a>{links(8)}</div><div class=b>" + "".join(f"<div class=s>{x}</div>" for x in parts) + f"</div><div class=c>{links(6)}</div></body>"
        tree = H.Tree()
        tree.feed(html)
        nodes = H.pruned(tree.root)
        H.set_densities(nodes)
        for n in nodes:
            assert math.isclose(n.density, density(n, tree.root), abs_tol=1e-9)
            assert math.isclose(n.sum, sum(density(x, tree.root) for x in n.children if not isinstance(x, str)), abs_tol=1e-9)
        # all sections, whatever their number, and no list of links; there is no article tag to go by
        assert H.main_text(html) == " ".join(" ".join(H.text_of(c) for c in H_nodes(x)) for x in parts)


def H_nodes(html):
    tree = H.Tree()
    tree.feed(html)
    return tree.root.children


def test_lead_and_closing_lines_and_named_sections_stay():
    page = "<body><div><p>Lead sentence, short.</p><div><p>Body of some length, with a number of words.</p><p>More of it, also with words enough.</p></div><p>Final line.</p></div>"
    assert H.main_text(page) == "Lead sentence, short. Body of some length, with a number of words. More of it, also with words enough. Final line."
    for name in ("related-work", "notice-of-terms", "share-of-voice", "reply-times", "ad-hoc"):
        text = H.main_text(f'<article><h1>Head</h1><p>{TEXT}</p><div class="{name}"><h2>Part</h2><p>Of this there is less.</p></div></article>')
        assert text.endswith("Part Of this there is less.")


def test_random_pages_without_telling_names():
    """No class, id or tag says what a block is: densities, places and shapes alone tell."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    name = lambda: f'class="{word()}x {word()}y" id="{word()}z{r.randint(0, 99)}"'
    for _ in range(60):
        links = lambda n: f"<div {name()}><ul>" + "".join(f"<li><a href=x>{prose(2)}</a></li>" for _ in range(n)) + "</ul></div>"
        item = name()
        thread = f"<div {name()}>" + "".join(f"<div {item}><b>{word()}</b><p>{prose(r.randint(15, 60))}</p></div>" for _ in range(r.randint(3, 6))) + "</div>"
        lead, end, parts = prose(6), prose(5), [[prose(r.randint(25, 60)) for _ in range(r.randint(2, 5))] for _ in range(r.randint(1, 3))]
        sections = "".join(f"<div {name()}><h2>{word()}q</h2>" + "".join(f"<p>{x}</p>" for x in p) + "</div>" for p in parts)
        html = f"<body>{links(8)}<div {name()}><p>{lead}</p>{sections}<p>{end}</p></div>{thread}{links(5)}<div {name()}>{prose(4)}</div></body>"
        want = H.text_of(H_root(f"<p>{lead}</p>{sections}<p>{end}</p>"))
        assert H.main_text(html) == want


def H_root(html):
    tree = H.Tree()
    tree.feed(html)
    return tree.root


def test_very_long_page():
    page = "<body><nav><a href=x>home</a></nav><div>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(20_000)) + "</div></body>"
    assert H.main_text(page) == " ".join(f"Paragraph {k} of a very long page." for k in range(20_000))

from tidemark.llm import html

PAGES = [
    (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad -->'
        '<div class="ad">Buy this now, it is good.</div><article><h1>Head</h1><p><b>First &amp;amp; part, with text.<br><p>Second\n  part of&nbsp;it, longer than the first, with commas, and stops.</p></article><footer>&copy; us</footer></body></html>',
        "Head First &amp; part, with text. Second part of it, longer than the first, with commas, and stops.",
    ),
    (
        '<body><header class="site-header"><h1>Site</h1></header><div id="content"><h2>Title</h2><p>A para, with some words in it. And more, quite long as it is.</p><ul><li>one</li><li>two</li></ul><p>More, and more, to read here. It goes on.</p>'
        '<div class="comments"><p>I, for one, say: what a long and winding comment this is, you know.</p></div></div><aside><p>Side, with a lot of text, that goes on, and on, and on.</p></aside><form><p>Your mail, please.</p><input name=a></form></body>',
        "Title A para, with some words in it. And more, quite long as it is. one two More, and more, to read here. It goes on.",
    ),
    ("<p>Only, a paragraph.", "Only, a paragraph."),
    ("plain text, no tags", "plain text, no tags"),
    ("", ""),
    (None, ""),
    ("<nav>menu only</nav>", ""),
    ("<script>never closed <p>x</p>", ""),
    ("<p>a<!-- never closed <p>b", "a"),
    ("<article><p>one<b>bold</b>two</p></article>", "oneboldtwo"),
]


def test_main_text():
    for page, text in PAGES:
        assert html.main_text(page) == text


PROSE = "A para, with some words in it. And more, quite long as it is."
ASIDES = '<div class="sidebar"><p>Side, with text.</p></div><div class="comments"><p>I, for one, say: no.</p></div>'


def test_names_of_wrappers_around_the_article():
    inside = {
        "main": (f"<main><h1>Head</h1><p>{PROSE}</p></main>", f"Head {PROSE}"),
        "article": (f"<article><h2>Head</h2><p>{PROSE}</p></article>", f"Head {PROSE}"),
        "h1": (f"<h1>Head</h1><p>{PROSE}</p>", f"Head {PROSE}"),
        "text": (f"<p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
    }
    for name in ("site has-sidebar", "no-sidebar", "post with-comments", "hasSidebar", "search-results", "page-banner-layout", "widget", "site"):
        for body, text in inside.values():
            for tag in ("div", "section"):
                for attribute in ("class", "id"):
                    page = f'<body><nav>menu</nav><{tag} {attribute}="{name}"><div>{body}</div>{ASIDES}</{tag}><footer>us</footer></body>'
                    assert html.main_text(page) == text, page
                    assert html.main_text(f'<{tag} {attribute}="{name}"><div class="no-ads">{body}</div></{tag}>{ASIDES}') == text


def test_names_still_mark_what_is_beside_the_article():
    long = "I, for one, say: what a long and winding comment this is, you know. " * 9
    for name in ("comments", "comment-list", "comments-area", "sidebar", "related-posts", "ad-slot", "site-header"):
        for text in (f"<p>{long}</p>", f"<article><p>{long}</p></article>"):
            aside = f'<div class="{name}">{text}</div>'
            assert html.main_text(f"<body><article><h1>Head</h1><p>{PROSE}</p></article>{aside}</body>") == f"Head {PROSE}", name
            assert html.main_text(f'<body>{aside}<div class="has-sidebar"><main><h1>Head</h1><p>{PROSE}</p></main></div></body>') == f"Head {PROSE}", name
    for name in ("comments", "comment-list", "comments-area", "sidebar"):
        assert html.main_text(f'<article><h1>Head</h1><p>{PROSE}</p><div class="{name}"><p>{long}</p></div></article>') == f"Head {PROSE}", name
    assert html.main_text(f'<main><p>{PROSE}</p><div class="comments"><article><p>{long}</p></article></div></main>') == PROSE
    assert html.main_text(f'<body role="document"><div role="search"><p>{long}</p></div><p>{PROSE}</p></body>') == PROSE


def test_extract(spark):
    rows = [(k, None, p, "clash") for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "clash"), (None, "u", "<p>" + "long text, " * 50_000 + "</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(frame, ["page_id", "url"]).collect()
    assert len(found) == len(rows)
    assert [r["text"] for r in found][: len(PAGES)] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert found[-1]["n_chars"] == 11 * 50_000 - 1
    assert html.extract(frame.limit(0), ["page_id"]).collect() == []


def test_every_synthetic_page_gives_its_article(spark, sf_dir):
    import html as references
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html.extract(pages, ["page_id", "html"]).collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)
        if inside:
            text = references.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else "\n", inside[1]))
            assert r["text"] == " ".join(text.split()), r["page_id"]


def test_ratios_choose_where_no_name_does(monkeypatch):
    menu = "".join(f"<li><a href=x>word{k}</a></li>" for k in range(12))
    prose = f"<p>{PROSE}</p>" * 4
    for body in (f"<div><ul>{menu}</ul><div><h2>Head</h2>{prose}</div><table><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table></div>", f"<ul>{menu}</ul><h2>Head</h2>{prose}<ol>{menu}</ol>", f"<div><h2>Head</h2>{prose}<ul>{menu}</ul></div>"):
        page = f"<body>{body}</body>"
        assert html.main_text(page) == " ".join(["Head", *[PROSE] * 4])
        with monkeypatch.context() as patch:
            patch.setattr(html, "SHARE", 0.0)
            assert "word" in html.main_text(page)
    kept = f"<div>{prose}<ul><li>one</li><li>two</li></ul>{prose}</div>"
    assert html.main_text(kept) == " ".join([*[PROSE] * 4, "one two", *[PROSE] * 4])


def test_equal_paths_are_kept_or_left_together():
    page = f"<div><p>{PROSE}</p></div><div><p>{PROSE}</p></div>"
    assert html.main_text(page) == f"{PROSE} {PROSE}"


def test_long_broken_pages_take_linear_time():
    import time

    for piece in ("<script ", "<a ", '<p x="', "<div>", "<div></p>", "</div>", "<!--", "<p", '<a ">"', "<x><li>", "<", "&"):
        for tail in ("", ">", '">"'):
            began = time.time()
            html.main_text(piece * ((1 << 20) // len(piece)) + tail)
            assert time.time() - began < 20, piece
    began = time.time()
    html.main_text("<script " * (1 << 17))
    assert time.time() - began < 2

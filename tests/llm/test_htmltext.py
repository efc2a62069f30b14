import math
import random
import re
import time

import pytest

from quirefold.llm.htmltext import extract, main_text, smoothed, threshold

LONG = ["The first paragraph of the story is long enough to be told from menus, and it says what happened on that day in the town.",
        "A second one follows with more of the same: names, places, and a few numbers such as 12 and 1,400, so that it reads as prose.",
        "Short one.", "The third long paragraph ends the story, with an ending that nobody saw coming, least of all the reporter who wrote it down."]
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(9)) + "</ul>"


def story(tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in LONG)


WANT = "\n\n".join(["Headline", *LONG])
PAGES = {
    "article": f"<html><body><nav>{MENU}</nav><article><h1>Headline</h1>{story()}</article><footer>Imprint</footer></body></html>",
    "divs": f'<body><div id="top-nav">{MENU}</div><div class="wrap"><div class="story"><h1>Headline</h1>{story()}</div>'
            f'<div class="sidebar"><h3>More</h3>{MENU}</div></div><div class="footer">All rights</div></body>',
    "unmarked": f"<body><div>{MENU}</div><div><h1>Headline</h1>{story()}</div><div>{MENU}</div><table><tr><td>{MENU}</td></tr></table></body>",
    "comments": f'<main><h1>Headline</h1>{story()}<section id="comments"><article class="comment"><p>{LONG[0]} I agree!</p></article></section></main>',
    "notices": f'<body><div class="cookie-consent"><p>We use cookies on this page, please agree to all of them before you read on. {LONG[1]}</p></div>'
               f'<article><header><h1>Headline</h1></header>{story()}<aside><p>{LONG[3]}</p></aside><form><p>Subscribe {LONG[0]}</p><input></form></article></body>',
    "advert": f'<article><h1>Headline</h1><p>{LONG[0]}</p><div class="ad">Buy {LONG[1]}</div><p>{LONG[1]}</p><div class="share-bar">Share</div><p>{LONG[2]}</p><p>{LONG[3]}</p></article>',
    "script": f'<article><h1>Headline</h1><script>var x = "<p>no</p>";</script><style>p{{}}</style><!-- <p>no</p> -->{story()}<noscript>no</noscript></article>',
    "open paragraphs": "<article><h1>Headline</h1><p><b>" + "<br><p>".join(LONG) + "</article>",
    "attributes": f'<article><h1 title="a > b">Headline</h1><div data-x="<p>no</p>">{story()}</div></article>',
    "title apart": f"<body><div><h1>Headline</h1></div><div><div>{story()}</div></div></body>",
    "not closed": f"<body><nav>{MENU}</nav><article><h1>Headline</h1>{story()}<p",
    "entry header": f'<body class="no-sidebar"><div class="site-header">{MENU}</div><div class="post"><div class="post-header"><h1>Headline</h1></div>'
                    f'<div class="entry-content has-comments">{story()}</div></div><div id="comments"><p>{LONG[1]} Indeed, {LONG[0]}</p></div></body>',
    "named wrapper": f'<body><div class="nav-container page">{""}<div class="story"><h1>Headline</h1>{story()}</div></div></body>',
    "white space": "<article>\n <h1> Head<b>line</b>\n</h1>" + story().replace(" ", " \n\t") + "</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert main_text(PAGES[name]) == WANT


def test_references_and_rows():
    page = "<article><p>A &amp; B &lt;c&gt; &#233;&#x4e2d; &copy; &am &nosuch; 1&nbsp;2</p><table><tr><td>x</td><td>y</td></tr></table></article>"
    assert main_text(page) == "A & B <c> é中 © &am &nosuch; 1 2\n\nx y"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav>only a menu</nav>", "<script>x</script>", "<", "<!-- open", "<p"])
def test_pages_without_an_article(page):
    assert main_text(page) == ""


SLUGS = ["related-work", "search-algorithms", "comments-on-the-law", "social-history", "notice", "binary-search"]


@pytest.mark.parametrize("slug", SLUGS)
@pytest.mark.parametrize("around", ["article", "main", 'div class="story"'])
def test_sections_with_telling_slugs_stay(slug, around):
    body = f'<h1>Headline</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><h2 id="{slug}">Part</h2><p class="{slug}">{LONG[3]}</p>'
    body += f'<section id="{slug}"><h3 id="{slug}">In it</h3><p>{LONG[1]}</p><p>{LONG[0]}</p></section><div class="x {slug}">{story()}</div>'
    page = f"<body><nav>{MENU}</nav><div>{MENU}</div><{around}>{body}</{around.split()[0]}><div>{MENU}</div></body>"
    want = ["Headline", LONG[0], LONG[1], "Part", LONG[3], "In it", LONG[1], LONG[0], *LONG]
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("part", [f'<div class="related-posts">{MENU}</div>', f'<div class="post-share">{MENU}</div>', '<div id="comment-list"><p>I agree!</p></div>',
                                  f'<section class="ads">{LONG[0]}</section>', f'<div class="post comments"><p>{LONG[1]}</p></div>'])
@pytest.mark.parametrize("around", ["article", "main", 'div class="story"'])
def test_marked_surroundings_go(part, around):
    page = f"<body><div>{MENU}</div><{around}><h1>Headline</h1>{story()}{part}</{around.split()[0]}><div>{MENU}</div></body>"
    assert main_text(page) == WANT


MORE = [f"{x} And so on, as was told." for x in LONG]
TABLE = "".join(f"<tr><td>{x}</td></tr>" for x in [*LONG, *MORE, *LONG, *MORE])


@pytest.mark.parametrize("body", [
    f"<div><h1>Headline</h1>{story()}{story()}</div><div>{story()}</div>",
    f"<div><h1>Headline</h1>{story()}</div><p>Few.</p><div>{story()}{story()}</div>",
    f"<section><h1>Headline</h1>{story()}{story()}</section><section>{story()}</section>",
    f"<article><h1>Headline</h1>{story()}{story()}</article><article>{story()}</article>",
    f"<article><h1>Headline</h1>{story()}</article><article>{story()}{story()}<p>{LONG[2]}</p></article>",
    f"<main><h1>Headline</h1>{story()}<article>{story()}{story()}</article></main>",
    f"<h1>Headline</h1>{story()}<table>{TABLE}</table>{story()}",
    f'<h1>Headline</h1>{story()}{story()}<section id="social-history">{story()}</section>',
    f'<div><h1>Headline</h1>{story()}</div><div>{story()}</div><section id="social-history">{story()}</section>',
])
@pytest.mark.parametrize("page", ["<body>{}</body>", '<body><div>MENU</div><div class="page">{}</div><div>MENU</div></body>', "<body><nav>MENU</nav>{}<footer>Imprint</footer></body>"])
def test_stories_of_several_elements(body, page):
    want = [" ".join(x.split()) for x in re.split(r"<[^>]*>", body)]
    assert main_text(page.replace("MENU", MENU).format(body)) == "\n\n".join(x for x in want if x)


def test_formulas_stay():
    formula = '<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding="TeX">E=mc^2</annotation></semantics></math>'
    assert main_text(f"<article><p>{LONG[0]}</p><p>Then{formula}holds.</p><p>{LONG[1]}</p></article>") == f"{LONG[0]}\n\nThen E=mc2 holds.\n\n{LONG[1]}"


@pytest.mark.parametrize("section", ["<![ endif]-->", "<![RELEASE[1.2]]>", "<![endif]-->", "<![if !IE]>", "<![>", "<![ >", "<![CDATA[no]]>", "<![cdata>"])
def test_marked_sections(section):
    assert main_text(f"<p>a</p>{section}<p>b</p>") == "a\n\nb"
    assert main_text(f"<p>a</p>{section}<p>b</p><![endif]>") == "a\n\nb"
    assert main_text("<p>a</p>" + " " * (65536 - 10) + f"{section}<p>b</p>") == "a\n\nb"  # across two chunks


def test_plain_text_and_long_pages():
    assert main_text("just text") == "just text"
    many = "<article>" + "".join(f"<p>{LONG[k % 4]} {k}</p>" for k in range(4000)) + "</article>"
    assert main_text(many).count("\n\n") == 3999
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 5.0)), 5)
    values = np.array([1.0, 2, 1, 90, 80, 100, 2])
    assert 2 < threshold(values) < 80 and threshold(np.array([50.0, 55, 60])) == 0


def test_every_row_has_a_result(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, tags string"
    rows = [(k, None if k % 3 else f"u{k}", h, "t", "n", "g") for k, h in enumerate([None, "", *PAGES.values()])]
    rows += [rows[4], (None, None, None, None, None, None), (5, "other", "<p>x</p>", "", "", "")]
    found = extract(spark.createDataFrame(rows, schema)).collect()
    want = sorted(((r[0], r[1], main_text(r[2])) for r in rows), key=str)
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in found), key=str) == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_articles_of_the_generated_pages(spark):
    """On pages with an article element the text is that element's, by a plain regular expression."""
    import html

    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = row["html"]
        body = re.sub(r"<[^>]*$", "", page[page.index("<article>") + 9:].split("</article>")[0])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert main_text(page) == "\n\n".join(x for x in blocks if x)


@pytest.mark.parametrize("page, size", [
    ("<div>some text " * 70_000, 70_000 * 9), ("<table>" + "<tr><td>some cell " * 60_000, 60_000 * 9), ("<div class=related>x" * 20_000, 19_999),
    ("<div>" * 20_000 + "x</foo>" * 20_000, 20_000), ("<li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, 19_999), ("<p>" * 200_000 + "end", 3),
])
def test_unclosed_and_deep_pages_are_read_in_seconds(page, size):
    began = time.process_time()
    assert len(main_text(page)) >= size
    assert time.process_time() - began < 15


def test_missing_end_tags_of_tables_change_nothing():
    rows = "".join(f"<tr><td>{x}</td><td><b>{k}</b></td></tr>" for k, x in enumerate(LONG * 3))
    whole = f"<body><div>{MENU}</div><table><thead><tr><th>What</th><th>No.</th></tr></thead><tbody>{rows}</tbody></table></body>"
    bare = whole
    for tag in ("tr", "td", "th", "thead", "tbody"):
        bare = bare.replace(f"</{tag}>", "")
    assert main_text(bare) == main_text(whole) and f"{LONG[0]} 0" in main_text(whole)


@pytest.mark.parametrize("size", [20, 99, 101, 400])
def test_wrappers_with_telling_names_at_any_length(size):
    """Whether a wrapper's name counts follows from where the content lies, not from how long it is."""
    text = ("It was told again and again that the harbour had been closed. " * 9)[:size].strip()
    page = f'<body><nav>{MENU}</nav><div class="widgets"><div><p>{text}</p></div></div></body>'
    assert main_text(page) == text
    beside = f'<body><nav>{MENU}</nav><article><p>{text}</p></article><div class="widgets"><p>{LONG[0]}</p><p>{LONG[1]}</p></div></body>'
    assert main_text(beside) == text


@pytest.mark.parametrize("part", [f'<div class="cc-window"><p>{LONG[1]}</p></div>', f'<section class="responses"><p>{LONG[0]} I agree!</p></section>',
                                  f'<div id="discussion"><p>{LONG[0]} So do I!</p></div>'])
def test_notices_and_comments_by_more_names(part):
    assert main_text(f"<body><div>{MENU}</div><article><h1>Headline</h1>{story()}</article>{part}</body>") == WANT


def random_page(rng):
    """A well-formed page of nested blocks without telling names."""
    words = "harbour boat rain night told again closed work ashore paper number word".split()

    def block(depth):
        kind = rng.choice(["p", "p", "div", "section", "article", "li"] if depth < 4 else ["p"])
        if kind in ("p", "li"):
            n = rng.choice([1, 2, 8, 30, 60])
            inner = " ".join(rng.choice(words) if rng.random() > 0.1 else f"<b>{rng.choice(words)}</b>" for _ in range(n))
            return f"<ul><li>{inner}</li></ul>" if kind == "li" else f"<p>{inner}</p>"
        return f"<{kind}>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randrange(1, 6))) + "</body></html>"


def plain_main_text(page):
    """The method by explicit paths and loops: lines, ratios, Gaussian, two clusters, region."""
    lines, path, kinds, text, tags = [], (), {}, "", 0
    for piece in re.findall(r"<[^>]+>|[^<]+", page):
        if not piece.startswith("<"):
            text += piece
            continue
        tags += 1
        name = piece.strip("</>")
        if name == "b":
            continue
        if text.strip():
            lines.append((" ".join(text.split()), tags, path))
            tags = 0
        text = ""
        if name in ("html", "body", "div", "section", "article"):
            if piece.startswith("</"):
                path = path[:-1]
            else:
                path = (*path, len(kinds))
                kinds[len(kinds)] = name
    ratios = [len(t) / n for t, n, _ in lines]
    weight = lambda d: math.exp(-0.5 * (d / 1.5) ** 2)
    near = lambda i: [j for j in range(len(lines)) if abs(i - j) <= 4]
    smooth = [sum(ratios[j] * weight(i - j) for j in near(i)) / sum(weight(i - j) for j in near(i)) for i in range(len(lines))]
    logs = [math.log1p(x) for x in smooth]
    low, high, cut = min(logs), max(logs), 0.0
    if high - low >= 0.7:
        for _ in range(20):
            upper = [x for x in logs if x >= (low + high) / 2]
            lower = [x for x in logs if x < (low + high) / 2]
            low, high = sum(lower) / len(lower), sum(upper) / len(upper)
        cut = math.expm1((low + high) / 2)
    content = [k for k in range(len(lines)) if smooth[k] >= cut]
    held = lambda n, ks: sum(len(lines[k][0]) for k in ks if n in lines[k][2])
    most = 0.6 * sum(len(lines[k][0]) for k in content)
    named = [n for n, kind in kinds.items() if kind == "article" and held(n, content) >= most]
    holder = max(named or [n for n in kinds if held(n, content) >= most])
    ends = [k for k in content if ratios[k] >= cut] or content
    articles = {n for n, kind in kinds.items() if kind == "article"}
    inside = [k for k in ends if articles & set(lines[k][2])]
    if sum(len(lines[k][0]) for k in inside) >= 0.6 * sum(len(lines[k][0]) for k in ends):
        ends = inside or ends
    stories = {max(articles & set(lines[k][2])) for k in ends if articles & set(lines[k][2])} | {holder}
    depth = 0
    while all(len(lines[k][2]) > depth and lines[k][2][depth] == lines[ends[0]][2][depth] for k in ends):
        depth += 1
    part = lambda k: lines[k][2][:depth + 1]
    within = [k for k in range(len(lines)) if lines[k][2][:depth] == lines[ends[0]][2][:depth]]
    begin = min(k for k in within if k == ends[0] or (len(part(k)) > depth and part(k) == part(ends[0])))
    end = max(k for k in within if k == ends[-1] or (len(part(k)) > depth and part(k) == part(ends[-1])))
    return "\n\n".join(t for k, (t, _, p) in enumerate(lines) if (k in within and begin <= k <= end) or stories & set(p))


def test_random_pages_against_plain_paths():
    sizes = set()
    for seed in range(400):
        page = random_page(random.Random(seed))
        want = plain_main_text(page)
        assert main_text(page) == want, page
        sizes.add(len(want) * 10 // len(re.sub(r"<[^>]*>", "", page)))
    assert len(sizes) > 4

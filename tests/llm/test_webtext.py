import random
import re
import time

import pytest

from lorekeep.llm import queries, webtext
from lorekeep.llm.webtext import main_text

LONG = "This sentence of an article is long enough to be taken for one, whatever stands around it."


def test_table_equals_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op2_line_blocks(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        page = pages[r.page_id]
        inside = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        want = [" ".join(re.sub("<[^>]*>", "", re.sub("<br>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert r.url == page.url and r.n_chars == len(r.text)
        if "&" not in inside:
            assert r.text == "\n\n".join(w for w in want if w)


def test_parts_that_are_no_article():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style><script>if (a < b) x = "<p>{LONG}</p>";</script></head><body class="home has-sidebar"><header><p>{LONG}</p></header>
    <nav><ul><li><a href="/">{LONG}</a></li></ul></nav><div class="cookie-notice">{LONG}</div><div id="content"><h2>Head</h2><p>{LONG}</p><p class=advert>{LONG}<p>Short &amp; sweet.</p><p>A&nbsp;b
    <br> c</p><form><p>{LONG}</p></form><!-- <p>{LONG}</p> --><p>{LONG}</p></div><aside>{LONG}</aside><section id="comments"><h3>2 comments</h3><p>{LONG}</p></section><footer>{LONG}</footer></body></html>"""
    assert main_text(page) == f"Head\n\n{LONG}\n\nShort & sweet.\n\nA b c\n\n{LONG}"


def test_article_bounds_the_text():
    assert main_text(f"<p>{LONG}</p><article><h1>T</h1><p>x</p><aside>y</aside><p>z</p></article><p>{LONG}</p>") == "T\n\nx\n\nz"
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text(f"<nav><p>never closed<article><p>{LONG}</p></article>") == LONG


def test_surges_and_dives():
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "About"))
    assert main_text(f"{menu}<div></div><nav></nav><p>{LONG}</p><p>end</p>") == f"{LONG}\n\nend"
    assert main_text("<div>Home</div><div>News</div>") == "" == main_text("") == main_text("<nav>x</nav>")
    links = "".join(f'<li><a href="/">{LONG}</a></li>' for _ in range(4))
    assert main_text(f"<ul>{links}</ul>") == ""  # text of links doesn't count


def test_names_around_everything():
    body = "".join(f"<p>{LONG}</p>" for _ in range(9))
    assert main_text(f'<div class="widget">{body}</div>').count(LONG) == 9
    assert main_text(f'<div class="comments">{LONG}</div>') == ""


def test_references_and_odd_markup():
    assert main_text(f"<article><p>&lt;b&gt; &eacute; &#8212; &#x41; &unknown; a<b>c</b>d 1 < 2 {LONG}</p></article>") == f"<b> é — A &unknown; acd 1 < 2 {LONG}"
    assert main_text(f"<article><p title='a > b'>{LONG}</p></article>") == LONG
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) == 20_000 * (len(LONG) + 2) - 2


def test_edge_cases(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", f"<article>{LONG}</article>"), (2, "u", f"<article>{LONG}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in webtext.extract(df).collect()) == [(0, "", 0), (1, "", 0), (2, LONG, len(LONG)), (2, LONG, len(LONG))]
    assert webtext.extract(df.limit(0)).collect() == []


def test_loose_names_around_an_article():
    assert main_text(f'<div class="widget"><p>{LONG}</p></div>') == LONG
    assert main_text(f'<div class="content-header-fixed"><h1>T</h1><p>{LONG}</p></div>') == f"T\n\n{LONG}"
    body = "".join(f"<p>{LONG}</p>" for _ in range(50))
    page = f'<p>A teaser outside that is long enough to be kept</p><div class="content sidebar-left">{body}<div class="sidebar">{LONG}</div><div class="comments-area">{body}</div></div>'
    assert main_text(page).count(LONG) == 50
    assert main_text(f'<div>{body}</div><div class="widget">{LONG}</div><div class="site-footer">{LONG}</div>').count(LONG) == 50
    assert main_text(f'<div><p>{LONG}</p></div><div class="comments-area">{body}</div>') == LONG


def test_short_blocks_beside_the_article():
    assert main_text(f"<body><div><h1>Title</h1><nav>x</nav><div><p>{LONG}</p></div><nav>x</nav><p>The end.</p></div></body>") == f"Title\n\n{LONG}\n\nThe end."
    assert main_text(f"<div>Home</div><nav>x</nav><div><p>{LONG}</p></div><nav>x</nav><div><a href=/>{LONG}</a></div>") == LONG


def test_distribution_decides_between_articles():
    """Several article elements: those with a surge of text outside links are kept whole, cards that link elsewhere are not."""
    card = "".join(f"<article><h3><a href=/{i}>{LONG}</a></h3><p>Short {i}</p></article>" for i in range(4))
    assert main_text(f"<body>{card}<article><h1>T</h1><div><p>x</p></div><nav>m</nav><p>{LONG}</p><nav>m</nav><div><p>z</p></div></article>{card}</body>") == f"T\n\nx\n\n{LONG}\n\nz"
    assert main_text(f"<article><p><a href=/>{LONG}</a></p></article>") == LONG
    assert main_text(f"<main><article><p>{LONG}</p></article><article><p>{LONG} 2</p></article></main>") == f"{LONG}\n\n{LONG} 2"


def test_no_length_switches():
    """However short or long a page is, the same rules hold."""
    for n in (1, 5, 7, 50):
        for name in ("content-sidebar", "comments-layout", "ad-free-story"):
            assert main_text(f'<div class="{name}">' + "".join(f"<div><p>{LONG}</p></div>" for _ in range(n)) + "</div>").count(LONG) == n, (name, n)
    assert main_text("<body><nav>Home</nav><div><p>Hi there.</p></div></body>") == "Hi there."


def plain_distribution(blocks):
    """Kept texts of a page of blocks (text or None for a part that is left out), by the definition of surges and dives."""
    rows = [x for b in blocks for x in ([""] * webtext.WINDOW if b is None else [b])]
    window = [sum(len(x) for x in rows[i : i + webtext.WINDOW]) for i in range(len(rows))]
    most = max(window, default=0)
    surge = webtext.SURGE if most >= webtext.SURGE else most
    return [x for i, x in enumerate(rows) if x and any(rows[j] and window[j] >= surge and all(window[j : i + 1]) for j in range(i + 1))]


@pytest.mark.parametrize("around", ["", "article", "main"])
def test_equals_a_plain_distribution(around):
    rng = random.Random(11)
    for _ in range(300):
        blocks = [None if rng.random() < 0.35 else "".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 8, 15, 39, 40, 41, 90]))) for _ in range(rng.randint(0, 14))]
        html = "".join("<nav><a>x</a></nav>" if b is None else f"<div><p>{b}</p></div>" for b in blocks)
        want = plain_distribution(blocks) if not around else [b for b in blocks if b]
        assert main_text(f"<body>{f'<{around}>' * bool(around)}{html}</body>") == "\n\n".join(want)


@pytest.mark.parametrize("bit", ['<a "x', "<a 'x", "<!", "<?", "<script 'x", "<a ", "<" + "a" * 40, "<div><nav>", "<div></table>", '<a "><b \'', "<!--", "<a b=\"'>\"' ", '<p class="', "</p ", "<svg>", "&#x", "<td><a>"])
def test_a_malformed_megabyte_takes_seconds(bit):
    began = time.perf_counter()
    main_text(bit * (1_000_000 // len(bit)))
    main_text(bit * (1_000_000 // len(bit)) + f"<article>{LONG}</article>")
    assert time.perf_counter() - began < 20


def test_tags_equal_a_plain_scan():
    """Every tag's end is the first > outside quotes, or the first of all where quotes don't close."""

    def plain(page):
        at = 0
        while (i := page.find("<", at)) >= 0:
            at = i + 1
            m = webtext.NAME.match(page, at)
            if not m:
                continue
            j, quote, end = m.end(), "", -1
            while j < len(page) and end < 0:
                c = page[j]
                if quote:
                    quote = "" if c == quote else quote
                elif c in "\"'":
                    quote = c
                elif c == ">":
                    end = j
                j += 1
            end = page.find(">", m.end()) if end < 0 else end
            if end >= 0:
                at = end + 1
                yield i, at, bool(m[1]), m[2].lower(), page[m.end() : end]

    rng = random.Random(4)
    for _ in range(3000):
        page = "".join(rng.choice(["<a", "<b ", "</a", ">", "\"", "'", " ", "x", "<", "=", "/"]) for _ in range(rng.randint(0, 25)))
        assert list(webtext.Tags(page)) == list(plain(page)), page

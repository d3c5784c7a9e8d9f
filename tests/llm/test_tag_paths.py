import pytest

from fleetlens.llm.tag_paths import main_text, with_main_text

LONG = "A sentence of the article, long enough to count. And one more, to be sure."
PARTS = {
    "menu": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport, weather</a></li></ul></nav>',
    "menu by class": '<div class="main-menu"><a href="/a">Home</a> <a href="/b">About us</a></div>',
    "header": "<header><p>The daily paper, since 1900. All the news.</p></header>",
    "footer": '<footer>&copy; example &middot; All of it, always, everywhere.</footer>',
    "sidebar": f'<div id="sidebar"><p>{LONG.replace("article", "sidebar")}</p></div>', "aside": f"<aside><p>{LONG}</p></aside>",
    "notice": '<div class="cookie-notice">We use cookies, as everybody does. Do you agree?</div>',
    "advert": '<div class="ad">Buy this, buy that, buy it now. It is cheap, it is good.</div>',
    "form": "<form><label>Your name, please</label><input name=n><textarea>Write here, now.</textarea></form>",
    "script": '<script>var t = "</p><p>not a text, no.</p>"; if (a < b) {}</script>', "style": "<style>p > a { margin: 0 }</style>",
    "comments": f'<section id="comments"><h3>Comments</h3><p>{LONG} I agree.</p></section>',
}


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("part", PARTS)
def test_the_article_alone(part, article):
    tag = "article" if article else 'div class="post"'
    page = (
        f"<!DOCTYPE html><html><head><title>T</title></head><body>{PARTS[part]}<{tag}><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p>"
        f"<p>Second <b>part</b>:\n  {LONG}</p></{tag.split()[0]}>{PARTS[part]}</body></html>"
    )
    assert main_text(page) == f"Title & more\n{LONG}\nShort.\nSecond part: {LONG}"


def test_broken_markup():
    assert main_text(f"<article><h1>T</h1><p><b>Bold<br><p>{LONG}<p>Cut &am") == f"T\nBold\n{LONG}\nCut &am"
    assert main_text(f"<article><p>{LONG}</p><!-- never closed <p>no</p>") == LONG
    assert main_text(f"<article><p>{LONG}</p><a href='x") == LONG
    assert main_text(f"<p>{LONG}</p></div></b></p>") == LONG


def test_white_space_and_references():
    assert main_text("<article><p>  a \n\t b&nbsp;&lt;c&gt; &#233;&eacute;<br>d </p>\n<p>\n</p><ul><li>x<li>y</ul></article>") == "a b <c> éé d\nx\ny"


@pytest.mark.parametrize("page", [None, "", " \n", "<html></html>", "<script>x</script>", "<nav>only a menu</nav>"])
def test_no_text(page):
    assert main_text(page) == ""


def test_plain_text_and_long_pages():
    assert main_text("plain words") == "plain words"
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n") == 19_999


ITEMS = [f"Item {i}: {LONG} {LONG}" for i in range(4)]
LIST = "<ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>"


def test_all_content_paths_count():
    assert main_text(f"<body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p>{LIST}</div></body>").split("\n") == ["T", LONG, LONG, *ITEMS]
    assert main_text(f"<div><h1>T</h1><p>{LONG}</p><section><p>{LONG}</p><p>{LONG}</p></section></div>").split("\n") == ["T", LONG, LONG, LONG]
    cells = "".join(f"<tr><td>{x}</td></tr>" for x in ITEMS)
    assert main_text(f"<div><p>{LONG}</p><table>{cells}</table></div>").split("\n") == [LONG, *ITEMS]
    assert main_text(f"<body><h1>T</h1><div><p>{LONG}</p></div></body>") == f"T\n{LONG}"


@pytest.mark.parametrize("inner", ["article", "main", "div"])
@pytest.mark.parametrize("wrapper", [
    'div class="has-sidebar"', 'div class="page-header"', 'div id="x" class="wide comments-open"', 'div aria-hidden="false"', 'div title="the hidden valley"',
    'div data-id="related"', 'div data-class="menu"', "form", 'div id="sidebar-layout"', 'div class="widget"', "fieldset",
])
def test_a_marked_wrapper_is_the_page(wrapper, inner):
    page = f"<body><nav><a href=/>Home</a></nav><{wrapper}><div class='ad'>Buy it.</div><{inner}><h1>T</h1><p>{LONG}</p></{inner}></{wrapper.split()[0]}></body>"
    assert main_text(page) == f"T\n{LONG}"


def test_a_part_stays_a_part():
    """Long ones too, where the article is outside."""
    for part in (f'<div class="ad">{LONG * 9}</div>', f"<form>{LONG * 9}</form>", f'<section id="comments"><article>{LONG * 9}</article></section>', f"<p hidden>{LONG * 9}"):
        assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p></article>{part}</body>") == f"T\n{LONG}"
    assert main_text(f'<div><p>{LONG}</p></div><div class="comments"><article>{LONG * 9}</article></div>') == LONG
    assert main_text(f'<article><p>{LONG}</p><p class="cookie-notice">{LONG}</p><p aria-hidden=true>{LONG}</p></article>') == LONG


def test_a_head_without_end():
    for start in ("<body>", "", "<div>"):
        assert main_text(f"<html><head><meta charset=utf-8><title>T</title><style>p {{}}</style>{start}<p>{LONG}</p>") == LONG
    assert main_text(f"<head><title>T</title>{LONG}") == LONG


def test_all_articles_count():
    parts = "".join(f"<article><h2>{i}</h2><p>{LONG}</p></article>" for i in range(3))
    want = [x for i in range(3) for x in (str(i), LONG)]
    assert main_text(f"<body>{parts}</body>").split("\n") == want
    assert main_text(f"<main><h1>T</h1>{parts}</main>").split("\n") == ["T", *want]
    assert main_text(f"<article><p>Small.</p></article><div><p>{LONG}</p>{LIST}</div>").split("\n") == ["Small.", LONG, *ITEMS]


def test_the_threshold_decides_in_an_article():
    text = "".join(f"<p>{LONG}</p>" for _ in range(4))
    prompt = "<div>" + "".join(f"<div><span>{word}</span></div>" for word in "Like Send Print Save Tell Post".split()) + "</div>"
    for tag in ("article", "main"):
        assert main_text(f"<{tag}><h1>T</h1>{text}{prompt}{text}</{tag}>").split("\n") == ["T"] + [LONG] * 8
        assert main_text(f"<{tag}><h1>T</h1>{text}{prompt}<h2>U</h2>{text}</{tag}>").split("\n") == ["T"] + [LONG] * 4 + ["U"] + [LONG] * 4
    eggs = "".join(f"<li>{n} eggs</li>" for n in range(6))
    links = "".join(f"<li><a href=/{n}>{n}</a></li>" for n in range(6))
    assert main_text(f"<article>{text}<ul>{eggs}</ul>{text}<ul>{links}</ul></article>").split("\n") == [LONG] * 4 + [f"{n} eggs" for n in range(6)] + [LONG] * 4
    assert main_text(f"<article>{text}<p>See <a href=/x>this</a> <i>too</i></p></article>").split("\n") == [LONG] * 4 + ["See this too"]


def test_columns_and_nulls(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "old", 5), (None, None, None, None, None), (1, "u", f"<article><p>{LONG}</p></article>", "old", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = with_main_text(pages).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", LONG, len(LONG)), (None, None, "", 0), (1, "u", LONG, len(LONG))], key=str)
    assert with_main_text(pages.limit(0)).count() == 0


def test_registered_query_equals_a_plain_reading(spark):
    """The test pages hold one article element: its blocks, cut out with string functions."""
    import html
    import re

    from fleetlens.llm.queries import QUERIES

    def plain(page):
        inner = page.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(b for b in blocks if b)

    folder = "/root/testdata/sf0.001"
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op2_tag_paths"](spark, folder).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}

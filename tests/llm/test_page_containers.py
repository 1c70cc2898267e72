import pytest

from hindcast.llm import extraction

LONG = "A sentence of the article that says something at length. " * 8


def text_of(page):
    blocks = extraction.blocks_of(page)
    return extraction.text_under(blocks, extraction.best_path(blocks)[0])


@pytest.mark.parametrize("attributes", [
    'class="content has-sidebar"', 'class="wrapper no-sidebar"', 'class="post share-enabled"',
    'id="legal-news"', 'id="search-result-article"', 'class="legal"'])
def test_a_marked_element_that_is_the_article_stays(attributes):
    nav = "<nav><p>Home and other places</nav>"
    page = f"<html><body>{nav}<div {attributes}><p>{LONG}</p></div></body></html>"
    assert text_of(page) == LONG.strip()


def test_marked_elements_beside_the_article_go():
    marks = ["cookie-notice", "comments-area", "related-posts", "legal-news", "sidebar", "side-bar"]
    extra = "".join(f"<div class={m}><p>{m} text that goes on for a while</div>" for m in marks)
    page = f"<html><body><div class=text><p>{LONG}</p>{extra}</div></body></html>"
    assert text_of(page) == LONG.strip()
    longer = f"<div id=comments><p>{LONG}{LONG}{LONG}</div>"
    page = f"<html><body><div class=text><p>{LONG}</p>{longer}</div></body></html>"
    assert text_of(page) == LONG.strip()


def test_inline_marks_and_captions_are_text():
    page = ("<html><body><div><p>Type a <span class='search term'>word</span> here.</p>"
            "<figure><img><figcaption>A caption</figcaption></figure></div></body></html>")
    assert text_of(page) == "Type a word here. A caption"


TEMPLATE = ("<html><body><nav><a href=/>Home</a></nav><div class=page><h1>Title</h1>"
            "<div class=lead><p>What it is about.</div><div class=text><p>{}</div>"
            "<div class=links><a href=1>Other story</a> <a href=2>And another one</a></div></div>"
            "<div class=list><a href=3>An index of all stories of this site</a></div></body></html>")


def test_text_beside_the_main_block_is_kept(spark):
    rows = [(n, f"http://a.org/{n}", TEMPLATE.format(LONG).replace(
        "<div class=links>", "<div class=second><p>Afterword.</div><div class=links>"
    ).replace("<div class=links><a href=1>Other story</a> <a href=2>And another one</a></div>", ""))
        for n in range(4)]
    # Another template with a caption under the host's path.
    other = ("<html><body><div class=page><div class=text><p>Seen.</div></div>"
             f"<section><p>{LONG}</p><p>{LONG}</p></section></body></html>")
    rows.append((9, "http://a.org/9", other))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extraction.extract(df).collect()}
    for n in range(4):
        assert got[n]["text"] == f"Title What it is about. {LONG.strip()} Afterword."
        assert got[n]["path"] == "html body div.page"
    assert LONG.strip() in got[9]["text"]


def test_a_level_of_links_ends_the_widening():
    page = TEMPLATE.replace("<h1>Title</h1><div class=lead><p>What it is about.</div>", "")
    blocks = extraction.blocks_of(page.format(LONG))
    path, _ = extraction.best_path(blocks)
    assert extraction.main_path(blocks, None) == path == "html body div.page div.text"
    blocks = extraction.blocks_of("<h1>Title</h1><div>" + LONG + "</div>")
    assert extraction.text_under(blocks, extraction.main_path(blocks, None)).startswith("Title")


def test_a_caption_under_the_hosts_path_does_not_replace_the_article():
    page = ("<html><body><div class=page><div class=text><p>Seen.</div></div>"
            f"<section><p>{LONG}</p><p>{LONG}</p></section></body></html>")
    blocks = extraction.blocks_of(page)
    path = extraction.main_path(blocks, "html body div.page div.text")
    assert LONG.strip() in extraction.text_under(blocks, path)


def test_a_form_around_the_page_is_markup_and_one_in_it_is_not():
    menu = "<form id=find><label>Find</label> <input><p>Search all stories</p></form>"
    inner = f"<nav><p>Home</nav><div class=text><h1>Title</h1><p>{LONG}</p></div><footer>All</footer>"
    page = f"<html><body><form id=aspnetForm method=post>{inner}</form></body></html>"
    assert text_under(page) == f"Title {LONG.strip()}"
    page = f"<html><body><div class=text><h1>Title</h1><p>{LONG}</p>{menu}</div></body></html>"
    assert text_under(page) == f"Title {LONG.strip()}"
    page = f"<html><body><form>{inner}</form>{menu}</body></html>"
    assert text_under(page) == f"Title {LONG.strip()}"


def text_under(page):
    blocks = extraction.blocks_of(page)
    return extraction.text_under(blocks, extraction.main_path(blocks, None))


@pytest.mark.parametrize("attributes", [
    "class=user-comments", "class=responses", "id=comments", "class='box comments-area'",
    "class=reader_replies", "class=comments"])
def test_what_readers_wrote_goes_however_long_it_is(attributes):
    written = f"<div {attributes}>" + f"<div><p>{LONG}</p></div>" * 40 + "</div>"
    page = f"<html><body><article><h1>Title</h1><p>{LONG}</p>{written}</article></body></html>"
    assert text_under(page) == f"Title {LONG.strip()}"
    assert text_under(f"<html><body>{written}</body></html>") == ""


@pytest.mark.parametrize("attributes", ["class=has-comments", "class='post comments-open'"])
def test_flags_about_comments_drop_nothing(attributes):
    page = f"<html><body><div {attributes}><h1>Title</h1><p>{LONG}</p></div></body></html>"
    assert text_under(page) == f"Title {LONG.strip()}"


def test_hosts_without_article_elements_against_the_known_text(spark):
    """Every host has containers of its own names; what was put in is what comes out."""
    rows, want = [], {}
    for site in range(6):
        body, side = f"c{'abcdef'[site]}-main", f"c{'abcdef'[site]}-rail"
        for n in range(12):
            paragraphs = [f"Page {n} of site {site}, part {k}: {LONG[:60 + 40 * ((n + k) % 5)]}".strip()
                          for k in range(1 + n % 4)]
            rail = "".join(f"<li><a href={k}>Another story, number {k}, told elsewhere</a></li>"
                           for k in range(3 + 2 * n))
            text = "".join(f"<p>{p}</p>" for p in paragraphs)
            inner = (f"<header>Site {site}</header><div class={side}><ul>{rail}</ul></div>"
                     f"<div class={body}><h1>Title {n}</h1>{text}"
                     f"<div class=user-comments><p>{LONG}</p><p>{LONG}</p></div></div>")
            if site % 2:
                inner = f"<form method=post>{inner}<input></form>"
            page_id = 100 * site + n
            rows.append((page_id, f"http://s{site}.org/{n}", f"<html><body>{inner}</body></html>"))
            want[page_id] = " ".join([f"Title {n}", *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    assert got == want

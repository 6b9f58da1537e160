"""Article text beside the densest node of a page."""

import pytest

from vigil.llm import htmltext

ITEMS = [f"item {i} " + "abcd " * 14 + "end." for i in range(12)]
LIST = "<ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>"
LEAD = "A lead paragraph of some sixty characters that must be kept."


@pytest.mark.parametrize("form", ["<article>{}</article>", "<main><div>{}</div></main>", "{}", "<div>{}</div>", "<section>{}</section>"])
def test_heading_lead_and_list_are_kept(form):
    links = "<div><a href=/a>other page one</a> <a href=/b>other page two</a></div>"
    page = "<html><body>" + links + form.format(f"<h1>Heading of it</h1><p>{LEAD}</p>{LIST}") + "<nav>menu</nav></body></html>"
    assert htmltext.main_text(page).split("\n") == ["Heading of it", LEAD, *ITEMS]


def test_tables_sections_and_direct_text_are_kept():
    table = "<table>" + "".join(f"<tr><td>cell {i}</td><td>{'value ' * 5}</td></tr>" for i in range(4)) + "</table>"
    page = f"<body>Direct words before the list.{LIST}<section><h2>More</h2><p>{LEAD}</p></section>{table}</body>"
    got = htmltext.main_text(page).split("\n")
    assert got[0] == "Direct words before the list." and got[1:13] == ITEMS and got[13:15] == ["More", LEAD] and got[15] == "cell 0" and len(got) == 23


SIDE = "<div class='sidebar'><p>Side words that are no part of the article at all.</p></div>"


@pytest.mark.parametrize(
    "wrapper",
    ['<div style="overflow:hidden">', '<div class="content with-sidebar">', '<div class="post has-comments">', '<div id="platform-nav-page">', '<div data-state="hidden-no">', '<div class="header-layout">', '<div title="not hidden">', "<div class=sidebar-right-layout>"],
)
def test_wrappers_named_like_noise_keep_the_article(wrapper):
    page = f"<body><nav>menu</nav>{wrapper}<h1>Heading of it</h1><p>{LEAD}</p>{LIST}</div>{SIDE}<footer>foot</footer></body>"
    assert htmltext.main_text(page).split("\n") == ["Heading of it", LEAD, *ITEMS]


@pytest.mark.parametrize("noise", ['class="comments"', 'id="post-comments"', 'class="x sidebar y"', "hidden", 'style="display: none"', 'class="ad-slot"', 'role="complementary"', 'class="cookie-notice"', "class=site-nav"])
def test_named_noise_goes(noise):
    page = f"<body><div><h1>Heading of it</h1><p>{LEAD}</p>{LIST}</div><div {noise}><p>{LEAD}</p><p>{LEAD} Again.</p></div></body>"
    assert htmltext.main_text(page).split("\n") == ["Heading of it", LEAD, *ITEMS]


def test_long_comments_go_and_blocks_below_body_stay():
    comments = "<section class='comments'>" + "".join(f"<div class=comment><p>{x}</p></div>" for x in ITEMS * 3) + "</section>"
    page = f"<body><h1>Heading of it</h1><div><p>{LEAD}</p><p>{ITEMS[0]}</p></div><div><p>{ITEMS[1]}</p><p>{ITEMS[2]}</p></div>{comments}</body>"
    assert htmltext.main_text(page).split("\n") == ["Heading of it", LEAD, *ITEMS[:3]]


def test_an_empty_table_of_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


POST = "".join(f"<p>Paragraph {i} of the post tells what happened, and why, in some words.</p>" for i in range(3))
TALK = "".join(f"<div class='c'><p>Reader {i} says at some length that this is nonsense, or not, and goes on.</p></div>" for i in range(6))


@pytest.mark.parametrize(
    ("html", "has", "lacks"),
    [
        (f"<body><form id='aspnetForm' action='x'><input type=hidden><div><h1>Title</h1>{POST}</div><button>Send</button></form></body>", ["Title", "Paragraph 2"], ["Send"]),
        (f"<body><form runat=server><div>{POST}</div></form></body>", ["Paragraph 0", "Paragraph 2"], []),
        (f"<body><div><h1>Title</h1>{POST}</div><form><label>Your name</label><fieldset>Pick one</fieldset></form></body>", ["Title", "Paragraph 1"], ["Your name", "Pick"]),
        (f'<body><div class="post"><h1>Title</h1><p>The short post itself.</p></div><div class="thread">{TALK}</div></body>', ["Title", "The short post"], ["nonsense"]),
        (f'<body><div class="post"><h1>Title</h1>{POST}</div><div class="zone">{TALK}</div></body>', ["Title", "Paragraph 0", "Paragraph 2"], []),
        (f'<body><div><h1>Title</h1>{POST}</div><section class="user-reviews">{TALK}</section></body>', ["Title", "Paragraph 1"], ["nonsense"]),
        (f'<body><article><h1>Title</h1><p title="x>Broken attribute</p>{POST}</article></body>', ["Title", "Broken attribute", "Paragraph 1"], ["<p", "title="]),
        (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{POST}<footer>Foot</footer></article></body>", ["Title", "Paragraph 1"], ["Site", "Foot"]),
        (f"<body><div class=top><h1>Site</h1><div>A line about it, which is not long at all.</div></div><div class=text>{POST * 9}</div></body>", ["Paragraph 1"], []),
    ],
)
def test_shapes(html, has, lacks):
    text = htmltext.main_text(html)
    assert all(x in text for x in has) and not any(x in text for x in lacks), text


def test_deep_and_unclosed_markup():
    assert "Paragraph 2" in htmltext.main_text("<div>" * 3000 + POST)
    assert "Paragraph 2" in htmltext.main_text(f"<body><div><article><h1>T</h1><b><i>{POST}")


def test_repeated_rows(spark):
    from vigil.llm.shared import shipped

    rows = shipped(spark).createDataFrame([(1, f"<article>{POST}</article>")] * 3 + [(2, None)], "page_id long, html string")
    assert [r.n for r in htmltext.extract(rows).groupBy("page_id", "text").count().withColumnRenamed("count", "n").orderBy("page_id").collect()] == [3, 1]

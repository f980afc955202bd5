import re

import pytest

from corpusloom.llm import page_text as pt

MENU = '<nav><ul><li><a href="/a">Menu</a></ul></nav>'


def page(body, host=""):
    return f'<!DOCTYPE html><html lang=en><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar">{body}'


@pytest.mark.parametrize("body,want", [
    (f"{MENU}<!-- ad --><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>One\n two<br>three<p><b>Four</article><footer>&copy;</footer></body></html>", "A & B\nOne two three\nFour"),
    ("<header><p>Top</p></header><main><p>x<aside>side</aside>y</p><form>f</form><div id='comments'>bad</div><p>z &lt;b&gt; &am</main>", "x\ny\nz <b> &am"),
    ("<article><div class='cookie-notice'>c</div><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><pre> q  r </pre></article>", "1\n2\na\nb\nq r"),
    ("<article>cut off <p>here &am", "cut off\nhere &am"),
    ("<article><p>a<script>1</script>b<style>c</style> <i>d</i>e</p><!-- <p>no</p> --></article>", "ab de"),
    ("<article><p>a &nbsp; b&#233;&eacute;</p><article class=comment><p>reader</p></article></article>", "a béé"),
    (f"{MENU}<div class=body-text><p>most of the text is here, long enough</p><p>and here</p></div><div>few</div>", "most of the text is here, long enough\nand here"),
    ("", ""),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
])
def test_single_pages(body, want):
    whole = page(body)
    assert pt.main_text(whole, pt.own_slots(pt.tokens_of(whole))) == want


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div id="header-page">', '<div class="social-site"><div class="widget">', "<form>"])
def test_wrappers_do_not_drop_the_article(spark, wrapper):
    side = "<div class=sidebar><p>other things</p></div><div id=comments><p>" + "a reader's words " * 50 + "</p></div>"
    rows = [(k, "http://a.org/", page(f"{wrapper}{MENU}<article><h1>Head {k}</h1><p>Body {k}</p></article>{side}")) for k in range(3)]
    rows += [(10 + k, "http://b.org/", page(f"{wrapper}{MENU}<div class=text><p>{f'Body {k} ' * 30}</p></div><div class=sidebar>other</div>")) for k in range(3)]
    got = {r.page_id: r.text for r in pt.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k}\nBody {k}" for k in range(3)} | {10 + k: (f"Body {k} " * 30).strip() for k in range(3)}
    # an article outside keeps what is named otherwise dropped
    whole = page(f"<article>x</article>{wrapper}<article><p>{'teaser ' * 20}</p></article>")
    assert pt.main_text(whole, pt.own_slots(pt.tokens_of(whole))) == "x"


def frame(k, text, extra=""):
    return page(f"<div class=top>site {k}</div>{MENU}<div class=story-x><p>{text}</p><p>end {k}</p></div>{extra}<div class=end>long closing words of the site, long closing words of the site</div></body></html>")


def test_template_of_a_host(spark):
    rows = [(k, f"http://Site.org/{k}", frame(k, "words " * (30 + k))) for k in range(8)]
    # the site's template finds the story also where another part of the page is fuller
    rows.append((8, "http://site.org/8", frame(8, "short", "<div class=rare>" + "filler " * 400 + "</div>")))
    article = page(f"{MENU}<article><h1>H</h1><p>Body</article>")
    rows += [(20, "http://one.org/", article), (21, None, article), (21, None, article), (22, "odd", None), (23, "http://one.org/x", ""), (None, "http://one.org/", article)]
    rows.append((24, "http://deep.org/", page("<div>" * 3000 + "<article><p>deep</p></article>")))
    rows.append((25, "http://long.org/", page("<article>" + "<p>many words</p>" * 20000 + "</article>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("token", pt.F.lit("clash"))
    out = pt.main_texts(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    for k in range(9):
        assert got[k] == ("short" if k == 8 else "words " * (30 + k)).strip() + f"\nend {k}"
    assert got[20] == got[21] == got[None] == "H\nBody" and got[22] == got[23] == "" and got[24] == "deep"
    assert got[25] == "\n".join(["many words"] * 20000)
    assert pt.main_texts(df.limit(0)).count() == 0


def test_every_slot_with_text_that_differs(spark):
    def parts(k):
        return (f"<div class=headline><h1>Head {k}</h1></div><div class=slogan>The same slogan on all the pages of this site, at length.</div>"
                f"<div class=first><p>{f'First {k} ' * 9}</p><p>a <b>b{k}</b> c</p></div><div class=second><ul><li>{f'Item {k} ' * 5}<li>last</ul></div>")

    rows = [(k, f"http://a.org/{k}", page(parts(k))) for k in range(4)]
    # where no text differs, all that is not a small part
    rows += [(10 + k, "http://b.org/", page("<div class=one>the same</div><div class=two><p>the same everywhere</p></div>")) for k in range(3)]
    rows.append((20, "http://alone.org/", page("<div class=head><h1>Alone</h1></div><div class=text><p>" + "many words " * 20 + "</p></div><div>few</div>")))
    got = {r.page_id: r.text for r in pt.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == f"Head {k}\n{(f'First {k} ' * 9).strip()}\na b{k} c\n{(f'Item {k} ' * 5).strip()}\nlast"
    assert {got[10 + k] for k in range(3)} == {"the same\nthe same everywhere"}
    assert got[20] == "Alone\n" + ("many words " * 20).strip()


def test_given_pages_against_patterns(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in pt.main_texts(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\n\n", re.sub("<br>", " ", inner))).split("\n\n")
        assert got[row.page_id] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in parts) if x)


STAYS = [
    '<section class="related-work">kept words</section>', '<p class="alert alert-info">kept words</p>', '<p id="share-prices">kept words</p>',
    '<h2 id="search">kept words</h2>', '<blockquote class="reply">kept words</blockquote>', '<div id="social-history">kept words</div>',
    '<p>a <span class="tooltip menu-item">kept words</span></p>', "<p>x <math><mi>kept words</mi></math></p>",
]
GOES = [
    '<div class="comments">gone words</div>', '<ul class="share-buttons"><li>gone words</ul>', '<div class="ad">gone words</div>',
    '<div role="alert">gone words</div>', '<section class="comment-list"><p>gone words</section>', '<aside>gone words</aside>',
]


def test_what_an_article_holds_stays():
    for part in STAYS + GOES:
        page = f'<html><body><div class="menu">gone</div><article><p>one</p>{part}<p>two</p></article><div class="sidebar">gone</div></body></html>'
        found = pt._slot_text(pt.judged(page), pt.own_slots(pt.tokens_of(page)))
        assert ("kept words" in found) == (part in STAYS) and "gone" not in found and found.startswith("one\n") and found.endswith("two")


def test_a_host_with_several_layouts_and_a_common_line(spark):
    """What all pages share is not the article of any; a line far shorter than the host's fullest slot is frame."""
    rows, bodies = [], []
    for i in range(30):
        body = " ".join(f"word{i}x{k}" for k in range(60))
        layout = "abc"[i % 3]
        page = f'<html><body><div class="menu">Home</div><div class="dateline">Day {i}</div><div class="story-{layout}"><p>{body}</p></div></body></html>'
        rows.append((i, f"http://paper.example/{i}", page))
        bodies.append(body)
    found = pt.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == dict(enumerate(bodies))

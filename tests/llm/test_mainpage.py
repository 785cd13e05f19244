"""Main text of pages: hand-made pages with known articles, damaged markup, odd inputs."""
import html
import re

from colloquy.llm import mainpage

TREE = mainpage.train()


def test_tree_learns_its_table_and_splits_by_gini():
    assert all(mainpage.decide(TREE, row[:-1]) == bool(row[-1]) for row in mainpage.LABELLED)
    table = [(i, 0, 0, 0, 0, 0, 0, 0, int(i > 4)) for i in range(10)]
    tree = mainpage.train(table)
    assert (tree.feature, tree.threshold) == (0, 4.5) and not tree.low.verdict and tree.high.verdict
    assert mainpage.train([(1,) * 8 + (1,)] * 3).verdict


ARTICLE = ["A & B: a title", "By me", "First para with inline text and 3 < 4.", "Second line end.", "one point", "two points", "“Quoted” text · é"]
PAGE = """<!doctype html><head><title>T</title><style>p{a:b}</style><body class="has-sidebar"><header><h1>Site</h1><p>Slogan of the site</p></header>
<nav><a href=x>Home</a> <a href=y>News</a></nav><div class="cookie-notice">We use cookies to give you the best experience on this site and more.
<a>OK</a></div><main><article class='post'><header><h1>A &amp; B: a title</h1><p>By me</p></header><p>First para with <i>in</i>line&nbsp;text
and 3 < 4.<p>Second<br>line <!-- hid > den --> end<script>if(a<b)"</p>"</script>.<div class="ad">Buy now this thing please it is very good and cheap</div>
<aside><p>Related stuff is here for you and for all who read it to its end</p></aside><ul><li>one point<li>two points</ul>
<ul class=related><li><a href=1>More on this</a></ul><form><label>Mail</label><input name=q><button>Go</button></form>
<p>&ldquo;Quoted&#8221; text &middot; &eacute;</article><section id="comments"><h2>Comments</h2><p>I think that this article is really great and I liked
it a lot, thanks to the author of it.</p></section></main><div><p>Subscribe to us</p></div><footer>&copy; x</footer>"""


def test_article_without_furniture():
    assert mainpage.main_text(PAGE, TREE) == "\n\n".join(ARTICLE)
    assert mainpage.main_text(PAGE.replace("article", "div"), TREE) == "\n\n".join(ARTICLE)  # by class alone


def test_page_without_any_mark_is_read_by_length_and_links():
    long, longer = "word " * 40, "other " * 60
    page = f"<div><a href=1>Home</a></div><div><a href=2>About us</a></div><h2>The heading</h2><div>{long}</div><div>short one here</div><div>{longer}</div><div>copyright me</div>"
    assert mainpage.main_text(page, TREE) == "\n\n".join(["The heading", long.strip(), "short one here", longer.strip()])


def test_blocks_words_and_link_density():
    b = mainpage.text_blocks("<p>one <a>two three</a> four<p><a href='x>y'>all of it</a><div hidden>no</div><h2>Head</h2>")
    assert [(x.words, round(x.density), x.place, x.heading) for x in b] == [(4, 50, 0, False), (3, 100, 0, False), (1, 0, -1, False), (1, 0, 0, True)]


def test_damaged_markup_never_fails():
    for page in ("<", "<p", "<!--", "<script>", "</", "</p></div>", "<a href='x>y", "&", "&#x110000;&#0;", "<p title=don't>x</p>", "<!DOCTYPE", "<![CDATA[x", "<svg/><p>", "<" * 50):
        mainpage.main_text(page, TREE)
    assert mainpage.main_text("<article>cut <b>of", TREE) == "cut of"
    assert mainpage.main_text("<article><p>a</section></div><p>b</article>", TREE) == "a\n\nb"


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in mainpage.extract(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():  # the article element's text, by plain splitting
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in parts if x)
        r = rows[p["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (text, len(text), p["url"])


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, words long"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<article>tie</article>", "x", 1), (3, "u", "<article>tie</article>", "x", 1),
            (3, "u", "<article>tie</article>", "x", 1), (4, "u", "<article>" + "<p>long text here" * 60_000, "x", 1)]
    got = sorted(map(tuple, mainpage.extract(spark.createDataFrame(rows, schema)).collect()), key=repr)
    long = "\n\n".join(["long text here"] * 60_000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "tie", 3), (3, "u", "tie", 3), (3, "u", "tie", 3), (4, "u", long, len(long))], key=repr)
    assert mainpage.extract(spark.createDataFrame([], schema)).count() == 0

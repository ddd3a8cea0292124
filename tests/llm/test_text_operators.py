import hashlib
import html as entities
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from symbolake.llm import chat_format, html_extract, line_dedup, quality_rules
from symbolake.llm.html_extract import main_text


# ---- pages -------------------------------------------------------------------------


def test_template_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>)", p.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\n", body)))
        want = "\n".join(x for x in (" ".join(s.split()) for s in entities.unescape(body).split("\n")) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


PROSE = "A long enough sentence of plain prose, with commas, clauses, and words that go on for a good while."


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain text", "plain text"), ("a < b &amp; c", "a < b & c"), ("<p>x&nbsp;&#233;&eacute;</p>", "x éé"),
        (f"<div id=main><h2>T</h2><p>{PROSE}<p>{PROSE}</div><div class='comments'><p>{PROSE}</p></div>", f"T\n{PROSE}\n{PROSE}"),
        (f"<header><p>{PROSE}</p></header><main><p>{PROSE}</p></main><footer>{PROSE}</footer>", PROSE),
        (f"<div><p>{PROSE}</p><form><p>{PROSE}</p></form><div role=navigation><p>{PROSE}</p></div><p hidden>{PROSE}</p></div>", PROSE),
        (f"<article><p>a<b>b</b> c<br>d</p><ul><li>one<li>two</ul><p>{PROSE}</p></article>", f"ab c d\none\ntwo\n{PROSE}"),
        (f"<div class=sidebar><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p></div>", PROSE),
        (f"<script>if (a<b) document.write('<p>{PROSE}</p>')</script><style>p{{}}</style><!-- <p>no</p> --><p>{PROSE}</p>", PROSE),
        (f"<article><p>{PROSE}", PROSE), ("</p></div></article>", ""), ("<p>unclosed <i>x", "unclosed x"), ("<", "<"), ("<!-- open", ""),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<html><head><title>T</title><body><p>{PROSE}", PROSE), (f"<head><meta charset=utf-8><link rel=x><style>p{{}}</style><p>{PROSE}</p>", PROSE),
        (f"<html><head><title>T</title>\n<b>Bold</b> {PROSE}", f"Bold {PROSE}"), (f"<head><script>1</script>{PROSE}", PROSE),
        (f"<head><title>T</title><img src=x><article><p>{PROSE}</article>", PROSE), ("<html><head><title>T</title>\n</head><body></body></html>", ""),
    ],
)
def test_head_without_end_tag(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article>" + f"<div class='elementor-element elementor-widget elementor-widget-heading'><h2>T</h2></div><div class='elementor-element elementor-widget elementor-widget-text-editor'><p>{PROSE}</p></div>" * 3 + "</article>", "\n".join([f"T\n{PROSE}"] * 3)),
        (f"<div class='post comments-open'><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=x>Other</a></div>", f"{PROSE}\n{PROSE}"),
        (f"<main><div class='entry-content social-science'><p>{PROSE}</p></div><div class=social><p>{PROSE}</p></div><div class=x-share-this><a href=x>Share</a></div></main>", PROSE),
        (f"<article><p>{PROSE}</p><p>{PROSE}</p><div class='lab-notice-board'><p>{PROSE}</p></div></article>", f"{PROSE}\n{PROSE}\n{PROSE}"),
        (f"<div id=page class=sidebar-right><div><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div></div>", PROSE),
        (f"<div><p>{PROSE}</p></div><div class=comments-area><p>{PROSE}</p><p>{PROSE}</p></div><div class=cookie-banner><p>{PROSE}</p></div>", PROSE),
        (f"<nav>x</nav><div class=cookie-banner><p>{PROSE}</p></div>", ""),
        (f"<p>one <span class=social-science>two</span> three, {PROSE}</p>", f"one two three, {PROSE}"),
    ],
)
def test_names_agree_with_text(html, want):
    assert main_text(html) == want


LONG = "".join(f"<p>{PROSE}</p>" for _ in range(20))
LONG_TEXT = "\n".join([PROSE] * 20)


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div id=content><section>Short intro.</section><section>{LONG}</section></div>", f"Short intro.\n{LONG_TEXT}"),
        (f"<body><div id=content><h1>Head</h1><section><h2>In</h2><p>Short intro.</p></section><section><h2>B</h2>{LONG}</section><section><h2>C</h2><p>{PROSE}</p></section></div>", f"Head\nIn\nShort intro.\nB\n{LONG_TEXT}\nC\n{PROSE}"),
        (f"<div id=content><div><div>{LONG}</div><div><a href=x>{PROSE}</a></div></div><div><p>{PROSE}</p></div></div>", f"{LONG_TEXT}\n{PROSE}"),
        (f"<div id=content><div><div><p>{PROSE}</p></div></div><div><div>{LONG}</div></div><div><ul><li><a href=x>{PROSE}</a></ul></div></div>", f"{PROSE}\n{LONG_TEXT}"),
        (f"<body><section><p>Short intro.</p></section><section><div>{LONG}</div></section><div>Imprint</div><div><a href=x>Terms of use.</a></div>", f"Short intro.\n{LONG_TEXT}"),
        (f"<body><div><p>Intro text.</p></div><div>{LONG}</div><div class=sidebar><p>{PROSE}</p></div><div><a href=x>{PROSE}</a></div>", f"Intro text.\n{LONG_TEXT}"),
    ],
)
def test_sections_without_article(html, want):
    assert main_text(html) == want


def test_links_count_against_a_container():
    menu = "<div>" + "".join(f"<li><a href=x>{PROSE}</a></li>" for _ in range(9)) + "</div>"
    assert main_text(f"<body>{menu}<div><p>{PROSE}</p><p>{PROSE}</p></div></body>").count("A long") == 2


SHORT = "One more short section of the same article."


@pytest.mark.parametrize(
    "html, want",
    [
        # short articles and parts beside long ones, and no teasers of other pages
        (f"<main><article>{LONG}</article><article><p>{SHORT}</p></article></main>", f"{LONG_TEXT}\n{SHORT}"),
        (f"<main><article><h2>A</h2>{LONG}</article><div><p>{SHORT}</p></div></main>", f"A\n{LONG_TEXT}\n{SHORT}"),
        (f"<main><h1>Title</h1><article>{LONG}</article><article><h3><a href=x>Other page</a></h3><p>{SHORT}</p></article></main>", f"Title\n{LONG_TEXT}"),
        (f"<div><div>{LONG}</div><div><p>{SHORT}</p></div></div>", f"{LONG_TEXT}\n{SHORT}"),
        # attributes
        (f"<div><p data-x=it's>{PROSE}</p><p>It's fine, isn't it.</p></div>", f"{PROSE}\nIt's fine, isn't it."),
        (f'<div><p title="abc>{PROSE}</p><p class="x">{PROSE}</p></div>', f"{PROSE}\n{PROSE}"),
        (f'<div><p title="abc>{PROSE}</p></div>', PROSE), (f"<div><p title='a > b' data-y=\"<b>c</b>\">{PROSE}</p></div>", PROSE),
        (f"<div><p data-hidden=1 title='the class=ad role=banner'>{PROSE}</p><p data-class=sidebar>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
        (f"<div><p>{PROSE}</p><p cla", PROSE),
        # inline elements
        (f"<p>{PROSE} <span class=share>a<span>b</span>X</span>end</p>", f"{PROSE} end"), (f"<p>one, <button>Buy</button>two, {PROSE}</p>", f"one, two, {PROSE}"),
        (f"<div><p>{PROSE}<svg><svg><text>x</text></svg>y</svg></p><p>{PROSE}<select><option>1<option>2</select></p></div>", f"{PROSE}\n{PROSE}"),
        (f"<div><noscript><p>Turn on scripts, please, to see all of this page.</p></noscript><p>{PROSE}</p><title>T {PROSE}</div>", f"{PROSE}\nT {PROSE}"),
        # names that only look like parts
        *((f"<article><p>{PROSE}</p><div class='{x}'><p>{PROSE}</p></div><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}\n{PROSE}") for x in ("notice-of-meeting", "comment-analysis", "menu-items-recipe", "share-price")),
        (f"<article><p>{PROSE}</p><div class=share-price>12.30</div></article>", f"{PROSE}\n12.30"),
        (f"<div class='post social'><p>{PROSE}</p></div>", PROSE), ("<div class=social>Hello there</div>", "Hello there"), (f"<body><div class=menu><p>{PROSE}</p></div></body>", PROSE),
        *((f"<article><p>{PROSE}</p><div class='{x}'><p>{PROSE}</p></div></article>", PROSE) for x in ("user-comments", "recent-comments", "advert-box", "newsletter-signup", "ad-300x250", "comments-wrapper-2")),
        (f"<div id=content><h1>T</h1><div class=noprint>From a site</div><p>{PROSE}<sup>[1]</sup></p><h2><span id=H>H</span><span class=mw-editsection>[<a href=e>edit</a>]</span></h2><p>{PROSE}</p><div class=navbox><a href=x>A</a></div></div>", f"T\n{PROSE}[1]\nH\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class='sharedaddy sharing-enabled'><h3>Share this:</h3><a href=x>Somewhere</a></div></article>", PROSE),
        # links around blocks
        (f"<body><div>" + "".join(f"<a href=x{k}><div><p>{PROSE}</p></div></a>" for k in range(8)) + f"</div><div><p>{PROSE} Own.</p></div></body>", f"{PROSE} Own."),
        (f"<div><p><a href=x>{PROSE}</p><p>{PROSE}</p><p>{PROSE} 3.</p></div>", f"{PROSE}\n{PROSE}\n{PROSE} 3."), (f"<div><a name=top><p>{PROSE}</p></div>", PROSE),
    ],
)
def test_odd_markup_loses_nothing(html, want):
    assert main_text(html) == want


SAY = "Sailors found their way by stars, by the sun and by the colour of the sea around them."


@pytest.mark.parametrize(
    "html, want",
    [
        # a form around the page, and forms within it
        (f"<body><form action=x><article><h1>T</h1><p>{PROSE}</p></article></form></body>", f"T\n{PROSE}"),
        (f"<body><form id=page><div id=content><p>{PROSE}</p><p>{PROSE}</p></div></form></body>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><form><p>Your name:</p><input><button>Send</button></form></article>", PROSE),
        (f"<article><p>{PROSE}</p><fieldset><legend>Note</legend><p>{PROSE}</p></fieldset><fieldset><legend>Size</legend>S M L</fieldset></article>", f"{PROSE}\nNote\n{PROSE}"),
        ("<form><p>Name:</p></form>", ""),
        # several articles of one main, teasers, comments of readers
        (f"<main><div><article><p>{PROSE} A</p></article></div><div><article><p>{PROSE} B</p></article></div></main>", f"{PROSE} A\n{PROSE} B"),
        (f"<main><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><article><h2><a href=x>Other</a></h2><p>{PROSE}</p></article></main>", f"T\n{PROSE}\n{PROSE}\n{PROSE}"),
        (f"<article><h1>T</h1><p>{PROSE}</p><section><h2>Comments</h2><article><p>First! {PROSE}</p></article><article><p>Second, {PROSE}</p></article></section></article>", f"T\n{PROSE}"),
        (f"<article><h1>T</h1><p>{PROSE}</p><h2>2 comments</h2><article><p>First! {PROSE}</p></article><article><p>Second, {PROSE}</p></article></article>", f"T\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section><h2>Comments</h2><p>{SAY}</p></section></article>", f"{PROSE}\nComments\n{SAY}"),
        (f"<article><p>{PROSE}</p><div id=comments><h3>3 comments</h3><p>{PROSE}</p></div></article>", PROSE),
        # ids of headings and paragraphs, topics of sections
        (f"<article><h2 id=menu>The menu of the day</h2><p>{PROSE}</p><h2 id=related>Related work</h2><p>{PROSE}</p><h2 id=login>Login</h2></article>", f"The menu of the day\n{PROSE}\nRelated work\n{PROSE}\nLogin"),
        (f"<article><p>{PROSE}</p><p id=consent>{SAY}</p></article>", f"{PROSE}\n{SAY}"),
        (f"<article><p>{PROSE}</p><section id=navigation><h2>Navigation</h2><p>{SAY}</p></section></article>", f"{PROSE}\nNavigation\n{SAY}"),
        (f"<article><p>{PROSE}</p><section class=cookies><h2>Cookies</h2><p>{SAY}</p></section></article>", f"{PROSE}\nCookies\n{SAY}"),
        (f"<article><p>{PROSE}</p><section class=menu><ul><li><a href=x>One page</a><li><a href=y>Another page</a></ul></section></article>", PROSE),
        # inline parts of a sentence
        (f"<article><p>{PROSE}</p><p>Press <button>OK</button> to go on.</p><p><button>Buy</button></p></article>", f"{PROSE}\nPress OK to go on."),
        (f"<article><p>{PROSE} Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> be given.</p></article>", f"{PROSE} Let x=1 be given."),
    ],
)
def test_content_decides(html, want):
    assert main_text(html) == want


def test_deep_and_long_pages_are_linear():
    assert main_text("<div>" * 20_000 + f"<p>{PROSE}</p>") == PROSE
    big = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert main_text(big).count("\n") == 19_999


@pytest.mark.parametrize(
    "unit",
    ["<div>x, y ", "<div class=share>x, y ", "<span class=share>x ", "<p class=\"a", "<a href=x><div>x ", "</section><div>x", "<b><i></b>", "<li><blockquote>x", "<article>x, y <h2>Comments</h2>", "<form><fieldset>x ", "<p>x <button>y</button> z", "<title>", "<button></i>x", "<!-", "<p title='"],
)
def test_time_is_linear_in_any_nesting(unit):
    began = time.process_time()
    for _ in range(2):
        main_text(unit * 8_000)
    assert time.process_time() - began < 2


class Tree(HTMLParser):
    """A plain tree of well-formed pages: [name, parent, children or texts]."""

    def __init__(self, source):
        super().__init__()
        self.top = self.at = ["", None, []]
        self.feed(source)

    def handle_starttag(self, name, attrs):
        self.at[2].append([name, self.at, []])
        self.at = self.at[2][-1]

    def handle_endtag(self, name):
        assert self.at[0] == name
        self.at = self.at[1]

    def handle_data(self, data):
        if data.strip():
            self.at[2].append(data.strip())


def plain_score(node, linked=False):
    """(score, characters, characters in links) of a container by the definition, from its children up."""
    score = chars = links = 0
    for x in node[2]:
        if isinstance(x, str):
            text, heading, own = x, False, linked
        elif x[0] in ("p", "h2"):
            text, heading, own = "".join(y if isinstance(y, str) else y[2][0] for y in x[2]), x[0] == "h2", linked or any(y[0] == "a" for y in x[2] if not isinstance(y, str))
        else:
            s, c, n = plain_score(x, linked)
            score, chars, links = score + s / 2, chars + c, links + n
            continue
        score += 0.5 if heading else 1 + text.count(",") + min(len(text) // 100, 3)
        chars, links = chars + len(text), links + len(text) * own
    return score, chars, links


def test_scores_against_a_plain_tree():
    rnd = random.Random(6)

    def made(depth):
        out = []
        for _ in range(rnd.randint(1, 4)):
            if depth and rnd.random() < 0.5:
                out.append(f"<{(tag := rnd.choice(['div', 'section', 'ul']))}>{made(depth - 1)}</{tag}>")
            else:
                words = ", ".join("word" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 30)))
                out.append(rnd.choice([f"<p>{words}</p>", f"<h2>{words}</h2>", f"<p><a href=x>{words}</a></p>", f"<div>{words}</div>"]))
        return "".join(out)

    for _ in range(60):
        source = f"<body>{made(4)}</body>"
        page = html_extract.parse(source)
        want, todo = [], [Tree(source).top]
        while todo:
            node = todo.pop()
            if node[0] not in ("p", "h2"):
                want.append((node[0], *plain_score(node)))
                todo += reversed([x for x in node[2] if not isinstance(x, str) and x[0] != "a"])
        assert [(x.name, x.score, x.chars, x.links) for x in page.nodes if x.name not in ("p", "h2")] == want


def test_extract_odd(spark):
    kind = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 1), (None, "u", "<p>x</p>", 2), (2, "u", "<p>x</p>", 3), (2, "u", "<p>x</p>", 3)]
    got = html_extract.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, ""), (2, "x"), (2, "x")]
    assert html_extract.extract(spark.createDataFrame([], kind)).count() == 0


# ---- lines -------------------------------------------------------------------------


def test_line_dedup_against_plain_counts(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        host = "hot" if i % 3 == 0 else f"h{i % 5}" if i % 7 else None
        lines = [f"unique {i} {k}" for k in range(3)] + rnd.sample(["menu", "footer ", "rare"], rnd.randint(0, 2)) + ["menu"] * (i % 2)
        rows.append((i, host, "\n".join(lines) if i % 50 else None))
    pages = spark.createDataFrame(rows, "id long, host string, text string")
    got = line_dedup.drop_boilerplate(pages, "id", F.col("host"), F.col("text"), ratio=0.3, min_pages=3).collect()
    seen, total = defaultdict(set), Counter(h for _, h, _ in rows)
    for i, h, t in rows:
        for line in (t or "").split("\n"):
            seen[h, line.strip()].add(i)
    for r in got:
        i, h, t = rows[r.id]
        keep = lambda x, h=h: not x.strip() or not (len(seen[h, x.strip()]) >= 3 and len(seen[h, x.strip()]) > 0.3 * total[h])
        assert r.text == (None if t is None else "\n".join(x for x in t.split("\n") if keep(x)))
        n = [x for x in (t or "").split("\n") if x.strip()]
        assert (r.n_lines, r.n_dropped) == (len(n), sum(not keep(x) for x in n))


def test_line_dedup_is_linear_in_a_page(spark):
    """Two pages of n equal lines and one own line: all but the own lines go, in time that grows as n."""

    def took(n):
        line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
        pages = spark.range(2).select("id", F.lit("h").alias("host"), F.concat(line, F.lit("\nown "), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        got = line_dedup.drop_boilerplate(pages, "id", F.col("host"), F.col("text")).collect()
        assert sorted(tuple(r)[2:] for r in got) == [(f"own {i}", n + 1, n) for i in range(2)]
        return time.perf_counter() - began

    took(1000)
    small = took(62_500)
    assert took(500_000) < 12 * small + 10


def test_line_dedup_odd(spark):
    kind = "id long, host string, text string, line string, drop_ int, h string"
    rows = [(1, None, "a\n\na", None, 1, None), (1, None, "a", None, 1, None), (2, None, "", None, 1, None), (3, "x", None, None, 1, None), (None, None, "a", None, 1, None)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, kind), "id", F.col("host"), F.col("text"), ratio=0.5, min_pages=2).collect()
    assert sorted((r.id or 0, r.text, r.n_dropped) for r in got if r.text is not None) == [(0, "", 1), (1, "", 1), (1, "", 2), (2, "", 0)]
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], kind), "id", F.col("host"), F.col("text")).count() == 0


def test_small_hosts_by_their_ratio(spark):
    """Two pages share a line: a host of two or three loses it by default, as of any size up to 2 / RATIO; one page loses nothing."""
    for pages, gone in ((1, False), (2, True), (3, True), (39, True), (41, False)):
        rows = [(i, "h", f"own {i}\nshared" if i < 2 else f"own {i}") for i in range(pages)]
        got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, host string, text string"), "id", F.col("host"), F.col("text")).collect()
        assert {r.text for r in got if r.id < 2} == {f"own {i}" + ("" if gone else "\nshared") for i in range(min(2, pages))}


def test_tags_with_quoted_angles(spark):
    page = """<p title="a>b">T</p><p data-x='1 > 0' class=y>U <a href="x>y" id=z>v</a></p><p data-x=it's>don't</p>a < b, c > d<br/>""" + "<p " + 'a="1" ' * 20_000 + """>X</p><p title="open>W</p>"""
    assert spark.createDataFrame([(page,)], "h string").select(line_dedup.visible_lines(F.col("h"))).first()[0] == "T\nU v\ndon't\na < b, c > d\nX\nW"


def test_hosts_and_visible_lines(spark):
    rows = [("HTTP://User@WWW.Ex.org:80/a?b#c", "www.ex.org"), ("mailto:x", None), (None, None), ("https://a.b", "a.b")]
    df = spark.createDataFrame(rows, "url string, host string")
    assert df.where(~line_dedup.host_of(F.col("url")).eqNullSafe(F.col("host"))).count() == 0
    page = "<html><head><title>T</title><STYLE>x</STYLE></head><body><p>a <b>b</b>\n c</p><!-- z --><script>1<2</script><li>d</body>"
    assert spark.createDataFrame([(page,)], "h string").select(line_dedup.visible_lines(F.col("h"))).first()[0] == "T\na b c\nd"


# ---- quality rules -----------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, docs, odd_docs, no_docs):
    rnd = random.Random(2)
    made = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n", "\n x\n x"]), "en", "m", 1) for i in range(300)]
    for df in (docs, odd_docs, spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")):
        text = defaultdict(list)
        for r in df.collect():
            text[r.doc_id].append(plain_counts(r.text))
        for r in quality_rules.judge(df).collect():
            n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert n in text[r.doc_id]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(no_docs).count() == 0


def test_windows_that_share_a_hash(spark, monkeypatch):
    """With three hash values for all windows the counts are still those of the words."""
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) % 3)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").select("id", F.split("text", " +").alias("w"))
    got = {r.id: r.n for r in df.select("id", quality_rules.repeated_words(F.col("w")).alias("n")).collect()}
    assert got == {i: plain_counts(t)[4] for i, t in enumerate(texts)}


def test_fences_shrink_by_count(spark):
    """A group's quartiles move to its language's, and these to all documents', by their counts; no count is a cliff."""
    rows, rnd = [], random.Random(5)
    for source, n, size in (("a", 1, 9), ("b", 99, 9), ("c", 100, 9), ("d", 101, 9), ("e", 5000, 9), ("f", 3000, 3)):
        rows += [(len(rows) + k, "x" if size == 9 else "y", source, 100, 100 * size, 0, 0, 0, 1) for k in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    for name, value in (("symbols", 0), ("dup_lines", 0), ("repeats", 0)):
        df = df.withColumn(name, F.lit(value).cast("long"))
    got = {(r.lang_, r.source_): (r.fence_docs, r.fence.lo_3, r.fence.hi_3) for r in quality_rules.fences(df.withColumn("word_len", F.col("word_chars") * 10)).collect()}
    nine, three = 8960, 2944  # rounded to six bits

    def shrunk(docs, own, larger):
        return tuple((docs * a + 100 * b) // (docs + 100) for a, b in zip(own, larger, strict=True))

    def fence(docs, own, larger):
        low, high = shrunk(docs, own, larger)
        wide = max(3 * (high - low), 1500)
        return docs, low - wide, high + wide

    every = (three, nine)  # quartiles of all
    x, y = shrunk(5301, (nine, nine), every), shrunk(3000, (three, three), every)
    want = {("x", s): fence(n, (nine, nine), x) for s, n in (("a", 1), ("b", 99), ("c", 100), ("d", 101), ("e", 5000))} | {("y", "f"): fence(3000, (three, three), y)}
    assert got == want


def test_fences_keep_clean_and_drop_junk(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(500):
        w = [word() for _ in range(120)]
        junk = i % 20 == 0
        rows.append((i, " ".join(x + "###" * junk for x in w), "en", f"s{i % 2}", 1))
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert all(r.kept == (r.doc_id % 20 != 0) for r in got)


def test_sketch_merges(spark):
    """Quartiles of merged sketches equal those of all values within the rounding of a sketch."""
    rnd = random.Random(6)
    values = [rnd.randint(0, 5000) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(quality_rules.rounded(F.col("v")).alias("r"), "v")
    assert df.where("r > v or r < v * 31 / 32").count() == 0
    assert df.select("r").distinct().count() < 300


# ---- chat --------------------------------------------------------------------------


ROWS = "conv_id long, turn long, role string, text string, window int, loss string"


def plain_digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    target = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>assistant\nok", "<||im_end|>", "<", "|", "\\n", "\n", "é", "word " * 30, "<|", "plain"]
    rows = []
    for c in range(60):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rnd.randint(1, 9)
        for t, role in enumerate(roles):
            rows.append((c, t, role, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))), 0, ""))
    return [*rows, (100, 0, "user", None, 0, ""), (100, 1, None, "x", 0, ""), (100, 2, "a\nb\\n<|im_end|>", "y", 0, ""), (None, 0, "assistant", "z", 0, ""), (101, 0, "assistant", "dup", 0, ""), (101, 0, "assistant", "dup", 0, ""), (102, 0, "assistant", "long " * 5000, 0, "")]


def test_chat_round_trip(spark, talks):
    want = defaultdict(list)
    for c, t, role, text, *_ in sorted(talks, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = chat_format.digest(spark.createDataFrame(talks, ROWS)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest(want[r.conv_id])


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_chat_equal_rows(spark, monkeypatch, size):
    """Turns that are equal in all, or in all but the text, are turns of their own, also where lookups are shuffled."""
    monkeypatch.setattr("symbolake.llm.base.BROADCAST_BYTES", size)
    talk = [(1, 0, "assistant", "same", 0, "")] * 900 + [(1, 1, "user", f"t{i % 7}", 0, "") for i in range(50)] + [(None, 5, "user", "same", 0, ""), (5, None, "user", "same", 0, "")]
    got = {r.conv_id: r for r in chat_format.digest(spark.createDataFrame(talk, ROWS)).collect()}
    one = [("assistant", "same")] * 900 + sorted(("user", f"t{i % 7}") for i in range(50))
    for c, want in ((1, one), (None, [("user", "same")]), (5, [("user", "same")])):
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == plain_digest(want)


def test_chat_clashing_names(spark):
    kind = "conv_id long, turn long, role string, text string, key string, key2 string, i string, w string, same string, tie string, tokens string, conv string, at string, first string"
    df = spark.createDataFrame([(1, 0, "user", "a", *"bcdefghijk"), (1, 1, "assistant", "b", *"bcdefghijk")], kind)
    (got,) = chat_format.digest(df).collect()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == plain_digest([("user", "a"), ("assistant", "b")])


@pytest.mark.parametrize("block, hot", [(4096, 40), (8, 1_000_000), (8, 25), (1, 1_000_000), (31, 1_000_000)])
def test_chat_hot_conversations(spark, monkeypatch, talks, block, hot):
    """Conversations that are summed in parts and cut in blocks give the same turns; windows are those of one pass, over blocks of any size."""
    monkeypatch.setattr(chat_format, "BLOCK", block)
    monkeypatch.setattr(chat_format, "HOT", hot)
    far = lambda t: t if t < 110 else 10**15 + t  # noqa: E731  turn numbers with a far outlier
    long = [(c, None if t < 2 else far(t - t % 3), "assistant" if t % 2 else "user", f"{t:03} " + "w " * (t % 50), 0, "") for c in (500, None) for t in range(120)]
    rows = [r for r in talks if r[0] is not None] + long
    want = defaultdict(list)
    for c, _, role, text, *_ in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    df = spark.createDataFrame(rows, ROWS)
    for r in chat_format.digest(df).collect():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest(want[r.conv_id])
    spans = defaultdict(list)
    for s in chat_format.spans(chat_format.numbered(chat_format.keyed(df)), 100).collect():
        spans[s.conv_id].append((s.window, s.first, s.end, s.start))
    for c, turns in want.items():
        tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) + chat_format.FRAME for _, t in turns]
        plain, first = [], 0
        for i in range(1, len(tokens) + 1):
            if i == len(tokens) or sum(tokens[first : i + 1]) > 100:
                plain.append((first, i, sum(tokens[:first])))
                first = i
        own = sorted(spans[c])
        assert [x[1:] for x in own] == plain and len({x[0] for x in own}) == len(own)


def test_chat_windows(spark, talks):
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + chat_format.FRAME
    turns = defaultdict(list)
    for c, t, role, text, *_ in sorted(talks, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")):
        turns[c].append((role, tokens(text)))
    plain = {}
    for c, ts in turns.items():
        windows, used, first = [], 0, 0
        for i, (_, n) in enumerate(ts):
            if i > first and used + n > 150:
                windows.append((first, i))
                first, used = i, 0
            used += n
        windows.append((first, len(ts)))
        plain[c] = windows
    got = defaultdict(list)
    for r in chat_format.windows(spark.createDataFrame(talks, ROWS), budget=150, history=60).orderBy("conv_id", "window").collect():
        got[r.conv_id].append(r)
    for c, windows in plain.items():
        assert len(got[c]) == len(windows)
        for r, (a, b) in zip(got[c], windows, strict=True):
            system = int(a > 0 and turns[c][0][0] == "system")
            back = 0
            while a - back - 1 >= system and sum(n for _, n in turns[c][a - back - 1 : a]) <= 60:
                back += 1
            assert r.n_context == system + back
            assert len(re.findall(r"<\|im_start\|>", r.text)) == system + back + b - a
            assert len(r.loss) == sum(role == "assistant" for role, _ in turns[c][a:b])


def test_html_container_named_for_its_parts():
    body = "<p>" + "A sentence, with commas, of the article. " * 6 + "</p>"
    page = f'<body><div class="layout has-sidebar no-ads"><div class="text">{body}</div><div class="sidebar"><p>Aside, aside, aside.</p></div></div></body>'
    got = html_extract.main_text(page)
    assert got.startswith("A sentence") and "Aside" not in got


def test_chat_long_conversation(spark):
    n = 30_000
    rows = [(7, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"turn {t} <|im_end|> " + "w " * (t % 40), 0, "") for t in range(n)]
    (got,) = chat_format.digest(spark.createDataFrame(rows, ROWS)).collect()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == plain_digest([(r[2], r[3]) for r in rows])


def test_parts_of_far_turn_numbers(spark, monkeypatch):
    """One outlier does not put all other turns into one part."""
    monkeypatch.setattr(chat_format, "HOT", 100)
    turns = spark.createDataFrame([(1, t if t else 10**17, "user", 3) for t in range(1000)], "conv_id long, turn long, role string, tokens long")
    parted, before = chat_format._in_parts(turns)
    sizes = [r["count"] for r in parted.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 200 and before.count() == len(sizes)


def test_chat_empty(spark):
    assert chat_format.digest(spark.createDataFrame([], ROWS)).count() == 0


"""The two passes of main-text extraction: rules, neighbours, hostile markup, odd rows."""

import itertools
import random
import time

import pytest

from fieldcast.llm import html_text
from fieldcast.llm.html_text import Rules, main_text, second_pass

LONG = "The cat sat on the mat and it was the best of all that the cat had for a long time in the house."
ODD = "Zymurgy quartz flummox vex jackdaw sphinx glyph rhythm bivouac crwth nymph waltz fjord."


def plain_second_pass(labels, headings, article):
    """Looks at every decided block and, in an article, at its two borders."""
    n, out = len(labels), []
    decided = [(i, x) for i, x in enumerate(labels) if x != "unsure"] + ([(-1, "good"), (n, "good")] if article else [])
    for i in range(n):
        if labels[i] != "unsure":
            out.append(labels[i])
            continue
        least = min((abs(j - i) for j, _ in decided), default=None)
        near = [(j, x) for j, x in decided if abs(j - i) == least]
        if not near:
            out.append("good")
        elif len(near) == 2 and headings[i] and not (article and i == 0):
            out.append(max(near)[1])
        else:
            out.append("good" if any(x == "good" for _, x in near) else "bad")
    return out


def test_second_pass_against_brute_force():
    rng = random.Random(5)
    for labels in itertools.product(("good", "bad", "unsure"), repeat=5):
        for article in (False, True):
            headings = [rng.random() < 0.3 for _ in labels]
            assert second_pass(list(labels), headings, article) == plain_second_pass(labels, headings, article)
    for _ in range(300):
        labels = rng.choices(("good", "bad", "unsure"), (1, 1, 4), k=rng.randint(0, 40))
        headings = [rng.random() < 0.3 for _ in labels]
        assert second_pass(labels, headings, rng.random() < 0.5) is not None
        assert second_pass(labels, headings, True) == plain_second_pass(labels, headings, True)


def links(n):
    return "<ul>" + "".join(f"<li><a href=/{i}>story {i} is here</a></li>" for i in range(n)) + "</ul>"


def test_link_lists_and_adverts_inside_an_article():
    advert = f"<p>Shoes: <a href=x>{ODD}</a> today</p>"
    page = f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p>{advert}<p>{LONG}</p><h2>More</h2>{links(4)}</article>"
    assert main_text(page) == f"Head {LONG} Short. {LONG}"
    mixed = f"<article><p>{LONG}</p><p>{ODD} <a href=x>{ODD[:40]}</a></p><p>see <a href=/y>the second part of it</a></p><p>{LONG}</p></article>"
    assert main_text(mixed) == f"{LONG} see the second part of it {LONG}"


def test_thresholds_decide_inside_an_article():
    page = f"<article><h1>H</h1><p>{LONG} <a href=1>Of it</a></p><p>{ODD}</p><h2>L</h2>{links(3)}<p>{ODD}</p>{links(3)}<p>Tail</p></article>"
    usual = main_text(page)
    assert usual == f"H {LONG} Of it {ODD} Tail"
    assert main_text(page, Rules(stop_density=0.0)) == f"H {LONG} Of it {ODD} {ODD} Tail"
    assert main_text(page, Rules(link_density=1.0, some_links=1.0)).count("story") == 6
    assert main_text(page, Rules(link_run=9, link_density=0.99)) != usual
    assert main_text(page, Rules(content_chars=1000)) == f"H {LONG} Of it Tail"
    assert main_text(page, Rules(stop_density=2.0, some_links=0.0)) == "H Tail"


def test_pages_without_an_article():
    page = f"<nav>menu</nav><h1>Title</h1><p>Short.</p><p>{LONG}</p><p>By us</p>{links(3)}<h3>After</h3><footer>foot</footer>"
    assert main_text(page) == f"Title Short. {LONG} By us"
    assert main_text("<nav>menu</nav><p>Only this.</p><footer>foot</footer>") == "Only this."
    assert main_text(links(2)) == main_text("<nav>x</nav>") == ""


def test_unsure_text_between_two_articles_is_outside():
    page = f"<article><p>{LONG}</p></article><p>between</p><article><p>Two.</p></article>"
    assert main_text(page) == f"{LONG} Two."


JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 4


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article class="post type-post comments-open"><p>{LONG}</p></article>', LONG),
        (f'<div class="entry share-enabled"><p>{LONG}</p></div>', LONG),
        (f'<div class="main sidebar-left"><p>{LONG}</p></div>', LONG),
        (f'<div class="topic-social-science"><p>{LONG}</p></div>', LONG),
        (f'<body><form id=aspnetForm action="./"><input type=hidden><nav>menu</nav><h1>Head</h1><p>{LONG}</p><select><option>one</select><footer>foot</footer></form></body>', f"Head {LONG}"),
        (f"<body><h1>猫</h1><p>{JAPANESE}</p><p><a href=/>次の話</a></p></body>", f"猫 {JAPANESE}"),
        (f"<article><a href=/>Teaser</a> of it</article><div><p>{LONG}</p><p>{LONG} And on.</p></div>", f"Teaser of it {LONG} {LONG} And on."),
        (f'<div class="elementor-widget"><p>{LONG}</p></div><div class="widget">Tags: a, b</div>', LONG),
    ],
)
def test_no_article_is_lost_to_a_name(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["comments", "post-comments", "sidebar", "right-sidebar", "cookie-notice", "ad", "related", "newsletter signup"])
def test_named_boilerplate_goes_where_there_is_content(name):
    """Reader comments and the like go, however long, beside an article or in it."""
    other = f'<div class="{name}"><p>{LONG} {LONG} {LONG}</p><p>Me too.</p></div>'
    assert main_text(f"<div><p>{LONG}</p></div>{other}") == LONG
    assert main_text(f"<article><p>{LONG}</p>{other}</article>") == LONG
    assert main_text(f"<article><p>{LONG}</p></article><form><p>{LONG}</p><button>Send</button></form>") == LONG
    assert main_text(f'<div class="{name}">Buy now</div><p>Only this.</p>') == "Only this."
    assert main_text(f'<div class="{name}"><p>{LONG}</p></div><article><h1>Head</h1><p>Short one.</p></article>') == "Head Short one."


def plain_main_text(spec, rules=Rules()):
    """Both passes over (container, in article, blocks of (text, linked characters, heading))."""
    rows = [(kind, k if art else 0, k, *b) for k, (kind, art, blocks) in enumerate(spec, 1) for b in blocks]

    def content(r):
        text, linked = r[3], r[4]
        return len(text) >= rules.content_chars and linked / len(text) <= rules.link_density and html_text.stop_density(text) >= rules.stop_density

    good = [r[0] != "nav" and content(r) for r in rows]
    elsewhere = any((g or r[1]) and r[0] not in ("nav", "form", "named") for g, r in zip(good, rows))
    needed = {r[2] for g, r in zip(good, rows) if g} if not elsewhere else set()
    alive = [r[0] != "nav" and (r[0] not in ("form", "named") or r[2] in needed) for r in rows]
    size = lambda inside: sum(len(r[3]) for g, a, r in zip(good, alive, rows) if g and a and bool(r[1]) == inside)
    marked = size(True) >= size(False) and any(a and r[1] for a, r in zip(alive, rows))
    left = [(r[1] if marked else 0, *r[3:], g) for g, a, r in zip(good, alive, rows) if a and (r[1] or not marked)]
    labels = []
    for art, text, linked, heading, g in left:
        share, long = linked / len(text), len(text) >= rules.content_chars
        if share > rules.link_density:
            labels.append("unsure" if heading or (art and not long) else "bad")
        else:
            labels.append("good" if g else "bad" if long and share > rules.some_links else "unsure")
    out, at = [], 0
    for art in dict.fromkeys(x[0] for x in left):
        mine = [i for i, x in enumerate(left) if x[0] == art]
        for i, label in zip(mine, plain_second_pass([labels[i] for i in mine], [left[i][3] for i in mine], art > 0)):
            if label == "good":
                out.append((i, left[i][1]))
    return " ".join(t for _, t in sorted(out))


def test_generated_pages_against_brute_force():
    """Pages of navigation, forms, named containers, plain ones and articles, with short, long
    and linked blocks, no three of them linked in a row."""
    rng = random.Random(11)
    found = 0
    for _ in range(300):
        spec, page = [], ""
        for _ in range(rng.randint(1, 6)):
            kind, art = rng.choice([("nav", False), ("form", False), ("named", False), ("plain", False), ("plain", True), ("plain", True)])
            blocks, made = [], ""
            for j in range(rng.randint(1, 4)):
                text = rng.choice([LONG, ODD, "Short.", f"{LONG} {rng.randrange(99)}", f"w{rng.randrange(99)} of it"])
                part = rng.choice([0, 0, 0, 0.3, 1]) if j % 2 else 0
                cut = int(len(text) * part)
                while cut and (text[cut - 1] == " " or text[cut : cut + 1] == " "):
                    cut += 1
                heading = rng.random() < 0.2
                blocks.append((text, cut, heading))
                inner = f"<a href=x>{text[:cut]}</a>{text[cut:]}" if cut else text
                made += f"<h2>{inner}</h2>" if heading else f"<p>{inner}</p>"
            spec.append((kind, art, blocks))
            page += {"nav": f"<nav>{made}</nav>", "form": f"<form>{made}</form>", "named": f'<div id="site-comments">{made}</div>', "plain": f"<article>{made}</article>" if art else f"<div>{made}</div>"}[kind]
        assert main_text(page) == plain_main_text(spec), page
        found += bool(plain_main_text(spec))
    assert found > 200


@pytest.mark.parametrize(
    "page",
    ["<b>" * 100_000 + "</i>" * 100_000, "<i><article>" + "<b>" * 100_000 + "</i>" * 100_000, "<a" * 500_000, '<a "' * 250_000, "<p>" * 100_000 + "</li>" * 100_000, "<!--" * 200_000, "<a class='" * 100_000 + ">"],
)
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


def test_unclosed_tags_under_a_second():
    page = "<article>" + "<b>" * 100_000 + "x"
    began = time.process_time()
    assert main_text(page) == "x"
    assert time.process_time() - began < 1


def test_what_never_ends():
    assert main_text("a<!-- b > c") == "a" and main_text("x<script> y > z") == "x"
    assert main_text("x <b>y</b> <script>1</script> z <i") == "x y z" and main_text("a < b > c") == "a < b > c"


def test_long_text_and_empty_table(spark):
    text = " ".join([LONG] * 20_000)
    rows = [(1, "u", f"<article><p>{text}</p></article>", "x"), (None, None, None, None), (1, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(text)]
    assert html_text.extract(df.limit(0)).count() == 0

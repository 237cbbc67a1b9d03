"""Pages whose article stands among tags and names that are easily misread."""

import pytest

from trajspark.llm.html_extract import main_text

WORDS = " ".join(f"word{i}" for i in range(60))
ARTICLE = f"<article><p>{WORDS}</p><p>The end.</p></article>"
TEXT = f"{WORDS} The end."


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<math/>", "<object data='x'>", "<audio src=x>", "<select>", "<svg viewBox='0'>", "<iframe src=x>"])
def test_unclosed(tag):
    assert main_text(f"<body>{tag}{ARTICLE}</body>") == TEXT
    assert main_text(f"<body><article>{tag}<p>{WORDS}</p><p>The end.</p></article></body>") == TEXT
    name = tag[1:].split(" ")[0].strip("/>")
    assert main_text(f"<body>{tag}{ARTICLE}<{name}>dropped</{name}></body>") == TEXT


def test_dropped():
    assert main_text(f"<body><article><p>{WORDS}</p><svg><title/><text>no</text></svg><object>a<object>b</object>c</object><select><option>d</select><p>The end.</p></article></body>") == TEXT
    assert main_text(f"<body>{ARTICLE}<script>if (a < b) '<svg>'") == TEXT
    assert main_text(f"<body><script>'</svg><svg>'</script><svg><!-- </svg> --><text>no</text></svg>{ARTICLE}") == TEXT


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="content with-sidebar">', '<div id="content" class="no-sidebar">', '<article class="post meta-x">', '<div class="post comments-open">', '<div class="has-comments">', '<div class="sidebar-layout">',
        '<div id="page" class="menu-x"><div class="widget">',
    ],
)
def test_names_around_the_article(opening):
    closing = "".join(f"</{t.split()[0]}>" for t in opening.split("<")[:0:-1])
    assert main_text(f"<body><p>Stray</p><nav><a href='/'>Home</a></nav>{opening}<p>{WORDS}</p><p>The end.</p>{closing}<footer>Foot</footer></body>").removeprefix("Stray ") == TEXT


@pytest.mark.parametrize("attrs", ['class="entry-header"', 'id="page-header"', 'id="more-of-it"'])
def test_headline(attrs):
    assert main_text(f"<body><nav><a href='/'>Home</a></nav><article><h1 {attrs}>Head line</h1><p>{WORDS}</p><p>The end.</p></article></body>") == f"Head line {TEXT}"


def test_names_of_other_text():
    assert main_text(f'<body>{ARTICLE}<div class="comments"><p>{WORDS} {WORDS} {WORDS}</p></div><div class="sidebar-content"><p>{WORDS}</p></div></body>') == TEXT
    assert main_text('<body><nav><a href="/">Home</a></nav><div class="cookie"><p>We use some.</p></div></body>') == ""


@pytest.mark.parametrize("name", ["more", "related", "meta", "post-share"])
def test_article_under_a_name(name):
    assert main_text(f"<body><nav><a href='/'>Home</a></nav><article class='{name}'><p>{WORDS}</p><p>The end.</p></article><footer>Foot</footer></body>") == TEXT
    assert main_text(f"<body><article class='{name}'><p>Only a few words.</p></article></body>") == "Only a few words."


@pytest.mark.parametrize("name", ["related-work", "skip", "share", "alert", "meta", "read-more"])
def test_section_under_a_name(name):
    assert main_text(f"<body><article><p>Start.</p><section class='{name}'><p>{WORDS}</p></section><p>The end.</p></article></body>") == f"Start. {TEXT}"
    assert main_text(f"<body><article><p>{WORDS}</p><div class='{name}'><a href='/a'>One</a> <a href='/b'>Two</a></div><p>The end.</p></article></body>") == TEXT


@pytest.mark.parametrize("inner", ["<div>{}</div>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<table><tr><td>{}</td></tr></table>"])
def test_page_in_a_form(inner):
    body = inner.format(f"<p>{WORDS}</p><p>The end.</p>")
    page = f"<body><form id='aspnetForm' action='/'><input type=hidden name=v value=1><nav><a href='/'>Home</a></nav>{body}<footer>Foot</footer></form></body>"
    assert main_text(page) == TEXT


def test_form_beside_the_article():
    form = "<form><label>Your name</label><input name=q><p>We never pass on what you write to us here.</p><button>Send</button></form>"
    assert main_text(f"<body>{ARTICLE}{form}</body>") == TEXT
    assert main_text(f"<body><article><p>{WORDS}</p>{form}<p>The end.</p></article></body>") == TEXT


def test_names_that_hold_a_boiler_word():
    assert main_text(f"<body><p>Another short one.</p><div id='research-search-tips'><p>{WORDS}</p><p>The end.</p></div></body>").removeprefix("Another short one. ") == TEXT
    head = "<div class='article-header'><h1>Head line</h1><p>What it is about, in short.</p></div>"
    assert main_text(f"<body><nav><a href='/'>Home</a></nav><div>{head}<div class='article-body'><p>{WORDS}</p><p>The end.</p></div></div></body>") == f"Head line What it is about, in short. {TEXT}"


def test_equal_regions():
    assert main_text(f"<body><div><p>{WORDS}</p></div><nav>{'<a href=x>Home page</a>' * 60}</nav><div><p>{WORDS.upper()}</p></div></body>") == WORDS


def test_formula():
    formula = "<math><mi>x</mi><mo>+</mo><mn>1</mn><semantics><annotation>x+1</annotation></semantics></math>"
    assert main_text(f"<body><article><p>{WORDS}</p><p>Let {formula} be.</p></article></body>") == f"{WORDS} Let x+1 be."


@pytest.mark.parametrize("part", ["<a x=\"", "<a 'b", "<div>", "<div class=sidebar>", "</b>", "<p>a</i>", "<svg x='", "<", "<!", "a < b ", "<script>'"])
def test_hostile_pages(part):
    """Time grows with the length: a page of some megabytes is read within seconds."""
    import time

    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        main_text("<body>" + part * n + ARTICLE)
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.05)

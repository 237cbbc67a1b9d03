"""Labelled pages from which html_extract learns its weights: page layouts written from rules, the article marked by hand.

A page is a list of (is_article, html); words are invented, as only tags, attributes and counts matter.
"""

from __future__ import annotations

import random

LINK = '<li><a href="/x">{}</a></li>'
#: (before the article, opening of the article's element, its closing, after it)
LAYOUTS = [
    ("<header><h1>{s}</h1></header><nav><ul>{links}</ul></nav>", "<article>", "</article>", "<footer>&copy; {s}</footer>"),
    ('<div id="menu"><ul>{links}</ul></div><div class="ad">{s}</div>', '<div class="content">', "</div>", '<div class="sidebar"><h3>{s}</h3><ul>{links}</ul></div><div id="footer">{s}</div>'),
    ('<nav>{links}</nav><div class="cookie-notice"><p>{s} {s}</p><button>{s}</button></div>', "<main><article>", "</article></main>", '<section class="comments"><h2>{s}</h2><div class="comment"><p>{p}</p></div><form><textarea></textarea><p>{s}</p></form></section>'),
    ("<ul>{links}</ul>", "<div><div>", "</div></div>", "<aside><p>{p}</p></aside><ul>{links}</ul><p><a href='/'>{s}</a></p>"),
    ("<div><a href='/'>{s}</a> | <a href='/a'>{s}</a></div>", "", "", "<div><a href='/'>{s}</a> | <a href='/a'>{s}</a> | {s}</div>"),
]


def words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def pages(n: int = 60, seed: int = 11) -> list[list[tuple[bool, str]]]:
    rng, out = random.Random(seed), []
    for i in range(n):
        before, left, right, after = LAYOUTS[i % len(LAYOUTS)]
        fill = lambda s: s.format(s=words(rng, 2, 6), p=words(rng, 10, 40), links="".join(LINK.format(words(rng, 1, 3)) for _ in range(rng.randint(3, 8))))
        body = f"<h1>{words(rng, 3, 10)}</h1>" + "".join(rng.choice(("<p>{}</p>", "<p><b>{}</b></p>", "<p>{} <a href='/l'>x</a> {}</p>", "<h2>{}</h2><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>")).format(words(rng, 4, 60), words(rng, 4, 60)) for _ in range(rng.randint(2, 9)))
        out.append([(False, fill(before)), (True, left + body + right), (False, fill(after))])
    return out

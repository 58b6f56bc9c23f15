"""Labelled pages for training the content extractor: a fixed, small set of layouts.

Elements carry ``data-main="1"`` (main text) or ``data-main="0"`` (around it); elements without the
mark have the label of their parent, and the page itself is around. The words are invented.
"""

from __future__ import annotations

from itertools import product

WORDS = "oru tal benim sato kerra lund imo vesta pol quin arda mesu nal tirro opek sund ela fimo gard hune".split()


def prose(seed: int, words: int) -> str:
    """Invented sentences, the same for the same numbers."""
    picked = [WORDS[(seed * 7 + i * i * 3 + i * 5) % len(WORDS)] for i in range(words)]
    return " ".join(w if i % 9 else w.capitalize() for i, w in enumerate(picked)) + "."


def _links(n: int, seed: int) -> str:
    return "".join(f'<li><a href="/{i}">{prose(seed + i, 1 + i % 3)}</a></li>' for i in range(n))


TOP = [
    '<nav><ul>{links}</ul></nav>',
    '<header class="site-header"><div class="logo"><a href="/">{s2}</a></div><ul class="menu">{links}</ul></header>',
    '<div id="nav" class="navigation"><ul>{links}</ul></div><div class="cookie-notice"><p>{s12}</p><button>{s1}</button></div>',
    '<div class="topbar"><a href="/">{s1}</a> | <a href="/in">{s1}</a></div><div class="breadcrumb"><a href="/">{s1}</a> &gt; <a href="/a">{s2}</a></div>',
]
ARTICLE = [
    '<article data-main="1"><h1>{s6}</h1>{paragraphs}</article>',
    '<main data-main="1"><h1>{s6}</h1>{paragraphs}<h2>{s3}</h2>{paragraphs}<ul><li>{s5}</li><li>{s12}</li></ul></main>',
    '<div id="content" class="post-body" data-main="1"><h2>{s6}</h2>{paragraphs}<blockquote><p>{s20}</p></blockquote></div>',
    '<div class="entry" data-main="1"><p>{s40}</p><div class="ad" data-main="0">{s8}</div><p>{s3} <a href="/x">{s2}</a> {s9}</p><table><tr><td>{s2}</td><td>{s4}</td></tr></table></div>',
    '<article data-main="1"><h1>{s3}</h1><p>{s9}</p><div class="notice" data-main="0">{s5}</div><p>{s1}</p><p><a href="/q">{s4}</a></p>{paragraphs}'
    '<div class="share" data-main="0"><a href="/f">{s1}</a></div><section id="comments" data-main="0"><h3>{s2}</h3><div class="comment"><p>{s30}</p></div></section></article>',
    '<main data-main="1"><section><h2>{s4}</h2><p>{s20}</p><pre>{s9}</pre></section><figure><img src="/i"><figcaption>{s6}</figcaption></figure>'
    '<form data-main="0"><label>{s2}</label><p>{s6}</p></form><aside data-main="0">{s20}</aside><ol><li>{s2}</li><li>{s9}</li></ol><p>{s2}</p></main>',
    '<article class="post" data-main="1"><h2>{s2}</h2><nav data-main="0"><ul>{links}</ul></nav><p>{s12}</p><div>{s30}</div><dl><dt>{s1}</dt><dd>{s8}</dd></dl><footer data-main="0">{s4}</footer></article>',
    '<article data-main="1"><h1>{s2}</h1><p>{s6}</p><div class="ad" data-main="0">{s4}</div><div class="comments" data-main="0"><h4>{s2}</h4><ul><li><p>{s40}</p></li><li>{s9}</li></ul></div>'
    '<div class="cookie-banner" data-main="0"><p>{s20}</p></div><div class="related" data-main="0"><ul>{links}</ul></div></article>',
    '<article data-main="1"><div><div><div><h1>{s4}</h1><div><p>{s12}</p>{paragraphs}</div><div>{s20}</div></div></div></div><div><div><p>{s3}</p></div></div></article>',
    '<article class="story" data-main="1"><h1>{s4}</h1><p>{s2}</p><aside data-main="0"><p>{s12}</p><ul>{links}</ul></aside><p>{s60}</p><p>{s1}</p></article>',
]
SIDE = [
    '<div class="ad">{s9}</div>',
    '<aside class="sidebar"><h3>{s2}</h3><ul>{links}</ul><p>{s12}</p></aside>',
    '<div class="related widget"><h3>{s2}</h3><ul>{links}</ul></div><form><label>{s2}</label><input name="q"><button>{s1}</button></form>',
    '<section id="comments" class="comments"><h3>{s2}</h3><div class="comment"><p class="author">{s2}</p><p>{s30}</p></div><div class="comment"><p>{s12}</p></div></section>',
    '<div class="newsletter"><p>{s12}</p><form><input type="email"></form></div><div class="advertisement sponsored"><a href="/b">{s6}</a></div>',
]
END = [
    '<footer>&copy; {s9}</footer>',
    '<div id="footer"><p>{s12}</p><ul>{links}</ul></div>',
    '<footer class="site-footer"><div class="social share"><a href="/f">{s1}</a></div><p>{s20}</p></footer>',
]


def labelled_pages() -> list[str]:
    """Every combination of the parts above, with texts of different lengths."""
    pages = []
    for seed, (top, article, side, end) in enumerate(product(TOP, ARTICLE, SIDE, END)):
        sizes = {f"s{n}": prose(seed + n, n) for n in (1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 30, 40, 60)}
        paragraphs = "".join(f"<p>{prose(seed + i, 3 + (seed * 13 + i * 29) % 90)}</p>" for i in range(1 + seed % 5))
        parts = [top, side, article, end] if seed % 3 == 0 else [top, article, side, end]
        if seed % 4 == 1:
            parts[1:3] = [f'<div class="wrapper">{parts[1]}{parts[2]}</div>']
        body = "".join(parts).format(**sizes, links=_links(3 + seed % 6, seed), paragraphs=paragraphs)
        pages.append(f"<html><head><title>{prose(seed, 6)}</title></head><body>{body}</body></html>")
    return pages

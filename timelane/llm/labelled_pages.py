"""Labelled pages to train on: the elements of the main text carry the attribute ``data-main``.

Each layout is filled with texts of several lengths by a rule, so the set is small and fixed.
"""

from __future__ import annotations

import random

MARK = "data-main"

# Layouts. {h} heading, {l} long paragraph, {m} middle one, {s} short one, {w} a
# few words, {a} a link of few words, {n} list items that are links.
LAYOUTS = [
    "<head><title>{w}</title><style>p{{}}</style></head><body><nav><ul>{n}</ul></nav><div class='ad'>{s}</div>"
    "<article data-main><h1>{h}</h1><p>{l}</p><p>{s}</p><p>{l}</p><p>{w}</p></article><footer>{w} {s}</footer></body>",
    "<body><nav>{a} {a} {a}</nav><article data-main><h1>{h}</h1><p>{w}</p><p>{s}</p></article><footer>{w}</footer></body>",
    "<body><header class='site-header'><div class='logo'>{w}</div><nav class='menu'>{a} {a} {a}</nav></header>"
    "<main><div class='cookie-notice'><p>{m}</p><button>{w}</button></div><div class='content'><h1 data-main>{h}</h1>"
    "<div class='byline'>{w}</div><p data-main>{m}</p><h2 data-main>{w}</h2><p data-main>{l}</p><ul data-main><li>{s}</li>"
    "<li>{w}</li></ul></div></main><aside class='sidebar'><h3>{w}</h3><ul>{n}</ul></aside>"
    "<section class='comments'><h3>{w}</h3><div class='comment'><p>{m}</p></div><div class='comment'><p>{s}</p></div>"
    "</section><footer class='site-footer'><p>{s}</p></footer></body>",
    "<body><div id='header'><h2>{w}</h2></div><div id='menu'><ul>{n}</ul></div><div id='main'><div class='post'>"
    "<h1 data-main>{h}</h1><div class='entry-content' data-main><p>{l}</p><blockquote><p>{m}</p></blockquote><p>{s}</p>"
    "<table><tr><td>{w}</td><td>{w}</td></tr></table></div><div class='advert banner'>{m}</div>"
    "<div class='share social'>{a} {a}</div></div><div id='comments'><ol><li>{m}</li><li>{s}</li></ol></div></div>"
    "<div id='sidebar'><div class='widget'><p>{s}</p>{a}</div></div><div id='footer'>{s} {a}</div></body>",
    "<body><div class='wrapper'><div class='navbar'>{a} {a}</div><div class='notice banner'><p>{m}</p></div>"
    "<article data-main><header><h1>{h}</h1></header><section><h2>{w}</h2><p>{l}</p><p>{m}</p></section><pre>{m}</pre>"
    "</article><form class='newsletter'><p>{s}</p><label>{w}</label></form><div class='related'><h4>{w}</h4>"
    "<ul>{n}</ul></div></div></body>",
    "<body><div class='top'>{a} {a} {a}</div><table><tr><td class='nav'>{a} {a}</td><td class='text'>"
    "<p data-main>{l}</p><p data-main>{m}</p><p data-main>{l}</p></td><td class='ads'>{s}</td></tr></table>"
    "<div class='copyright'>{s}</div></body>",
    "<body><p data-main>{l}</p><p data-main>{s}</p><p data-main>{m}</p></body>",
    "<body><div role='navigation'>{a}{a}</div><div role='main'><h1 data-main>{h}</h1><p data-main>{m} {a} {m}</p>"
    "<dl data-main><dt>{w}</dt><dd>{m}</dd></dl><figure data-main><figcaption>{s}</figcaption></figure>"
    "<div class='promo sponsored'><p>{m}</p></div></div><div role='contentinfo'><p>{s}</p></div>"
    "<div id='disqus' class='comment-list'><div class='comment-body'><p>{l}</p></div></div></body>",
    "<body><div class='popup gdpr consent'>{m}</div><header><p>{w}</p></header><div class='article-body' data-main>"
    "<h2>{h}</h2>{m}<p>{s}</p>{l}</div><aside>{m}</aside><footer><ul>{n}</ul><p>{m}</p></footer></body>",
]
COPIES = 12


def labelled_pages() -> list[str]:
    """COPIES fillings of every layout."""
    rng = random.Random(11)

    def words(low, high, stop="."):
        out = []
        for _ in range(rng.randint(low, high)):
            word = "".join(rng.choice("tanerosi") for _ in range(rng.randint(2, 8)))
            out.append(word + (rng.choice([",", ".", "", "", "", ""]) if stop else ""))
        return (" ".join(out).capitalize() + stop).replace(",.", ".").replace("..", ".")

    pages = []
    for layout in LAYOUTS:
        for _ in range(COPIES):
            parts = layout.replace("{{", "\0").replace("}}", "\1").split("{")
            out = [parts[0]]
            for part in parts[1:]:
                kind, rest = part.split("}", 1)
                out.append({
                    "h": lambda: words(3, 9, ""), "l": lambda: words(40, 160), "m": lambda: words(12, 40),
                    "s": lambda: words(3, 12), "w": lambda: words(1, 3, rng.choice(["", "."])),
                    "a": lambda: f"<a href='/x'>{words(1, 3, '')}</a>",
                    "n": lambda: "".join(f"<li><a href='/x'>{words(1, 3, '')}</a></li>" for _ in range(rng.randint(3, 9))),
                }[kind]() + rest)
            pages.append("".join(out).replace("\0", "{").replace("\1", "}"))
    return pages

"""Main text of web pages by maximum-scoring contiguous regions.

A page is a sequence of words and tags.  Labelled pages give every element name,
every name in a class, id or role, and the shape of a block (its length, the share
of its words that are links) a weight: the log odds that words there belong to the
article.  A word scores what the weights around it add up to, a tag scores
negative.  Where scores fall by ``DROP`` without a word in favour, as in an advert
or a menu, the page is cut; in each part one linear scan finds the contiguous
region of the highest sum, and the regions found are the text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import fresh, named

#: Elements whose content is never text of the page; the first four hold no markup, so an open one lasts to the page's end.
OPAQUE = ("script", "style", "title", "xmp", "noscript", "template", "svg", "iframe", "object", "canvas", "video", "audio", "math")
#: What may stand in a head; any other element ends one that is left open.
IN_HEAD = frozenset("html head base basefont bgsound link meta".split()) | frozenset(OPAQUE)
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption section article main header footer nav aside form blockquote pre figure figcaption address details summary hr fieldset body html center".split())
INLINE = frozenset("b i em strong u s small sup sub code font mark cite q span abbr time kbd var wbr big tt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of these left open ends where an article begins.
SITE = frozenset("nav header form menu".split())
#: An open one of these ends where the same begins.
SIBLINGS = frozenset("p li dt dd tr td th option".split())
#: Elements that hold running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption caption".split())
#: The fall of the sum that cuts a page, the least sum of a region, and the range of a word's score.
DROP, LEAST, WORST, MOST = 6.0, 0.5, -5.0, 1.0
#: What any tag scores at most.
TAG = -0.05

_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_BARE = re.compile(r"[^>=]*+")
_SPACE = re.compile(r"\s*+")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CLOSERS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in OPAQUE}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('', text, ''), ('<', name, attributes) and ('>', name, '') in page order, in time linear in the page.

    Comments, declarations, heads and what opaque elements hold are left out.  A
    comment, a tag or an element without markup that never ends lasts to the
    page's end; an unclosed quote doesn't count as one.
    """
    at, size, head = 0, len(page), False
    lost: set[str] = set()  # quotes and closing tags that occur no more, so that none is searched for twice
    while at < size:
        found = _MARKUP.search(page, at)
        start = found.start() if found else -1
        if not head and (text := page[at : start if start >= 0 else size]):
            yield "", text, ""
        if start < 0:
            return
        if not (m := _NAME.match(page, start)):
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")):
                if page.startswith(opening, start):
                    end = page.find(closing, start + len(opening))
                    at = size if end < 0 else end + len(closing)
                    break
            continue
        name, end = m[1].lower(), m.end()
        while True:  # the next '>' that isn't in a quoted value
            end = _BARE.match(page, end).end()
            if end >= size:
                return
            if page[end] == ">":
                break
            end = _SPACE.match(page, end + 1).end()
            if (quote := page[end : end + 1]) in ("'", '"') and quote not in lost:
                if (close := page.find(quote, end + 1)) < 0:
                    lost.add(quote)
                else:
                    end = close + 1
        at, attributes = end + 1, page[m.end() : end]
        if page[start + 1] == "/":
            if head and name == "head":
                head = False
            elif not head:
                yield ">", name, ""
            continue
        if name == "head":
            head = True
            continue
        if head and name not in IN_HEAD:
            head = False
        if name in _CLOSERS:
            if attributes.endswith("/") or name in lost:
                continue
            if closing := _CLOSERS[name].search(page, at):
                end = page.find(">", closing.end() - 1)
                at = size if end < 0 else end + 1
            elif name in OPAQUE[:4]:
                return
            else:
                lost.add(name)
        elif not head:
            yield "<", name, attributes


def own_features(name: str, attributes: str) -> list[str]:
    """What an element says of its content: its name, '.x' for each name x in class, id or role, '[hidden]'."""
    out = [] if name in INLINE else [name]
    for key, value in _ATTR.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            out += ["." + x for x in re.split(r"[^a-z0-9]+", value) if x]
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            out.append("[hidden]")
    return out


@dataclass
class Piece:
    """A run of text: its block, its words, whether a link holds it, and the features around it."""

    block: int
    text: str
    words: int
    linked: bool
    around: tuple[str, ...]
    mark: int = 0


def read(page: str) -> list[Piece | tuple[str, ...]]:
    """The pieces of text, and for each tag the features around what it opens (none for a closing one), in page order."""
    out: list[Piece | tuple[str, ...]] = []
    stack: list[tuple[str, list[str]]] = []
    held: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    every = list(tokens(page))
    article = any(kind == "<" and name in ("article", "main") for kind, name, _ in every)
    block = mark = 0

    def leave(to: int) -> None:
        while len(stack) > to:
            name, own = stack.pop()
            inside[name] -= 1
            for f in own:
                held[f] -= 1
                if not held[f]:
                    del held[f]

    for kind, name, attributes in every:
        if not kind:
            around = tuple(held)
            if article and not (inside["article"] or inside["main"]):
                around += ("~outside",)
            if not any(map(inside.__getitem__, TEXTUAL)):
                around += ("~bare",)
            out.append(Piece(block, name, len(name.split()), inside["a"] > 0, around, mark))
            continue
        if name == "bar":
            mark = 1 - mark
            continue
        if name in BLOCKS:
            block += 1
        elif name in ("br", "td", "th"):
            out.append(Piece(block, " ", 0, False, ()))
        if kind == ">":
            if inside[name] > 0:
                leave(max(i for i, (n, _) in enumerate(stack) if n == name) if stack[-1][0] != name else len(stack) - 1)
            out.append(())
            continue
        own = own_features(name, attributes)
        if name in VOID or attributes.endswith("/") or (name in INLINE and not own):
            out.append(())
            continue
        if name in ("article", "main") and any(inside[x] > 0 for x in SITE):
            leave(next(i for i, (n, _) in enumerate(stack) if n in SITE))
        elif name in SIBLINGS and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        stack.append((name, own))
        inside[name] += 1
        held.update(own)
        out.append(tuple(held) if own else ())
    return out


def shapes(units: list[Piece | tuple[str, ...]]) -> dict[int, tuple[str, str]]:
    """By block: its length and the share of its words that are links, as features."""
    words, linked = Counter(), Counter()
    for u in units:
        if isinstance(u, Piece):
            words[u.block] += u.words
            linked[u.block] += u.words * u.linked
    out = {}
    for block, n in words.items():
        share = linked[block] / n if n else 0.0
        out[block] = ("~short" if n < 5 else "~long" if n >= 15 else "~middling", "~unlinked" if not share else "~linked" if share < 0.5 else "~links")
    return out


def features(piece: Piece, shape: dict[int, tuple[str, str]]) -> tuple[str, ...]:
    """What is known of a piece; a block's length means something else outside of paragraphs and the like."""
    length, links = shape[piece.block]
    return (*piece.around, length + "~bare" if "~bare" in piece.around else length, links)


def labelled_pages(n: int = 1200, seed: int = 5) -> list[str]:
    """The pages that weights are learned from: text between bars is the article.

    A documented, bounded set made by rule: site menus, headers, footers, sidebars,
    notices, adverts, forms, sharing links and comments in their usual markup, put
    before, between and after the parts of articles in five kinds of frame.
    """
    rng = random.Random(seed)
    names = {  # fixed values: names that sites give such parts
        "menu": "menu nav navbar navigation navmenu breadcrumb breadcrumbs toolbar topbar pager pagination skip tabs categories tags",
        "header": "header masthead banner logo sitename top",
        "footer": "footer contentinfo copyright bottom legal colophon",
        "side": "sidebar complementary aside rail related recommended widget widgets teaser popular trending more",
        "notice": "notice cookie cookies consent gdpr alert popup modal overlay message paywall",
        "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsbygoogle outbrain taboola",
        "form": "newsletter subscribe subscription signup login search form contactform",
        "share": "share sharing social buttons follow",
        "comments": "comment comments respond disqus replies discussion commentlist reader",
    }
    frames = {"article": "article", "main": "main", "content": "div", "post": "div", "entry": "section", "story": "div", "text": "td", "body": "div"}
    vocabulary = "river stone window music early letter quiet garden paper engine number winter harbour teacher morning silver doctor market village second".split()

    def say(low: int, high: int) -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randint(low, high)))

    def links(k: int) -> str:
        return "".join(f"<li><a href=/x>{say(1, 3)}</a></li>" for _ in range(k))

    def chrome(kind: str) -> str:
        token = rng.choice(names[kind].split())
        attribute = rng.choice([f'class="{token}"', f"class='{token} box'", f'id="{token}"', f'class="site-{token}"', f'class="{token}_{rng.choice(["left", "wrap", "inner", "item", "block"])}"'])
        tag = rng.choice({"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "section", "p"], "advert": ["div", "div", "section", "aside", "p"], "form": ["form", "form", "div"], "share": ["div", "ul"], "comments": ["section", "div", "ol"]}[kind])
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.7
        body = {
            "menu": lambda: f"<ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.8 else " ".join(f"<a href=/y>{say(1, 2)}</a>" for _ in range(4)),
            "header": lambda: rng.choice([f"<a href=/>{say(1, 3)}</a>", f"<div><a href=/>{say(1, 2)}</a><span>{say(2, 6)}</span></div>", f"<p>{say(2, 8)}</p>", f"<h1><a href=/>{say(1, 3)}</a></h1>"]),
            "footer": lambda: rng.choice([f"&copy; {say(2, 12)}", f"<p>{say(3, 20)}</p>", f"<div>{say(2, 6)}</div><ul>{links(3)}</ul>", f"<span>{say(1, 3)}</span> <a href=/i>{say(1, 2)}</a>"]),
            "side": lambda: rng.choice([f"<h3>{say(1, 3)}</h3><ul>{links(4)}</ul>", f"<p>{say(4, 20)}</p>", f"<div><h4>{say(2, 4)}</h4><p>{say(5, 18)}</p><a href=/r>{say(1, 3)}</a></div>"]),
            "notice": lambda: rng.choice([f"{say(4, 20)} <button>{say(1, 2)}</button>", f"<p>{say(4, 25)}</p>", say(2, 15)]),
            "advert": lambda: rng.choice([say(1, 14), f"<p>{say(2, 18)}</p>", f"<a href=/ad>{say(2, 8)}</a>", f"<h3>{say(2, 4)}</h3><p>{say(4, 12)}</p>"]),
            "form": lambda: rng.choice([f"<label>{say(1, 4)}</label><input><button>{say(1, 2)}</button>", f"<p>{say(4, 14)}</p><input><select><option>{say(1, 1)}<option>{say(1, 2)}</select>", f"<textarea>{say(1, 5)}</textarea><input type=submit>"]),
            "share": lambda: rng.choice([f"<a href=/s>{say(1, 1)}</a> <a href=/t>{say(1, 1)}</a>", f"<span>{say(1, 3)}</span>", links(3)]),
            "comments": lambda: f"<h3>{say(1, 3)}</h3>" + "".join(rng.choice([f"<div class=comment-body><p>{say(3, 40)}</p></div>", f"<li class=comment><b>{say(1, 2)}</b><p>{say(4, 30)}</p></li>", f"<article class=comment><header>{say(1, 2)}</header><p>{say(3, 35)}</p></article>", f"<p>{say(4, 30)}</p>"]) for _ in range(rng.randint(1, 3))),
        }[kind]()
        hidden = rng.choice([" hidden", " aria-hidden=true", ' style="display:none"']) if rng.random() < 0.06 else ""
        return f"<{tag}{'' if plain else ' ' + attribute}{hidden}>{body}</{tag}>"

    def passage() -> str:
        inline = rng.choice(["<b>%s</b>", "<i>%s</i>", "<em>%s</em>", "<strong>%s</strong>", "<a href=/z>%s</a>", "%s"]) % say(1, 3)
        return rng.choice([
            lambda: f"<p>{say(1, 6)}</p>", lambda: f"<p>{say(6, 40)}</p>", lambda: f"<p>{say(10, 60)}</p>", lambda: f"<p>{say(2, 12)} {inline} {say(2, 12)}<br>{say(1, 9)}", lambda: f"<p>{say(3, 20)}",
            lambda: f"<h2>{say(1, 6)}</h2>", lambda: f"<h3>{say(1, 8)}</h3><p>{say(4, 30)}</p>", lambda: f"<ul>{''.join(f'<li>{say(1, 14)}</li>' for _ in range(3))}</ul>", lambda: f"<ol><li>{say(2, 9)}<li><a href=/q>{say(1, 3)}</a> {say(2, 8)}</ol>",
            lambda: f"<blockquote><p>{say(4, 25)}</p></blockquote>", lambda: f"<pre>{say(2, 20)}</pre>", lambda: f"<table><tr><th>{say(1, 2)}</th><td>{say(1, 4)}</td></tr><tr><td>{say(1, 3)}</td><td>{say(1, 5)}</td></tr></table>",
            lambda: f"<figure><img src=x><figcaption>{say(2, 10)}</figcaption></figure>", lambda: f"<div>{say(8, 40)}</div>", lambda: f"<div><p>{say(5, 30)}</p></div>", lambda: f"<dl><dt>{say(1, 2)}<dd>{say(3, 9)}</dl>", lambda: f"<p>{say(1, 4)} <a href=/w>{say(2, 8)}</a></p>", lambda: f"<p><a href=/v>{say(3, 9)}</a></p>",
        ])()

    pages = []
    for i in range(n):
        label, tag = list(frames.items())[i % len(frames)]
        attribute = "" if tag in ("article", "main") else f' class="{label}{rng.choice(["", "", " box", "-wrap", "-inner", " item", "-block", " site-left"])}"' if rng.random() < 0.6 else f' id="{label}-{rng.choice(["body", "content", "main", "text", "article"])}"' if rng.random() < 0.5 else ""
        before = "".join(chrome(k) for k in rng.sample(["header", "menu", "menu", "notice", "advert", "form", "share"], rng.randint(1, 4)))
        after = "".join(chrome(k) for k in rng.sample(["comments", "side", "side", "share", "advert", "form", "menu", "footer", "footer"], rng.randint(1, 5)))
        title = f"|<h1>{say(1, 9)}</h1>|"
        if tag in ("article", "main") and rng.random() < 0.4:
            title = f"<header>{title}</header>"
        elif rng.random() < 0.3:
            title = f"<div class=article-header>{title}</div>"
        parts = [title]
        for _ in range(rng.randint(1, 7)):
            parts.append(f"|{passage()}|")
            if rng.random() < 0.4:
                parts.append(chrome(rng.choice(["advert", "advert", "side", "share", "notice", "form"])))
        if rng.random() < 0.2:
            parts.append(chrome("comments"))
        framed = f"<{tag}{attribute}>{''.join(parts)}</{tag}>"
        if tag == "td":
            framed = f"<table><tr><td>{chrome('menu')}</td>{framed}</tr></table>"
        if rng.random() < 0.4:
            framed = f'<div class="{rng.choice(["page", "wrapper", "container", "main", "layout"])}"><div>{framed}</div></div>'
        bare = rng.choice(["", f"<div>{links(3)}</div>", f"<div><span>{say(1, 2)}</span><span>{say(1, 2)}</span></div>", f"<div><a href=/m>{say(1, 2)}</a></div>"])
        pages.append(f"<html><body>{before}{bare}{framed}{bare}{after}</body></html>".replace("|", "<bar>"))
    return pages


def learn_weights(pages: list[str], ridge: float = 0.05, rounds: int = 12) -> dict[str, float]:
    """Weights of features by logistic regression of 'this piece is the article's', on the pieces of labelled pages."""
    seen, labels, sizes = [], [], []
    for page in pages:
        units = read(page)
        shape = shapes(units)
        for u in units:
            if isinstance(u, Piece) and u.words:
                seen.append({"~any", *features(u, shape)})
                labels.append(u.mark)
                sizes.append(u.words**0.5)
    names = sorted(set().union(*seen)) if seen else []
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for i, fs in enumerate(seen):
        x[i, [at[f] for f in fs]] = 1
    y, s, w = np.array(labels, float), np.array(sizes), np.zeros(len(names))
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names))
        w = w + np.linalg.solve(h, x.T @ (s * (y - p)) - ridge * w)
    return {f: round(float(v), 6) for f, v in zip(names, w, strict=True)}


@cache
def default_weights() -> dict[str, float]:
    return learn_weights(labelled_pages())


def score(units: list[Piece | tuple[str, ...]], weights: dict[str, float]) -> list[float]:
    """The score of each unit: of a piece, its words times what their surroundings weigh; of a tag, TAG and what a word there weighs if that is negative."""
    shape, get, out = shapes(units), weights.get, []
    for u in units:
        if not isinstance(u, Piece):
            out.append(TAG + max(WORST, min(0.0, sum(get(f, 0.0) for f in u))))
        elif not u.words:
            out.append(0.0)
        else:
            total = get("~any", MOST) + sum(get(f, 0.0) for f in features(u, shape))
            out.append(u.words * max(WORST, min(MOST, total)))
    return out


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """Start, end and sum of the contiguous run of the highest sum, the first and shortest of ties; (0, 0, 0) if none is positive."""
    best, total, first = (0, 0, 0.0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best[2]:
            best = (first, i + 1, total)
    return best


def regions(scores: list[float], drop: float = DROP, least: float = LEAST) -> list[tuple[int, int]]:
    """The best region of each part of the page; it is cut where scores that aren't positive follow each other and sum to -drop or less."""
    out, start, i, n = [], 0, 0, len(scores)
    while i <= n:
        j, fall = i, 0.0
        while j < n and scores[j] <= 0:
            fall += scores[j]
            j += 1
        if fall <= -drop or j == n:
            a, b, total = best_region(scores[start:i])
            if total >= least:
                out.append((start + a, start + b))
            start = j
        i = j + 1
    return out


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The article's text: white space in a block becomes one space, blocks are joined by one newline."""
    if not page:
        return ""
    units = read(page)
    weights = default_weights() if weights is None else weights
    found = regions(score(units, weights))
    if not found:  # a form may hold the whole page
        found = regions(score(units, {f: w for f, w in weights.items() if f != "form"}))
    if not found:  # no word is in favour: then all are, but those in elements that are chrome by their very name
        found = regions(score(units, {f: w for f, w in weights.items() if f[0] not in ".~" and f != "form" and w < -1}))
    joined: dict[int, list[str]] = {}
    for a, b in found:
        for u in units[a:b]:
            if isinstance(u, Piece):
                joined.setdefault(u.block, []).append(u.text)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in joined.values())
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, html_col: str = "html", outcome: str = "main_text", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of pages with a string column ``outcome``, the main text.

    Null or empty html, and pages without words in favour, give an empty text.
    Markup that is broken off or never closed is read as far as it goes, in time
    linear in the page.  If no region is found, forms count as
    any element; if there still is none, all words are in favour but those in
    elements like nav and footer.  Other columns pass through; the outcome column gets underscores
    appended if its name is taken.  A row is judged by itself: one pass without a
    shuffle; the weights, some hundreds, are sent along.
    """
    (name,) = fresh(pages.columns, outcome)
    learned = default_weights() if weights is None else weights

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([extract(t.as_py(), learned) for t in texts], pa.string())

    return pages.withColumn(name, F.arrow_udf(run, "string")(named(html_col)))

"""Pages laid out by rule around given texts, every element labelled, to train the node model on.

A page is an article and what stands around it: menus, headers, footers, sidebars, notices, adverts,
forms, share bars and reader comments. Families of layouts differ in how much their markup tells:
elements named for their purpose, classes named for it, classes that say nothing, bare ``div``s,
tables that place the columns, and pages whose article is a line or two.
"""

from __future__ import annotations

import html as html_lib
import random

FAMILIES = ("named", "classed", "hashed", "bare", "table", "short", "flat")

_FILLER = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split()
_KEEP, _DROP = 'data-lumaspec="1"', 'data-lumaspec="0"'

# Class names and headings that pages use for each part, in several languages.
CLASSES = {
    "main": "content post entry-content article-body story main page-content post-body",
    "nav": "menu navbar site-nav breadcrumbs main-menu nav topnav",
    "header": "header masthead top-bar page-header site-head",
    "footer": "footer site-footer copyright legal",
    "side": "sidebar related widget right-rail recommended",
    "ad": "ad ads advert ad-slot sponsored promo banner advertisement",
    "notice": "cookie-notice notice consent alert cookie-banner gdpr popup newsletter-modal",
    "form": "search newsletter subscribe login",
    "share": "share social share-bar follow-us",
    "comments": "comments comment-list discussion replies",
}
HEADINGS = {
    "side": ("Related", "Related posts", "Popular", "More from us", "Categories", "Archive", "Tags", "Mehr zum Thema", "Articles liés", "Relacionados"),
    "comments": ("Comments", "3 comments", "Leave a reply", "Discussion", "Responses", "Kommentare", "Commentaires", "Comentarios"),
    "footer": ("© 2021", "&copy; 2019", "Copyright 2020", "All rights reserved.", "(c) 2018", "&copy;", "Impressum"),
    "ad": ("Advertisement", "Sponsored", "Ad:", "Anzeige", "Publicité", "Publicidad"),
    "notice": ("We use cookies.", "This site uses cookies", "Cookies", "Notice:", "Wir verwenden Cookies", "Nous utilisons des cookies"),
    "form": ("Subscribe to our newsletter", "Search", "Sign up", "Log in", "Newsletter", "Anmelden"),
    "share": ("Share this", "Follow us", "Tweet", "Teilen", "Partager"),
}


class Layout:
    """Draws one page; ``told`` says whether markup names a part's purpose."""

    def __init__(self, rng: random.Random, texts: list[str], family: str):
        self.rng, self.texts, self.family = rng, texts, family
        self.named = family == "named" or (family in ("short", "flat") and rng.random() < 0.6)
        self.told = self.named or family in ("classed", "short")

    def one(self, *what):
        return self.rng.choice(what)

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        rng = self.rng
        found = rng.choice(self.texts).split() if self.texts and self.odds(0.9) else []
        if not found:
            found = rng.choices(_FILLER, k=hi)
        at = rng.randrange(max(1, len(found) - lo))
        return html_lib.escape(" ".join(found[at : at + rng.randint(lo, hi)]), quote=False)

    def link(self, hi: int = 2) -> str:
        return f'<a href="/{self.rng.randrange(99)}">{self.words(1, hi)}</a>'

    def attrs(self, kind: str) -> str:
        """Class or id of a part, as far as the family tells."""
        if self.told and self.odds(0.85):
            name = self.one(*CLASSES[kind].split()) if kind in CLASSES else ""
            return f' {self.one("class", "class", "id")}="{name}{self.one("", "", " x1", " clearfix")}"' if name else ""
        if self.family in ("hashed", "table") and self.odds(0.7):
            return f' class="{self.one("css-", "sc-", "x", "u")}{self.rng.randrange(1 << 20):x}"'
        return ""

    def box(self, kind: str, tags: str, inner: str, keep: bool = False) -> str:
        tag = self.one(*tags.split()) if self.named else "div"
        return f"<{tag} {_KEEP if keep else _DROP}{'' if tag in ('nav', 'aside', 'header', 'footer', 'article', 'main') and self.odds(0.6) else self.attrs(kind)}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        many = [self.link() for _ in range(n)]
        return self.one(
            lambda: f"<ul {_DROP}>" + "".join(f"<li {_DROP}>{a}</li>" for a in many) + "</ul>",
            lambda: self.one(" ", " | ", " &middot; ", "").join(many),
            lambda: "".join(f"<div {_DROP}>{a}</div>" for a in many) if not self.told else "<br>".join(many),
            lambda: f"<p {_DROP}>" + self.one(" ", " | ").join(many) + "</p>",
        )()

    def head(self, kind: str) -> str:
        """What says in words what a part is; needed where the markup doesn't."""
        if kind not in HEADINGS or (self.told and self.odds(0.5)):
            return self.words(1, 4)
        return self.one(*HEADINGS[kind]) + self.one("", "", f" {self.words(1, 3)}")

    def line(self, lo: int = 5, hi: int = 30) -> str:
        return self.words(lo, hi)

    def drop(self, kind: str) -> str:
        rng = self.rng
        p = lambda text: f"<p {_DROP}>{text}</p>"
        h = lambda text: f"<h{(n := rng.choice((2, 3, 3, 4)))} {_DROP}>{text}</h{n}>"
        if kind == "nav":
            return self.box(kind, "nav nav nav div ul" if self.odds(0.8) else "menu", self.links(rng.randint(2, 10)))
        if kind == "header":
            title = self.words(1, 5)
            inner = self.one(f"<h1 {_DROP}>{title}</h1>" if self.told else f'<a href="/">{title}</a>', p(f'<a href="/">{title}</a>'), f'<a href="/">{title}</a>') + self.one("", p(self.words(1, 6)) if self.told else "")
            return self.box(kind, "header header div", inner)
        if kind == "footer":
            inner = self.one(f"{self.head(kind)} &middot; {self.line()}", p(f"{self.head(kind)} {self.line(2, 15)}"), p(self.head(kind)) + self.links(4), f"{self.head(kind)} {self.link()} {self.link()}", self.head(kind))
            return self.box(kind, "footer footer footer div", inner) if self.odds(0.9) or self.told else p(f"{self.one(*HEADINGS['footer'])} {self.line(2, 10)}")
        if kind == "side":
            inner = h(self.head(kind)) + self.one(self.links(5), self.links(4) if not self.told else p(self.line()) + p(self.line()), p(f"{self.line(3, 12)} {self.link(5)}"))
            return self.box(kind, "aside aside section div", inner)
        if kind == "ad":
            text = f"{self.one(*HEADINGS['ad'])} {self.line(3, 14)}" if not self.told or self.odds(0.2) else self.line()
            return self.box(kind, "aside div div section", self.one(text, p(text), f"{text} {self.link(6)}")) if not self.named or self.odds(0.5) else f'<div {_DROP} class="{self.one(*CLASSES["ad"].split())}">{self.one(text, p(text))}</div>'
        if kind == "notice":
            inner = self.one(f"{self.head(kind)} {self.line(3, 16)}", p(f"{self.head(kind)} {self.line(3, 16)}")) + self.one("", f"<button>{self.words(1, 2)}</button>")
            return self.box(kind, "div div aside section", inner) if not self.named else f'<div {_DROP} {self.one("class", "class", "id", "role")}="{self.one(*CLASSES["notice"].split())}">{inner}</div>'
        if kind == "form":
            inner = f"<label>{self.head(kind)}</label><input name='q'>" + self.one("", p(self.line(3, 12))) + self.one("<button>ok</button>", '<input type="submit">')
            return self.one(f"<form {_DROP}>{inner}</form>", f"<form {_DROP}{self.attrs(kind)} action='/f'>{inner}</form>", self.box(kind, "div", f"<form {_DROP}>{inner}</form>"))
        if kind == "share":
            return self.box(kind, "div ul", self.one("", f"<b>{self.one(*HEADINGS['share'])}</b> ") + self.links(rng.randint(2, 5)))
        if kind == "hidden":
            return f'<div {_DROP} {self.one("hidden", "style=\"display:none\"", "aria-hidden=\"true\"")}>{p(self.line())}</div>'
        body = lambda: self.one(p(self.line()), p(self.line()) + p(self.line()), self.line())
        name = lambda: f"<b>{self.words(1, 2)}</b> " + self.one("", f"{self.link(1)} ")
        reply = lambda: self.one("", '<a href="#r">Reply</a>', '<a href="#r">reply</a>')
        kinds = [lambda: f"<div {_DROP}>{name()}{body()}{reply()}</div>"]
        if self.told:
            kinds += [lambda: f'<div {_DROP} class="comment">{body()}</div>', lambda: f"<li {_DROP}>{body()}</li>", lambda: f'<article {_DROP} class="comment">{body()}</article>']
        many = "".join(rng.choice(kinds)() for _ in range(rng.randint(1, 6)))
        said = h(self.one(*HEADINGS["comments"])) if not self.told or self.odds(0.5) else self.one("", h(self.words(1, 3)))
        if self.named:
            return f'<section {_DROP} {self.one("class", "id")}="{self.one(*CLASSES["comments"].split())}">{said}{many}</section>'
        return f"<div {_DROP}{self.attrs('comments')}>{said}{many}</div>"

    def para(self) -> str:
        kind, rng = self.rng.random(), self.rng
        text = self.words(2, 6) if self.odds(0.12) else self.words(6, 160)
        if self.odds(0.2):  # links within sentences, sometimes many
            most = self.one(3, 9)
            text = " ".join(f"{self.words(1, most)} {self.link(7)}" for _ in range(rng.randint(1, 6))) + f" {self.words(2, 20)}"
        if self.odds(0.06 if self.told else 0.02):  # words of menus and footers may stand in an article, too
            text = self.one(*HEADINGS[self.one(*HEADINGS)]) + self.one("", f" {self.words(1, 30)}")
        if self.odds(0.15):
            text = f"<{(t := self.one('b', 'em', 'strong', 'span'))}>{self.words(1, 4)}</{t}> {text}"
        tag = "div" if self.family in ("bare", "hashed", "table") and self.odds(0.4) else "p"
        if kind < 0.68:
            return f"<{tag} {_KEEP}{self.attrs('') if tag == 'div' else ''}>{text}" + ("</div>" if tag == "div" else self.one("</p>", "</p>", "</p>", ""))
        if kind < 0.76:
            return f"<h{(n := self.one(2, 2, 3, 4))} {_KEEP}>{self.words(1, 8)}</h{n}>"
        if kind < 0.82:
            item = lambda: self.words(2, 20) + self.one("", "", f" {self.link()}")
            return f"<{(t := self.one('ul', 'ul', 'ol'))} {_KEEP}>" + "".join(f"<li {_KEEP}>{item()}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if kind < 0.86:
            return f"<blockquote {_KEEP}><p {_KEEP}>{text}</p></blockquote>"
        if kind < 0.9:
            row = lambda: f"<tr {_KEEP}>" + "".join(f"<td {_KEEP}>{self.words(1, 4)}</td>" for _ in range(2)) + "</tr>"
            return f"<table {_KEEP}>{''.join(row() for _ in range(rng.randint(2, 4)))}</table>"
        if kind < 0.93:
            return f"<figure {_KEEP}><img src='x'><figcaption {_KEEP}>{self.words(2, 12)}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre {_KEEP}>{self.words(2, 30)}</pre>"
        return f"<section {_KEEP}><h2 {_KEEP}>{self.words(1, 6)}</h2><p {_KEEP}>{text}</p></section>"

    def article(self) -> str:
        rng = self.rng
        title = f"<h1 {_KEEP}>{self.words(2, 12)}</h1>" if self.odds(0.85) else ""
        if title and self.named and self.odds(0.12):
            title = f"<header {_KEEP}>{title}</header>"
        if self.family == "short":
            return (title if self.odds(0.4) else "") + "".join(f"<p {_KEEP}>{self.words(1, 25)}{self.one('</p>', '')}" for _ in range(self.one(1, 1, 2)))
        many = rng.choice([1, 1, 2, 3, 4, 6, 9, 14])
        if self.family in ("bare", "table") and self.odds(0.25):  # lines of text, not elements
            return title + "<br><br>".join(self.words(10, 90) for _ in range(many))
        body = title
        for _ in range(many):
            body += self.para()
            if self.odds(0.07):
                body += self.drop(self.one("ad", "side", "form", "share", "notice", "hidden"))
        return body + (self.drop("comments") if self.odds(0.1) else "")

    def page(self) -> str:
        body, f = self.article(), self.family
        before = "".join(self.drop(k) for k in ("notice", "header", "nav", "ad", "form") if self.odds(0.45))
        after = "".join(self.drop(k) for k in ("share", "side", "ad", "comments", "form", "notice", "hidden", "footer") if self.odds(0.35))
        if f == "table":
            cell = lambda keep, inner: f"<td {_KEEP if keep else _DROP}>{inner}</td>"
            row = lambda keep, inner: f"<tr {_KEEP if keep else _DROP}>{inner}</tr>"
            columns = [cell(True, body)]
            if self.odds(0.7):
                columns.insert(0, cell(False, self.one(self.links(6), self.drop("nav"), self.drop("side"))))
            if self.odds(0.4):
                columns.append(cell(False, self.one(self.drop("side"), self.drop("ad"))))
            rows = (row(False, cell(False, self.drop("header") + self.drop("nav"))) if self.odds(0.6) else "") + row(True, "".join(columns))
            rows += row(False, cell(False, self.one(f"{self.head('footer')} {self.line(2, 12)}", self.drop("footer")))) if self.odds(0.6) else ""
            whole = f"<table {_KEEP}>{self.one(rows, f'<tbody {_KEEP}>{rows}</tbody>')}</table>" + ("" if self.odds(0.7) else after)
        elif f in ("short", "flat"):
            wrap = self.one(body, body, f"<{(t := self.one('main', 'article', 'div'))} {_KEEP}>{body}</{t}>")
            whole = (self.drop("nav") if self.odds(0.6) else before) + wrap + (self.drop("footer") if self.odds(0.6) else after)
        else:
            if f == "named":
                main = self.one(f"<article {_KEEP}>{body}</article>", f"<article {_KEEP}>{body}</article>", f"<main {_KEEP}>{body}</main>", f"<main {_KEEP}><article {_KEEP}>{body}</article></main>", f"<section {_KEEP}>{body}</section>")
            else:
                main = f"<div {_KEEP}{self.attrs('main')}>{body}</div>"
                main = main if self.odds(0.6) else f"<div {_KEEP}>{main}</div>"
            whole = before + main + after
            if self.odds(0.35):
                whole = before + f'<div {_KEEP}{self.attrs("") or " class=\"wrapper\"" * self.told}>{self.drop(self.one("side", "nav", "ad"))}{main}{after}</div>' + self.drop("footer")
        return f"<html><head><title>{self.words(1, 6)}</title></head><body>{whole}</body></html>"


def training_page(rng: random.Random, texts: list[str], families: tuple[str, ...] = FAMILIES) -> str:
    """A page of one of the families; every element says whether it is main text."""
    often = [f for f in families if f in ("named", "classed")]
    return Layout(rng, texts, rng.choice([*families, *often])).page()

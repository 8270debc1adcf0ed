"""Pages of known layout to train the extractor on, drawn from a rule and a seed."""

from __future__ import annotations

import random

_SYLLABLES = "an be ca do el fi go hu in jo ka lu me no or pa qui ro su te un va wi xe yo".split()


class Layouts:
    """Draws pages; each has its HTML and the texts of its main text's blocks."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join(
            "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))
        )

    def prose(self, low: int = 1, high: int = 7) -> str:
        parts = (self.words(3, 22).capitalize() for _ in range(self.rng.randint(low, high)))
        return " ".join(p + self.rng.choice(".....!?") for p in parts)

    def pick(self, *names: str) -> str:
        return self.rng.choice(names)

    def tagged(self, tags: tuple[str, ...], names: tuple[str, ...], inner: str, plain: float = 0.25) -> str:
        tag = self.pick(*tags)
        kind = self.pick("class", "class", "id")
        named = "" if self.rng.random() < plain and tag != "div" else f' {kind}="{self.pick(*names)}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def links(self, low: int, high: int, tag: str = "li") -> str:
        items = (
            f'<{tag}><a href="/{i}">{self.words(1, 4)}</a></{tag}>' for i in range(self.rng.randint(low, high))
        )
        return "".join(items)

    def kept(self, tag: str, text: str, inner: str | None = None) -> str:
        self.main.append(text)
        end = "" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{inner or text}{end}"

    def paragraph(self) -> str:
        text = self.prose() if self.rng.random() < 0.8 else self.words(1, 12) + "."
        words = text.split(" ")
        inner = None
        if self.rng.random() < 0.3 and len(words) > 4:
            at = self.rng.randrange(len(words) - 2)
            tag = self.pick("b", "em", 'a href="/x"', "span", "i")
            marked = f"<{tag}>{words[at]} {words[at + 1]}</{tag.split()[0]}>"
            inner = " ".join([*words[:at], marked, *words[at + 2 :]])
        return self.kept("p", text, inner)

    def title(self) -> str:
        """The article's title, often in a header of its own with a line below it."""
        inner = self.kept("h1", self.words(2, 10))
        if self.rng.random() < 0.5:
            return inner
        if self.rng.random() < 0.3:
            inner += self.kept("p", self.prose(1, 2))
        names = ("entry-header", "post-header", "article-header", "header", "headline", "title")
        return self.tagged(("header", "header", "div"), names, inner, 0.6)

    def article(self) -> str:
        rng = self.rng
        parts = [self.title()] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 1, 2, 4, 8, 20))):
            kind = rng.random()
            if kind < 0.75:
                parts.append(self.paragraph())
            elif kind < 0.82:
                parts.append(self.kept(self.pick("h2", "h3"), self.words(1, 7)))
            elif kind < 0.88:
                items = "".join(self.kept("li", self.prose(1, 2)) for _ in range(rng.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{self.kept('p', self.prose())}</blockquote>")
            elif kind < 0.94:
                parts.append(f"<figure><img src=x>{self.kept('figcaption', self.words(2, 9))}</figure>")
            elif kind < 0.96:
                parts.append(self.tagged(("aside", "div"), ("related", "promo", "ad", "newsletter", "share"), self.links(1, 3, "p"), 0))
            else:
                cells = "".join(f"<tr>{self.kept('td', self.words(1, 3))}{self.kept('td', self.words(1, 3))}</tr>" for _ in range(3))
                parts.append(f"<table>{cells}</table>")
        inner = "".join(parts)
        if rng.random() < 0.25:
            inner = f"<div>{inner}</div>"
        inner += "".join(p() for p in (self.share, self.advert, self.notice, self.footer) if rng.random() < 0.08)
        if rng.random() < 0.35:
            inner += self.comments()
        names = ("content", "post-content", "entry-content", "article-body", "story", "main", "post", "text", "page", "x1", "wrap")
        return self.tagged(("article", "main", "div", "div", "section"), names, inner)

    def menu(self) -> str:
        inner = f"<ul>{self.links(3, 12)}</ul>" if self.rng.random() < 0.7 else self.links(3, 9, "span")
        return self.tagged(("nav", "nav", "div"), ("menu", "main-nav", "navbar", "breadcrumbs", "topmenu"), inner)

    def header(self) -> str:
        inner = self.pick("", f'<a href="/"><img src=l></a>') + f"<{self.pick('h1', 'h2', 'p', 'div')}>{self.words(1, 5)}"
        return self.tagged(("header", "div"), ("header", "site-header", "masthead", "top"), inner + self.pick("", self.menu()))

    def footer(self) -> str:
        inner = f"<p>&copy; {self.words(1, 6)} &middot; {self.pick(self.prose(1, 2), self.words(2, 8))}</p>"
        return self.tagged(("footer", "footer", "div"), ("footer", "site-footer", "copyright"), self.pick(inner, inner[3:-4], inner + f"<ul>{self.links(2, 6)}</ul>"))

    def sidebar(self) -> str:
        teasers = "".join(f'<li><a href="/t">{self.words(3, 9)}</a><p>{self.prose(1, 2)}</p></li>' for _ in range(self.rng.randint(1, 5)))
        inner = f"<h3>{self.words(1, 3)}</h3><ul>{self.pick(teasers, self.links(3, 10))}</ul>"
        return self.tagged(("aside", "aside", "div"), ("sidebar", "widget", "related-posts", "rail", "popular"), inner)

    def advert(self) -> str:
        return self.tagged(("div", "div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"), self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/b">{self.words(3, 12)}</a>'), 0)

    def notice(self) -> str:
        inner = f"<p>{self.prose(1, 4)}</p><button>{self.words(1, 2)}</button>"
        return self.tagged(("div", "section", "aside"), ("cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "notice", "modal"), self.pick(inner, self.prose(1, 3)), 0)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=f>" for _ in range(self.rng.randint(1, 4)))
        inner = f"<p>{self.prose(1, 2)}</p>{fields}<button>{self.words(1, 2)}</button>"
        return self.tagged(("form",), ("search", "newsletter", "login", "signup"), inner)

    def share(self) -> str:
        return self.tagged(("div", "ul"), ("share", "social-links", "sharing"), self.links(2, 5, "span"), 0)

    def comments(self) -> str:
        tag = self.pick("li", "div", "article")
        posts = "".join(f'<{tag} class="{self.pick("comment", "reply", "comment-body")}"><span>{self.words(1, 2)}</span><p>{self.prose(1, 5)}</p></{tag}>' for _ in range(self.rng.randint(1, 6)))
        inner = f"<h3>{self.words(1, 3)}</h3>" + (f"<ul>{posts}</ul>" if tag == "li" else posts)
        return self.tagged(("div", "section", "aside"), ("comments", "comment-list", "discussion", "disqus_thread", "reader-comments"), inner, 0)

    def page(self) -> tuple[str, list[str]]:
        rng, self.main = self.rng, []
        before = [p() for p in (self.notice, self.header, self.menu, self.advert, self.share, self.form, self.sidebar) if rng.random() < 0.4]
        rng.shuffle(before)
        middle = self.article()
        if rng.random() < 0.3:
            middle = f'<div class="{self.pick("container", "wrapper", "row", "site")}">{middle}{self.pick("", self.sidebar())}</div>'
        after = [p() for p in (self.share, self.comments, self.sidebar, self.advert, self.form, self.footer, self.notice, self.menu) if rng.random() < 0.4]
        body = "".join(before) + middle + "".join(after)
        if rng.random() < 0.3:
            body = f'<div id="{self.pick("page", "root", "wrap")}">{body}</div>'
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}<script>var a='<p>';</script></body></html>", list(self.main)

"""Pages as trees of block nodes, with the features that the extractor judges them by."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s "
    "samp small span strike strong sub sup time tt u var img br wbr".split()
)
HIDDEN = frozenset("head title script style noscript template svg math object iframe canvas".split())
CONTROLS = frozenset("input button select textarea option".split())
#: An element of the first kind ends an open element of the second.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"),
}
#: What may stand in a head; any other element, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes".split())
#: Elements that start a language of their own, what ends them, and what holds HTML in them.
FOREIGN = frozenset("svg math".split())
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
    "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SCOPES = frozenset("table ul ol dl div section article main aside nav header footer form body td th".split())

#: Words in class, id and role attributes, by what they usually stand for.
MEANINGS = {
    "content": "article post entry content story body main text blog page prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip links",
    "head": "header masthead top logo branding banner hero site",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar aside side rail widget related recommended popular trending more teaser tags",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion commercial dfp outbrain taboola",
    "comment": "comment comments discussion reply replies respond disqus thread reader readers feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner paywall warning",
    "share": "share social sharing follow twitter facebook",
    "form": "form search login signup subscribe newsletter register input contact",
}
_WORD = {w: k for k, words in enumerate(MEANINGS.values()) for w in words.split()}
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TAGS = (
    ("article", "main"), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"),
    ("li", "dt", "dd"), ("ul", "ol", "dl"), ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("form", "fieldset"), ("table", "tr", "td", "th", "tbody", "thead"), ("blockquote", "pre"),
    ("figure", "figcaption"), ("body", "html"), ("#text",),
)
_TAG = {tag: k for k, group in enumerate(TAGS) for tag in group}
_ENDS = re.compile(r"[.!?;:,]")

#: Names of the features, in order.
FEATURES = (
    "chars", "words", "links", "marks", "blocks", "mean_block", "longest_block", "elements", "controls",
    "share", "start", "depth", "place", "siblings", "sibling_chars", "sibling_share", "parent_links",
    "parent_blocks", "items", "same_tag", "parent_mean_block", "over_links", "over_mean_block",
    "parent_share",
    *(f"tag_{group[0]}" for group in TAGS), *(f"parent_{group[0]}" for group in TAGS),
    *(f"own_{m}" for m in MEANINGS), *(f"above_{m}" for m in MEANINGS),
)


class Page(HTMLParser):
    """The block elements and text blocks of a page, parents before children.

    Text blocks are leaves: the text between two block boundaries, white space made one
    space and trimmed. Unclosed and wrongly nested elements end where HTML ends them.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = ["#root"]
        self.parents = [-1]
        self.meanings: list[frozenset[int]] = [frozenset()]
        self.texts: list[str | None] = [None]
        self.linked = [0]
        self.controls = [0]
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.buffer: list[str] = []
        self.link_chars = 0
        self.hidden = 0
        self.foreign = 0
        self.links = 0
        self.feed(html)
        self.close()
        self.flush()

    def _node(self, tag: str, meanings: frozenset[int], text: str | None = None, linked: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(next(n for t, n in reversed(self.open) if n >= 0))
        self.meanings.append(meanings)
        self.texts.append(text)
        self.linked.append(linked)
        self.controls.append(0)
        return len(self.tags) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self._node("#text", frozenset(), text, min(self.link_chars, len(text)))
        self.buffer, self.link_chars = [], 0

    def _end(self, at: int) -> None:
        """End the open elements from this place of the stack on."""
        for tag, node in self.open[at:]:
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in FOREIGN
            self.links -= tag == "a"
        if any(node >= 0 for _, node in self.open[at:]):
            self.flush()
        del self.open[at:]

    def _end_nearest(self, tags: tuple[str, ...]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in tags:
                self._end(at)
                return
            if tag in SCOPES and tag not in tags:
                return

    def _end_head(self, tag: str) -> None:
        """End an open head that this element does not belong to; body ends also what is open in it."""
        if tag == "body":
            at = next((k for k, (t, _) in enumerate(self.open) if t in ("head", "template")), 0)
            if self.open[at][0] == "head":
                self._end(at)
        elif self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._end(len(self.open) - 1)

    def _end_foreign(self) -> None:
        """End the open svg and math elements up to one that holds HTML."""
        first = 0
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in HOLDS:
                break
            if self.open[at][0] in FOREIGN:
                first = at
        if first:
            self._end(first)

    def handle_starttag(self, tag, attrs) -> None:
        if self.foreign and tag in BREAKS:
            self._end_foreign()
        if self.hidden:
            self._end_head(tag)
        if tag in CONTROLS:
            self.controls[next(n for _, n in reversed(self.open) if n >= 0)] += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            else:
                self.buffer.append(" ")
            return
        if tag in INLINE:
            self.open.append((tag, -1))
            self.links += tag == "a"
            return
        if tag in ENDS:
            self._end_nearest(ENDS[tag])
        if tag not in HIDDEN and tag not in CONTROLS:
            self._end_nearest(("p",))
        self.flush()
        found = set()
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                found.update(_WORD[w] for w in map(str.lower, _TOKENS.findall(value)) if w in _WORD)
        self.open.append((tag, self._node(tag, frozenset(found))))
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN

    def handle_startendtag(self, tag, attrs) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)
            if tag in FOREIGN:
                self._end(len(self.open) - 1)

    def handle_endtag(self, tag) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._end(at)
                return
            if tag in INLINE and self.open[at][1] >= 0:
                return

    def handle_data(self, data) -> None:
        if self.open[-1][0] == "head" and data.strip():
            self._end(len(self.open) - 1)
        if not self.hidden and not any(tag in CONTROLS for tag, _ in self.open[-2:]):
            self.buffer.append(data)
            if self.links:
                self.link_chars += len(data.strip())


class Forest:
    """The nodes of several pages as arrays; parents stand before their children."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = [len(page.tags) for page in pages]
        ends = np.cumsum(sizes)
        self.bounds = list(zip((ends - sizes).tolist(), ends.tolist()))
        self.roots = np.repeat(ends - sizes, sizes)
        self.parents = np.concatenate([page.parents for page in pages]) + self.roots
        self.parents[ends - sizes] = ends - sizes
        self.tags = np.array([_TAG.get(t, len(TAGS)) for page in pages for t in page.tags])
        self.items = np.array([t == "li" for page in pages for t in page.tags], float)
        self.texts = [t for page in pages for t in page.texts]
        self.linked = np.concatenate([page.linked for page in pages]).astype(float)
        self.controls = np.concatenate([page.controls for page in pages]).astype(float)
        self.meanings = [m for page in pages for m in page.meanings]
        depth = np.zeros(len(self.parents), np.int64)
        at = self.parents
        while (moving := at != self.roots).any():
            depth += moving
            at = self.parents[at]
        depth += np.arange(len(depth)) != self.roots
        self.depth = depth
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]

    def features(self) -> np.ndarray:
        """One row of FEATURES per node."""
        n, parents, levels = len(self.parents), self.parents, self.levels
        sizes = np.array([len(t) if t is not None else 0 for t in self.texts], float)
        held = np.array([t is not None for t in self.texts], float)
        total = np.column_stack(
            [
                sizes,
                [t.count(" ") + 1 if t is not None else 0 for t in self.texts],
                np.minimum(self.linked, sizes),
                [len(_ENDS.findall(t)) if t is not None else 0 for t in self.texts],
                held,
                self.controls,
                np.ones(n),
                self.items,
            ]
        )
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before -= before[self.roots]
        longest, biggest, children = sizes.copy(), np.zeros(n), np.zeros(n)
        for level in reversed(levels):
            up = parents[level]
            np.add.at(total, up, total[level])
            np.maximum.at(longest, up, longest[level])
            np.maximum.at(biggest, up, total[level, 0])
            np.add.at(children, up, 1)
        named = np.zeros((n, len(MEANINGS)))
        for k, found in enumerate(self.meanings):
            for m in found:
                named[k, m] = 1
        above = np.zeros_like(named)
        place = np.zeros(n)
        for level in levels:
            up = parents[level]
            above[level] = np.maximum(above[up], named[up])
            # within a level, children of one parent stand together and in order
            first = np.r_[True, up[1:] != up[:-1]]
            starts = np.flatnonzero(first)
            place[level] = np.arange(len(up)) - np.repeat(starts, np.diff(np.r_[starts, len(up)]))
        chars = np.maximum(total[:, 0], 1)
        blocks = np.maximum(total[:, 4], 1)
        links = total[:, 2] / chars
        whole = np.maximum(total[self.roots, 0], 1)
        # a text that is its parent's only child stands where the parent stands
        alone = (held > 0) & (children[parents] == 1)
        seat = np.where(alone, parents, np.arange(n))
        up = parents[seat]
        over = parents[up]
        siblings = children[up]
        same = np.zeros(n)
        keys = up * (len(TAGS) + 1) + self.tags[seat]
        _, which = np.unique(keys, return_inverse=True)
        own = np.where(alone, 0, total[:, 0])  # counted with the parent
        same = np.bincount(which, own)[which] / np.maximum(total[up, 0], 1)
        tag = np.eye(len(TAGS) + 1)[:, : len(TAGS)][self.tags[seat]]
        tag[:, _TAG["#text"]] = held
        columns = [
            np.log1p(total[:, 0]), np.log1p(total[:, 1]), links, total[:, 3] / chars * 100, np.log1p(total[:, 4]),
            np.log1p(chars / blocks), np.log1p(longest), total[:, 6] / chars * 100, np.log1p(total[:, 5]),
            total[:, 0] / whole, before / whole, self.depth[seat], place[seat] / np.maximum(siblings, 1),
            np.log1p(siblings), np.log1p((total[up, 0] - total[:, 0]) / np.maximum(siblings - 1, 1)),
            total[:, 0] / np.maximum(biggest[up], 1), links[up], np.log1p(blocks[up]), total[:, 7] / blocks,
            same, np.log1p(chars[up] / blocks[up]), links[over], np.log1p(chars[over] / blocks[over]),
            total[up, 0] / whole,
        ]
        group = np.eye(len(TAGS) + 1)[:, : len(TAGS)][self.tags[up]]
        return np.column_stack([*columns, tag, group, named[seat], above[seat]]).astype(np.float32)

    def decoded(self, log_yes: np.ndarray, log_no: np.ndarray) -> np.ndarray:
        """The best choice per node in which no chosen node has an ancestor that is not.

        Every node is chosen or not; dropping a node drops all below it. Among such choices
        the one with the largest sum of log-probabilities is found from the leaves up.
        """
        dropped, kept = log_no.copy(), log_yes.copy()
        for level in reversed(self.levels):
            np.add.at(kept, self.parents[level], np.maximum(dropped[level], kept[level]))
            np.add.at(dropped, self.parents[level], dropped[level])
        chosen = kept > dropped
        for level in self.levels:
            chosen[level] &= chosen[self.parents[level]]
        return chosen


def log_chances(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the probabilities for and against, from a boosted model's margin."""
    return -np.logaddexp(0, -2 * margin), -np.logaddexp(0, 2 * margin)

"""Labelled pages for the content model: the blocks of given pages set in other layouts.

A given page labels itself where it has one ``<article>``. Its paragraphs, menus, adverts and footers are taken
out and set again in layouts that sites use: with landmarks, with class names, with plain boxes, in table cells, with
line breaks instead of paragraphs, with comments, notices, forms and adverts around and inside the text. ``data-label``
marks what is main text; the model never sees it.
"""

from __future__ import annotations

import random
from html import escape

from casegrain.llm.html_tree import Tree

# ---- fixed values: names and texts that sites give to their parts ---------------
CONTENT_NAMES = ["content", "post-body", "entry-content", "article-text", "story", "main-text", "single-post", "page-body", "c1", "box", "x-a7"]
FRAME_NAMES = {
    "menu": ["menu", "nav-bar", "navigation", "top-links", "breadcrumbs", "c2", "x-b3", ""],
    "header": ["header", "masthead", "site-header", "top", "branding", "c3", ""],
    "footer": ["footer", "site-footer", "bottom", "copyright", "c4", ""],
    "sidebar": ["sidebar", "side", "widget-area", "related-posts", "c5", "right-col", ""],
    "notice": ["cookie-notice", "notice", "alert", "consent-banner", "message-bar", "gdpr"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad"],
    "comments": ["comments", "comment-list", "responses", "discussion", "reader-comments", "disqus-thread"],
    "form": ["newsletter-form", "subscribe", "search-form", "login", "contact-form"],
    "share": ["share", "social-links", "share-buttons", "follow-us"],
}
FRAME_TEXTS = {
    "notice": ["We use cookies to make this site better. By going on you accept our use of cookies.",
               "This site uses cookies and similar techniques. Read our privacy notice.", "Important: our office is closed on Monday."],
    "footer": ["© 2024 All rights reserved.", "Copyright by the owners. Terms of use. Privacy policy.", "Imprint and contact"],
    "form": ["Your e-mail address", "Sign up for our newsletter", "Search this site"],
    "share": ["Share on social media", "Tweet this", "Send by mail", "Print"],
    "comments": ["Great article, thanks for writing this!", "I do not agree with the second point. It was different in my town.", "Reply"],
    "paragraph": ["The town council met on Tuesday to talk about the new bridge, which has been under repair since the spring.",
                  "Nobody expected the river to rise that fast. By noon, the water had reached the first houses.",
                  "It was late.", "The mayor said that the work would go on, and that the costs, so far, were within the plan."],
    "menu": ["Home", "News", "Sport", "About", "Contact", "Archive", "Shop"],
    "advert": ["Buy two, get one free. Only this week!", "The best offers in town."],
}
# --------------------------------------------------------------------------------


def own_labels(tree: Tree) -> bool:
    """Label a given page by its one ``<article>``, if it has one."""
    at = [i for i, t in enumerate(tree.tag) if t == "article"]
    if len(at) != 1:
        return False
    inside = [False] * len(tree.tag)
    for i, p in enumerate(tree.parent):
        inside[i] = i == at[0] or p >= 0 and inside[p]
    tree.label = [int(x) for x in inside]
    return True


class Parts:
    """Texts to build with, by role: those of given pages, else the fixed ones."""

    def __init__(self, trees: list[Tree]):
        found: dict[str, list[str]] = {"paragraph": [], "menu": [], "advert": [], "footer": []}
        for t in trees:
            role = {}
            for i, (tag, p) in enumerate(zip(t.tag, t.parent)):
                role[i] = {"article": "paragraph", "nav": "menu", "footer": "footer"}.get(
                    tag, "advert" if "ad" in t.words[i] else role.get(p))
                if not tag and role[i]:
                    found[role[i]].append(t.text[i])
        self.texts = {k: v + (found.get(k) or []) for k, v in FRAME_TEXTS.items()}
        # Given texts come first where there are any.
        for k in ("paragraph", "menu", "advert"):
            if len(found[k]) >= 20:
                self.texts[k] = found[k]


class Layout:
    """One labelled page; the layout is drawn from ``r``."""

    def __init__(self, r: random.Random, parts: Parts):
        self.r, self.parts = r, parts

    def text(self, role: str) -> str:
        return escape(self.r.choice(self.parts.texts[role]), quote=False)

    def name(self, role: str) -> str:
        n = self.r.choice(FRAME_NAMES[role] if role in FRAME_NAMES else CONTENT_NAMES)
        return f' {self.r.choice(["class", "id", "class"])}="{n}"' if n and self.plain < .8 else ""

    def links(self, role: str, n: int) -> str:
        items = [f'<a href="#{i}">{self.text(role)}</a>' for i in range(n)]
        shape = self.r.randrange(3)
        if shape == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if shape == 1 else "").join(items if shape == 1 else [f"<p>{x}</p>" for x in items])

    def frame(self, role: str) -> str:
        r, name = self.r, self.name(role)
        tag = "ol" if role == "comments" and r.random() < .2 else {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(role, "div")
        if role != "form" and (self.plain > .3 or r.random() < .3):
            tag = "div"
        if role == "menu":
            inner = self.links("menu", r.randrange(3, 9))
        elif role == "header":
            inner = f'<div><a href="/">{self.text("menu")}</a></div>' + (f"<h1>{self.text('menu')}</h1>" if r.random() < .3 else "") + (
                f"<p>{self.text('advert')}</p>" if r.random() < .4 else "")
        elif role == "footer":
            inner = r.choice(["{}", "<p>{}</p>", "<small>{}</small>"]).format(self.text("footer")) + (self.links("menu", 3) if r.random() < .5 else "")
        elif role == "sidebar":
            inner = "".join(f"<h3>{self.text('menu')}</h3>" + r.choice([self.links("menu", 4), f"<p>{self.text('advert')}</p>",
                            f'<p><a href="#">{self.text("paragraph")[:60]}</a></p>']) for _ in range(r.randrange(1, 4)))
        elif role == "comments":
            each = lambda: r.choice(["<p>{}</p>", "<div class=\"comment\"><b>{1}</b> <p>{0}</p></div>", "<li class=\"comment\">{}</li>"]).format(
                r.choice([self.text("comments"), self.text("paragraph")]), self.text("menu"))
            name = name or f' class="{r.choice(FRAME_NAMES["comments"])}"'
            inner = (f"<h3>{r.randrange(9)} comments</h3>" if r.random() < .6 else "") + "".join(each() for _ in range(r.randrange(1, 5)))
        elif role == "form":
            inner = f"<p>{self.text('form')}</p><input name=q><button>Go</button>"
        elif role == "share":
            inner = self.links("share", r.randrange(2, 5))
        else:
            name = name or f' class="{r.choice(FRAME_NAMES[role])}"'
            inner = r.choice(["{}", "<p>{}</p>", "<p>{}</p><a href=#>OK</a>"]).format(self.text(role))
        return f'<{tag}{name} data-label="0">{inner}</{tag}>'

    def block(self) -> str:
        r, t = self.r, self.text("paragraph")
        words = t.split()
        if r.random() < .2 and len(words) > 6:
            i = r.randrange(len(words) - 3)
            words[i:i + 2] = [f'<a href="#">{" ".join(words[i:i + 2])}</a>']
            t = " ".join(words)
        k = r.random()
        if k < .74:
            return r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>"]).format(t)
        if k < .82:
            return f"<h{r.randrange(2, 4)}>{' '.join(words[:6])}</h{r.randrange(2, 4)}>"
        if k < .88:
            return "<ul>" + "".join(f"<li>{' '.join(words[i:i + 9])}</li>" for i in range(0, min(len(words), 40), 9)) + "</ul>"
        if k < .93:
            return f"<blockquote><p>{t}</p></blockquote>"
        if k < .97:
            return "<table><tr>" + "".join(f"<td>{w}</td>" for w in words[:4]) + "</tr></table>"
        return f"<figure><img src=x><figcaption>{' '.join(words[:12])}</figcaption></figure>"

    def story(self) -> str:
        r = self.r
        head = r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", ""]).format(" ".join(self.text("paragraph").split()[:9]))
        blocks = [self.block() for _ in range(r.choice([1, 3, 5, 8, 14]))]
        if r.random() < .12:
            blocks = ["<br><br>".join(self.text("paragraph") for _ in blocks)]
        for role in ("advert", "share", "form", "sidebar", "notice"):
            if r.random() < .15:
                blocks.insert(r.randrange(len(blocks) + 1), self.frame(role))
        inner = "".join(blocks)
        if r.random() < .35:
            inner = f"<div{self.name('content')}>{inner}</div>"
        return head + inner

    def page(self) -> str:
        """Landmarks, named boxes, or (``plain`` near 1) boxes without a word on what they are."""
        r = self.r
        self.plain = r.random()
        landmark = r.choice(["article", "main", "section", "div"]) if self.plain < .5 else "div"
        body = f'<{landmark}{self.name("content")} data-label="1">{self.story()}</{landmark}>'
        if r.random() < .35:
            body = f'<div{r.choice([" id=main", " class=wrap", ""])}>{body}{self.frame("comments") if r.random() < .5 else ""}</div>'
        before = [self.frame(k) for k in ("notice", "header", "menu", "advert") if r.random() < .6]
        after = [self.frame(k) for k in ("comments", "sidebar", "form", "share", "advert", "footer") if r.random() < .5]
        shape = r.random()
        if shape < .12:
            cells = [f"<td>{x}</td>" for x in (self.frame("menu"), body, self.frame("sidebar"))]
            body = f"<table><tr>{''.join(cells)}</tr></table>"
        elif shape < .25:
            body = f"<div>{self.frame('sidebar')}{body}</div>"
        title = f"<head><title>{self.text('menu')}</title></head>"
        return f"<!DOCTYPE html><html>{title}<body>{''.join(before)}{body}{''.join(after)}</body></html>"

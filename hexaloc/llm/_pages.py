"""Invented pages whose main blocks are known, for training the block labeller."""

from __future__ import annotations

import random

#: Stands before each main block's text.
MAIN = ""

#: Names that pages give to the parts around an article, by kind. Fixed values.
AROUND = {
    "nav": ["menu", "nav", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "site-nav", "links", "pagination", "pager"],
    "header": ["header", "site-header", "masthead", "banner", "topbar", "top-bar", "branding", "logo", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "footer-links"],
    "aside": ["sidebar", "side-bar", "aside", "widget", "related", "related-posts", "recommended", "trending", "popular", "see-also", "more-stories", "rail", "right-column", "tags", "author-bio"],
    "notice": ["cookie", "cookie-banner", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message", "disclaimer", "paywall", "announcement"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "adsbox", "ad-slot", "partner"],
    "form": ["form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "subscription"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "replies", "reply", "responses", "discussion", "disqus", "user-comments", "thread"],
    "share": ["share", "social", "social-links", "share-buttons", "follow", "toolbar"],
}
INSIDE = ["content", "main", "post", "entry", "entry-content", "article", "article-body", "post-body", "story", "text", "body-text", "main-content", "page-content"]
PLAIN = ["wrapper", "container", "page", "site", "row", "col", "inner", "wrap", "layout", "grid"]
SYLLABLES = ["er", "in", "an", "the", "on", "ent", "sch", "lich", "que", "eau", "cion", "ado", "les", "ung", "ver", "ti", "re", "ou", "é", "ö", "ñ", "s", "ha", "st"]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(len(out)):
            if r.random() < 0.1:
                out[i] += r.choice([",", ".", "!", "%%%", "&amp;&amp;", "###", ":"])
            if r.random() < 0.03:
                out[i] = f"<a href='/{i}'>{out[i]}</a>"
        style = r.random()
        if style < 0.05:  # a row of a table, shouting, or marks after every word
            return " | ".join(out)
        if style < 0.08:
            return "!! ".join(out).upper()
        if style < 0.12:
            return " ".join(w + r.choice(["%%%", "&amp;&amp;&amp;", "###", "***", "$$$"]) for w in out)
        return (" ".join(out)).capitalize() + r.choice([".", ".", ".", ""])

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{MAIN}{self.words(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind, text = r.random(), MAIN + self.words(2, r.choice([4, 12, 40, 90]))
            if kind < 0.6:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.72:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{text}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{MAIN}{self.words(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<pre>{text}</pre>")
            elif kind < 0.96:
                parts.append(f"<table><tr><td>{text}</td><td>{MAIN}{self.words(1, 3)}</td></tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
            if r.random() < 0.06:
                parts.append(self.around(r.choice(["ad", "share", "aside", "form", "notice"])))
        shape = r.random()
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = f'<div class="{r.choice(INSIDE)}">{inside}</div>'
        if shape < 0.55:
            return f"<article>{inside}</article>"
        if shape < 0.7:
            return f"<main>{inside}</main>"
        if shape < 0.85:
            return f'<div {r.choice(["class", "id"])}="{r.choice(INSIDE)}">{inside}</div>'
        return f'<main><article class="{r.choice(INSIDE)}">{inside}</article></main>'

    def around(self, kind: str) -> str:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section")
        if r.random() < 0.5:
            tag = "div"
        named = f' {r.choice(["class", "class", "id"])}="{r.choice(AROUND[kind])}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        if kind in ("nav", "share") or r.random() < 0.15:
            body = "<ul>" + "".join(f"<li><a href='#'>{self.words(1, 3)}</a></li>" for _ in range(r.randint(2, 8))) + "</ul>"
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>"
            body += f"<p>{self.words(3, 15)}</p>" if r.random() < 0.4 else ""
        elif kind == "comments":
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<div class="{r.choice(AROUND["comments"])}"><p>{self.words(3, 50)}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "footer":
            body = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 14)}"
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p>", f"<a href='/'>{self.words(1, 3)}</a>", self.words(1, 6)])
        else:
            body = r.choice([self.words(2, 30), f"<p>{self.words(3, 40)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.words(4, 40)}</p>"])
        return f"<{tag}{named}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "ad", "form", "share") if r.random() < (0.7 if k == "nav" else 0.4)]
        after = [k for k in ("share", "comments", "aside", "ad", "nav", "notice", "form", "footer") if r.random() < (0.7 if k == "footer" else 0.35)]
        if r.random() < 0.5:
            r.shuffle(before)
        body = "".join(map(self.around, before)) + (self.around("aside") if r.random() < 0.2 else "")
        body += self.article() if r.random() < 0.97 else ""
        body += "".join(map(self.around, after))
        if r.random() < 0.3:
            body = f'<div class="{r.choice(PLAIN)}">{body}</div>'
        text = f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}</body></html>"
        return text if r.random() < 0.9 else text[: r.randint(len(text) * 3 // 4, len(text))]

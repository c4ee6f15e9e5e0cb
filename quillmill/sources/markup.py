"""Markup of e-book sections: sanitising by lists of what may stay, inlining of images, and plain text that keeps paragraphs."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

#: Tags that may stay.
TAGS = """p br hr div span pre blockquote h1 h2 h3 h4 h5 h6 em i strong b u s strike del ins sub sup small big mark abbr cite code kbd samp var
ul ol li dl dt dd table thead tbody tfoot tr th td caption colgroup col img figure figcaption a q dfn time address article section header footer main aside nav""".split()
#: Attributes that may stay, by tag; those under * on every tag.
ATTRIBUTES = {
    "*": "class id style title dir lang".split(),
    "img": "src alt width height align".split(),
    "a": "href name".split(),
    "table": "border cellpadding cellspacing align width".split(),
    "td": "colspan rowspan align valign width height".split(),
    "th": "colspan rowspan align valign width height".split(),
    "col": "span width".split(),
    "colgroup": "span width".split(),
}
#: Style properties that may stay.
STYLES = """color background-color background font-family font-size font-weight font-style font-variant text-align text-decoration text-indent text-transform
line-height letter-spacing word-spacing margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left
border border-top border-right border-bottom border-left border-width border-style border-color width height max-width max-height min-width min-height
display float clear position top right bottom left vertical-align white-space overflow""".split()
PROTOCOLS = ("http:", "https:", "data:")
_DROPPED = {"script", "style", "nav"}
_EMPTY = {"br", "hr", "img", "col"}
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "tr", "div"}


def _safe_style(value: str) -> str:
    kept = []
    for rule in value.split(";"):
        name, _, what = rule.partition(":")
        if name.strip().lower() in STYLES and what.strip() and not re.search(r"expression|url\s*\(|javascript:", what, re.IGNORECASE):
            kept.append(f"{name.strip()}: {what.strip()}")
    return "; ".join(kept) + (";" if kept else "")


class _Cleaner(HTMLParser):
    """Writes what may stay of the body; text of other tags stays, that of scripts, styles and navigation goes."""

    def __init__(self, images: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.images, self.markup, self.text, self.blocks, self.block = images, [], [], [], []
        self.skipped, self.in_head = 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.skipped += 1
        if tag == "head":
            self.in_head += 1
        if self.skipped or self.in_head:
            return
        if tag in _PARAGRAPHS:
            self._end_block()
        if tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self.block.append(f"[Image: {alt}]")
        if tag not in TAGS:
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            if name not in ATTRIBUTES["*"] and name not in ATTRIBUTES.get(tag, ()):
                continue
            if name == "src":
                value = self.images.get(value) or self.images.get(value.rsplit("/", 1)[-1]) or value
            if name in ("src", "href") and re.match(r"\s*[a-z][a-z0-9+.-]*:", value, re.IGNORECASE) and not value.strip().lower().startswith(PROTOCOLS):
                continue
            if name == "style":
                value = _safe_style(value)
            kept.append(f' {name}="{escape(value, quote=True)}"')
        self.markup.append(f"<{tag}{''.join(kept)}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _DROPPED:
            self.skipped -= 1

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if tag == "head":
            self.in_head = max(0, self.in_head - 1)
            return
        if self.skipped or self.in_head:
            return
        if tag in _PARAGRAPHS:
            self._end_block()
        if tag in TAGS and tag not in _EMPTY:
            self.markup.append(f"</{tag}>")

    def handle_data(self, data):
        if self.skipped or self.in_head:
            return
        self.markup.append(escape(data, quote=False))
        if data.strip():
            self.text.append(data.strip())
        self.block.append(data)

    def _end_block(self):
        joined = " ".join("".join(self.block).split())
        if joined:
            self.blocks.append(joined)
        self.block = []


def cleaned(document: str, images: dict[str, str] | None = None) -> tuple[str, str, str]:
    """(sanitised markup, text with single blanks, text with a blank line between paragraphs) of one section."""
    parser = _Cleaner(images or {})
    parser.feed(document)
    parser.close()
    parser._end_block()
    return "".join(parser.markup).strip(), " ".join(" ".join(parser.text).split()), "\n\n".join(parser.blocks)

"""Protecting tags that are no HTML: balanced ones become placeholders beside a list of what they stand for, and back again."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element names of HTML 5; tags of these names stay.
HTML_TAGS = frozenset(
    (
        "html", "base", "head", "link", "meta", "style", "title", "body", "address", "article", "aside", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "main", "nav", "section", "search",
        "blockquote", "dd", "div", "dl", "dt", "figcaption", "figure", "hr", "li", "menu", "ol", "p", "pre", "ul", "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "dfn", "em", "i", "kbd", "mark",
        "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr", "area", "audio", "img", "map", "track", "video", "embed", "iframe", "object", "param", "picture",
        "portal", "source", "svg", "math", "canvas", "noscript", "script", "del", "ins", "caption", "col", "colgroup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "button", "datalist", "fieldset",
        "form", "input", "label", "legend", "meter", "optgroup", "option", "output", "progress", "select", "textarea", "details", "dialog", "summary", "slot", "template",
    )
)
PREFIX, SUFFIX = "{{TAG_", "}}"

_NAME = re.compile(r"</?([A-Za-z_][A-Za-z0-9_.:-]*)")
_CLOSE = re.compile(r"[ \t\n\x0c\r]*>")
_STOP = re.compile("[>\"']")


def _tag_end(text: str, at: int, failed: set[int]) -> tuple[int, bool] | None:
    """Where an opening tag ends whose name ends at at, and whether it closes itself; failed: stops from which no end is reached."""
    begin, passed = at, []
    while (m := _STOP.search(text, at)) and m.start() not in failed:
        if m[0] == ">":
            last = re.split(r"[ \t\n\x0c\r]", text[begin : m.start()])[-1]
            return m.end(), "/" in last
        passed.append(m.start())
        quote = text.find(m[0], m.end())
        if quote < 0:
            break
        at = begin = quote + 1
    failed.update(passed, [m.start()] if m else [])
    return None


def spans(text: str, markers: bool = False) -> list[tuple[int, int]]:
    """Where protected stretches begin and end: outermost balanced elements, or, with markers, each of their tags by itself.

    A tag in a quote that is never closed is none; closing tags without an opening one stay, as do opening ones that are never
    closed, but for their markers.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    failed: set[int] = set()
    no_end = len(text)  # no ">" at or after this place
    at = text.find("<")
    while at >= 0:
        m = _NAME.match(text, at)
        nxt = at + 1
        if m and at < no_end:
            name = m[1].lower()
            if text[at + 1] == "/":
                close = _CLOSE.match(text, m.end())
                if close:
                    nxt = close.end()
                    if opened[name]:  # tags of HTML never are
                        open_name = ""
                        while open_name != name:
                            open_name, begin = stack.pop()
                            opened[open_name] -= 1
                        if markers:
                            out.append((at, nxt))
                        else:
                            while out and out[-1][0] >= begin:
                                out.pop()
                            out.append((begin, nxt))
            else:
                found = _tag_end(text, m.end(), failed)
                if found:
                    nxt, alone = found
                    if name not in HTML_TAGS:
                        if alone or markers:
                            out.append((at, nxt))
                        if not alone:
                            stack.append((name, at))
                            opened[name] += 1
                elif text.find(">", at) < 0:
                    no_end = at
        at = text.find("<", nxt)
    return out


def _prefix(text: str) -> str:
    """A beginning of placeholders that the text does not hold."""
    prefix, salt = PREFIX, 0
    while prefix in text:
        prefix, salt = f"{PREFIX}{salt}_", salt + 1
    return prefix


def protect_text(text: str | None, markers: bool = False) -> tuple[str, list[tuple[str, str]]]:
    text = text or ""
    prefix, parts, blocks, at = _prefix(text), [], [], 0
    for k, (begin, end) in enumerate(spans(text, markers)):
        blocks.append((f"{prefix}{k}{SUFFIX}", text[begin:end]))
        parts += [text[at:begin], blocks[-1][0]]
        at = end
    return "".join([*parts, text[at:]]), blocks


def protect(text: Column, markers: bool = False) -> Column:
    """struct(text, blocks(placeholder, original)); null counts as empty."""

    @F.pandas_udf("struct<text:string,blocks:array<struct<placeholder:string,original:string>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [protect_text(t, markers) for t in texts]
        return pd.DataFrame({"text": [m[0] for m in made], "blocks": [[{"placeholder": p, "original": o} for p, o in m[1]] for m in made]})

    return run(text)


def restore(text: Column, blocks: Column) -> Column:
    """text with each placeholder that is still there replaced by what it stands for; lost ones stay lost."""
    return F.aggregate(blocks, text, lambda t, b: F.replace(t, b["placeholder"], b["original"]))

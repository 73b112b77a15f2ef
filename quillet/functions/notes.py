"""Notes: plain-text and HTML content, links, and what is left of HTML under an allow-list."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.text import strip

# Tags that stay, tags that go with their content, tags that become paragraphs, tags that make a block.
ALLOWED = {"a", "blockquote", "br", "code", "em", "h1", "h2", "h3", "i", "li", "ol", "p", "pre", "strong", "u", "ul"}
DROPPED = {"iframe", "object", "script", "style"}
PARAGRAPHS = {"article", "div", "section"}
_BLOCK = r"<(?:p|h1|h2|h3|ul|ol|blockquote|pre|li)\b"
_TAG = r"(?i)</?[a-z][\w:-]*\b[^>]*>"


def is_plain(content: Column) -> Column:
    """No content, or content without an HTML tag."""
    return content.isNull() | ~content.rlike(_TAG)


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def plain_to_html(text: Column) -> Column:
    """Paragraphs at blank lines, breaks at line ends."""
    body = strip(unix_lines(F.coalesce(text, F.lit(""))))
    parts = F.transform(F.split(body, r"\n{2,}", -1), lambda p: F.concat(F.lit("<p>"), F.replace(escaped(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(body == "", "").otherwise(F.array_join(parts, ""))


_PORTS = {"http": 80, "https": 443}
#: Characters that are written as percent codes, besides controls and all beyond ASCII.
_IN_PATH, _IN_QUERY, _IN_FRAGMENT = ' "#<>?`{}^', ' "#<>\'', ' "<>`'
_NO_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]")


def _coded(text: str, also: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _path(path: str) -> str:
    """A hierarchical path without its dot segments."""
    out: list[str] = []
    parts = path.replace("\\", "/").removeprefix("/").split("/")
    for i, part in enumerate(parts):
        dots, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if dots == "..":
            out = out[:-1]
        elif dots != ".":
            out.append(_coded(part, _IN_PATH))
        if last and dots in (".", ".."):
            out.append("")
    return "/" + "/".join(out)


def serialised(address: str, base: str = "localhost") -> str | None:
    """An absolute web, mail or telephone address as a browser writes it: scheme and host in lower case, no default port, a path, percent codes; None for others.

    An https address without slashes is relative to ``base``.
    """
    scheme, rest = re.sub(r"[\t\n\r]", "", address).split(":", 1)
    scheme = scheme.lower()
    rest, mark, fragment = rest.partition("#")
    tail = "#" + _coded(fragment, _IN_FRAGMENT) if mark else ""
    rest, mark, query = rest.partition("?")
    if scheme in ("mailto", "tel"):
        rest = rest if mark or tail else rest.rstrip(" ")
        return f"{scheme}:{_coded(rest, '')}{'?' + _coded(query, _IN_QUERY[:-1]) if mark else ''}{tail}"
    if scheme not in _PORTS:
        return None
    tail = ("?" + _coded(query, _IN_QUERY) if mark else "") + tail
    if scheme == "https" and rest[:1] not in ("/", "\\"):
        return f"https://{base}{_path(rest)}{tail}"
    authority, path = re.fullmatch(r"(?s)[/\\]*([^/\\]*)(.*)", rest).groups()
    user, at, host = authority.rpartition("@")
    host, colon, port = host.partition(":") if not host.startswith("[") else (host[: host.find("]") + 1], *host[host.find("]") + 1 :].partition(":")[1:])
    try:
        host = unquote(host).lower()
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    bad = not re.fullmatch(r"\[[0-9a-f:.]+\]", host) if host.startswith("[") else _NO_HOST.search(host)
    if not host or bad or (port and not (port.isascii() and port.isdigit() and int(port) < 65536)):
        return None
    shown = f":{int(port)}" if port and int(port) != _PORTS[scheme] else ""
    name, colon, secret = user.partition(":")
    login = _coded(name, _IN_PATH + "/;=@[]|") + (":" + _coded(secret, _IN_PATH + "/:;=@[]|") if secret else "")
    return f"{scheme}://{login + '@' if login else ''}{host}{shown}{_path(path)}{tail}"


def _link(href: str | None) -> str | None:
    t = (href or "").strip()
    if not t or t.startswith("#"):
        return t or None
    return serialised(t if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", t) else f"https://{t}")


@F.pandas_udf(T.StringType())
def link(href: pd.Series) -> pd.Series:
    """Anchors as they are; web, mail and telephone links as addresses, https where no scheme stands; others are null."""
    return href.map(_link)


class _Cleaner(HTMLParser):
    """Builds a tree of kept elements (tag, attributes, children); what isn't kept hands its children to its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.open: list[tuple[str, list | None]] = [("", self.root)]
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        kept = "p" if tag in PARAGRAPHS else tag
        if kept == "br":
            self._into().append(["br", "", []])
            return
        href = _link(dict(attrs).get("href")) if kept == "a" else None
        node = None
        if kept in ALLOWED and (kept != "a" or href):
            node = [kept, f' href="{html.escape(href)}" target="_blank" rel="noopener noreferrer nofollow"' if href else "", []]
            self._into().append(node)
        if tag not in ("img", "hr", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track"):
            self.open.append((tag, node))

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if not self.dropped and any(t == tag for t, _ in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.dropped:
            self._into().append(data)

    def _into(self) -> list:
        return next(node for _, node in reversed(self.open) if node is not None)[2]

    def shown(self, node) -> str:
        if isinstance(node, str):
            return html.escape(node, quote=False)
        tag, attributes, children = node
        inner = "".join(map(self.shown, children))
        if not tag:
            return inner
        if tag == "br":
            return "<br>"
        return f"<{tag}{attributes}>{inner}</{tag}>" if inner.strip() else ""


def _sanitised(content: str | None) -> str:
    raw = (content or "").strip()
    if not raw:
        return ""
    parser = _Cleaner()
    parser.feed(raw)
    parser.close()
    out = parser.shown(parser.root).strip()
    return out if not out or re.search(_BLOCK, out, re.I) else f"<p>{out}</p>"


@F.pandas_udf(T.StringType())
def sanitise(content: pd.Series) -> pd.Series:
    """HTML of allowed tags: scripts and the like go with their content, sections become paragraphs, links are checked, empty elements go, bare text is a paragraph."""
    return content.map(_sanitised)


def rendered(content: Column) -> Column:
    """What is shown of a note: plain text as paragraphs, HTML sanitised."""
    return F.when(content.isNull() | (strip(content) == ""), "").when(is_plain(content), plain_to_html(content)).otherwise(sanitise(content))


def is_empty(content: Column) -> Column:
    """No text is left of a note once it is rendered and its tags are gone."""
    return strip(F.regexp_replace(rendered(content), "<[^>]+>", "")) == ""


def changed(before: Column, after: Column) -> Column:
    """Whether two contents are rendered differently."""
    return rendered(before) != rendered(after)

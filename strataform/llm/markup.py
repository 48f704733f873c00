"""Clean text from documents that hold HTML, Markdown, wiki or LaTeX markup.

A text is read once from left to right.  Regions of code come out first, so
that nothing inside them is taken for markup.  The rest is cut into flat
blocks - one per paragraph, list item, table row or heading line - with the
markup of all four languages removed and noted as signs of the block it stood
in.  Two decision trees, grown from the labelled tables below, look at the
blocks:

* *role*: a block written as a heading, item, row, code or formula is one.  Of
  the others, word count and link density of the block and of its neighbours
  tell text from leftovers (menus, link bars), which are dropped.
* *language*: which languages the signs of a block speak for.  Some signs
  belong to several (a line that begins with a star, a rule); then the signs
  of the other blocks decide, near ones and those of the whole text.

The languages of a record are those of its classified blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.workspace import spread

LANGUAGES = ("html", "latex", "markdown", "wiki")

#: Element names of HTML.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option "
    "output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_NAMES = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))
_TAG = re.compile(rf"</?(?:(?:{_NAMES})(?=[\s/>])|[a-zA-Z]\w*:[a-zA-Z]\w*)(?:\s[^<>]*)?/?>|<!DOCTYPE[^<>]*>|<(?:{_NAMES})\s+[\w:-]+\s*=[^<>\n]*", re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BLOCK_TAGS = re.compile(r"</?(?:p|div|br|hr|section|article|header|footer|main|nav|aside|blockquote|ul|ol|dl|dd|dt|table|tbody|thead|tfoot|caption|figure|figcaption|form|body|html|head|center|address)\b[^<>]*>", re.I)

#: Where code begins; the first group that matched tells which kind.
_CODE = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<bar>`{3,}|~{3,})[^\n`]*$)"
    r"|(?P<tag><(?P<name>pre|code|tt|samp|kbd|script|style|syntaxhighlight|source|nowiki|xmp|textarea)\b[^<>]*>)"
    r"|(?P<env>\\begin\{(?P<listing>verbatim\*?|lstlisting|minted|alltt|Verbatim)\})"
    r"|(?P<verb>\\verb\*?(?P<mark>[^\sA-Za-z*]))"
    r"|(?P<comment><!--)"
    r"|(?P<tick>(?<![`\\])(?P<ticks>`{1,2})(?!`))",
    re.M | re.I,
)
_WIKI_CODE = {"syntaxhighlight", "source", "nowiki"}
_HIDDEN = {"script", "style"}


@dataclass
class Span:
    """A region taken out of the text before anything else is looked at."""

    kind: str  # code, inline, hidden
    language: str
    start: int
    end: int
    body: str


def code_spans(text: str) -> list[Span]:
    """Code blocks, inline code, comments, scripts; none of them nested."""
    out: list[Span] = []
    if not ("`" in text or "~~~" in text or "<" in text or "\\" in text):
        return out
    at = 0
    while m := _CODE.search(text, at):
        start, at = m.start(), m.end()
        if m["fence"]:
            bar = m["bar"]
            close = re.compile(rf"^[ ]{{0,3}}{re.escape(bar[0])}{{{len(bar)},}}[ \t]*$", re.M).search(text, at)
            end = close.end() if close else len(text)
            body = text[at : close.start() if close else len(text)].strip("\n")
            out.append(Span("code", "markdown", start, end, body))
        elif m["tag"]:
            name = m["name"].lower()
            close = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            if not close:
                continue  # an element left open is an ordinary tag
            inner = text[at : close.start()]
            body = unescape(_TAG.sub("", inner)) if name == "pre" else unescape(inner) if name in ("code", "tt", "samp", "kbd") else inner
            kind = "hidden" if name in _HIDDEN else "code" if name in ("pre", "xmp", "textarea", "syntaxhighlight", "source") or "\n" in inner else "inline"
            out.append(Span(kind, "wiki" if name in _WIKI_CODE else "html", start, close.end(), body.strip("\n")))
            end = close.end()
        elif m["env"]:
            close = text.find("\\end{" + m["listing"] + "}", at)
            stop = close if close >= 0 else len(text)
            end = close + len(m["listing"]) + 6 if close >= 0 else len(text)
            out.append(Span("code", "latex", start, end, re.sub(r"^\[[^\]\n]*\]|^\{[^}\n]*\}", "", text[at:stop]).strip("\n")))
        elif m["verb"]:
            close = text.find(m["mark"], at)
            if close < 0 or "\n" in text[at:close]:
                continue
            end = close + 1
            out.append(Span("inline", "latex", start, end, text[at:close]))
        elif m["comment"]:
            close = text.find("-->", at)
            end = close + 3 if close >= 0 else len(text)
            out.append(Span("hidden", "html", start, end, ""))
        else:
            ticks = m["ticks"]
            close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, at)
            if not close or "\n\n" in text[at : close.start()] or close.start() == at:
                continue
            end = close.end()
            out.append(Span("inline", "markdown", start, end, text[at : close.start()].strip()))
        at = max(end, start + 1)
    return out


def unescape(text: str) -> str:
    """Character references of HTML as characters."""
    return _REFERENCE.sub(lambda m: _char(m.group()), text) if "&" in text else text


def _char(ref: str) -> str:
    body = ref[1:-1]
    if body[0] == "#":
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return html5.get(body + ";", ref)


def _known(ref: str) -> bool:
    return ref[1] == "#" or ref[1:] in html5


# --- inline marks: pattern, replacement, language -------------------------------------------------
_ARG = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
_LINK, _LINK_END = "\ue006", "\ue007"  # private characters around the words of a link
_SHOWN = f"{_LINK}\\1{_LINK_END}"
_INLINE = [
    # images and links before emphasis
    ("markdown", "[", re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    ("markdown", "[", re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\([^()\n]*\)"), _SHOWN),
    ("markdown", "[", re.compile(r"\[\^[\w-]+\]:?"), ""),
    ("markdown", "[", re.compile(r"^\s{0,3}\[[^\[\]\n]+\]:\s+\S+.*$", re.M), ""),
    ("markdown", "[", re.compile(r"\[([^\[\]\n]+)\]\s?\[[\w -]*\](?=[\s.,;:!?)]|$)(?<!\]\])"), _SHOWN),
    ("markdown", "<", re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"), r"\1"),
    ("markdown", "{#", re.compile(r"\s*\{#[\w:.-]+[^{}\n]*\}"), ""),
    ("wiki", "#", re.compile(r"^\s*#(?:REDIRECT|WEITERLEITUNG|REDIRECTION|REDIRECCIÓN|転送)\b:?\s*", re.M | re.I), ""),
    ("wiki", "[[", re.compile(r"\[\[(?:File|Image|Datei|Bild|Fichier|Archivo|Category|Kategorie|Catégorie|Categoría):[^\[\]\n]*?(?:\|([^\[\]|\n]*))?\]\]", re.I), r"\1"),
    ("wiki", "[[", re.compile(r"\[\[(?![\s\d\[{'\"-]*[\],])[^\[\]|\n]*\|([^\[\]\n]*)\]\]"), _SHOWN),
    ("wiki", "[[", re.compile(r"\[\[(?!\s*-?\d+\s*[,\]])([^\[\]\n]+)\]\]"), _SHOWN),
    ("wiki", "[", re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:\s+([^\[\]\n]*))?\]"), _SHOWN),
    ("wiki", "{{", re.compile(r"\{\{(?:quote|code|term|lang|nowrap|small|big|math)\|(?:1=|text=)?([^{}|\n]*)(?:\|[^{}\n]*)?\}\}", re.I), r"\1"),
    ("wiki", "{{", re.compile(r"\{\{[^{}\n]+\}\}"), ""),
    ("wiki", "__", re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__"), ""),
    ("wiki", "''", re.compile(r"'''''(?!')(.+?)'''''"), r"\1"),
    ("wiki", "''", re.compile(r"'''(?!')(.+?)'''"), r"\1"),
    ("wiki", "''", re.compile(r"(?<!')''(?!')([^'\n]+(?:'[^'\n]+)*)''(?!')"), r"\1"),
    ("markdown", "~~", re.compile(r"~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~"), r"\1"),
    ("markdown", "**", re.compile(r"\*\*\*(?=[^\s*])([^\n]+?)(?<=[^\s*])\*\*\*"), r"\1"),
    ("markdown", "**", re.compile(r"\*\*(?=[^\s*])([^\n]+?)(?<=[^\s])\*\*"), r"\1"),
    ("markdown", "**", re.compile(r"(?<![\w*])\*\*(?=[^\W\d])|(?<=[^\W\d])\*\*(?![\w*])"), ""),
    ("markdown", "__", re.compile(r"(?<![A-Za-z0-9_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![A-Za-z0-9_])"), r"\1"),
    ("markdown", "*", re.compile(r"(?<![A-Za-z0-9*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![A-Za-z0-9*])"), r"\1"),
    ("markdown", "_", re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)"), r"\1"),
    ("latex", "\\", re.compile(r"\\href\{[^{}]*\}" + _ARG), r"\1"),
    ("latex", "\\", re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|index|vspace|hspace|bibliography|bibliographystyle|usepackage|documentclass|pagestyle|thispagestyle|includegraphics|input|include)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), ""),
    ("latex", "\\", re.compile(r"\\footnote(?:\[[^\]\n]*\])?" + _ARG), r" (\1)"),
    ("latex", "\\", re.compile(r"(?<![:\\])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?" + _ARG), r"\1"),
    ("latex", "\\", re.compile(r"\\['`^\"~=.]\{?([aeiouyAEIOUYcnCN])\}?"), r"\1"),
    ("latex", "\\", re.compile(r"(?<![\\\w:])\\([%&$#_{}])"), r"\1"),
    ("latex", "\\", re.compile(r"(?<![\\])\\\\(?:\[[\d.]+\s*[a-z]{2}\])?(?=\s*$)", re.M), ""),
    ("latex", "\\", re.compile(r"\\\\\[[\d.]+\s*[a-z]{2}\]"), ""),
    ("latex", "{\\", re.compile(r"\{\\[a-zA-Z]+\s+([^{}\n]*)\}"), r"\1"),
    ("latex", "\\", re.compile(r"(?<![\w:\\/~.-])\\(?!item\b)[a-zA-Z]{2,}\b(?![\\/])(?:\{\})?\s?"), ""),
]
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}

# --- formulas: kept with their signs ---------------------------------------------------------------
# Of any length, up to the nearest closing sign and never over another opening one, so each opening is searched for once.  ``\\[2pt]``
# opens nothing.  Only a long ``\(`` may not hold a blank line: TeX allows none, and in prose it is more often an escaped bracket.
_MATH = re.compile(
    r"\$\$(?P<a>[^$]+)\$\$|(?<!(?<!\\)\\)\\\[(?P<b>(?:(?!(?<!\\)\\\[).)+?)\\\]"
    r"|\\begin\{(?P<env>equation|align|gather|multline|displaymath|eqnarray|math)(?P<star>\*?)\}(?P<c>(?:(?!\\begin\{(?P=env)(?P=star)\}).)+?)\\end\{(?P=env)(?P=star)\}"
    r"|\\\((?P<d>.{1,500}?|(?:(?!\\\(|\n[ \t]*\n).)+?)\\\)|(?<![\\$\w])\$(?P<e>(?![\s\d$])[^$\n]*[^\s$\\]|[^\s$\\\d]|\d[^$\n]*[\\^_=][^$\n]*[^\s$\\])\$(?![\w$])",
    re.S,
)

# --- lines -----------------------------------------------------------------------------------------
_ATX = re.compile(r"^[ ]{0,3}(#{1,6})\s+(?=\S)(.*?)(?:\s+#+)?\s*$")
_WIKI_HEAD = re.compile(r"^\s*(={2,6})\s*([^=\s].*?)\s*\1\s*$")
_WIKI_HEAD_OPEN = re.compile(r"^\s*(={2,6})\s+([^=\s][^=]*)$")
_LATEX_HEAD = re.compile(r"^\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\s*(?:\[[^\]\n]*\])?" + _ARG)
_SETEXT = re.compile(r"^[ ]{0,3}(?:={3,}|-{3,})[ \t]*$")
_RULE = re.compile(r"^[ ]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_TASK = re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s+")
_DASH = re.compile(r"^\s*[-+]\s+(?=\S)")
_STAR = re.compile(r"^\s*\*\s+(?=\S)")
_STARS = re.compile(r"^[*#:;]{2,}\s+(?=\S)")
_COLON = re.compile(r"^[:;]\s+(?=\S)")
_HASH = re.compile(r"^#\s+(?=\S)")
_QUOTE = re.compile(r"^[ ]{0,3}>\s?(?=\S)")
_PLAIN_ITEM = re.compile(r"^\s*(?:[•◦▪‣·–]|\d{1,3}[.)])\s+(?=\S)")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_DIVIDER = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")
_ITEM = re.compile(r"^\s*\\item\b(?:\[([^\]\n]*)\])?\s*")
_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")


@dataclass(slots=True)
class Block:
    """A flat block: what it says, how it was marked, its signs, and its classes."""

    text: str
    mark: str = ""  # heading, item, row, code, formula, fence, quote, or nothing
    level: int = 0
    words: int = 0
    linked: int = 0
    signs: dict[str, int] = field(default_factory=dict)  # how often each language, or SHARED, shows
    kind: str = ""
    languages: list[str] = field(default_factory=list)


#: Signs that Markdown and wikis have in common: star and hash lists, rules.
SHARED = "shared"


@dataclass
class Converted:
    blocks: list[Block] = field(default_factory=list)

    @property
    def languages(self) -> set[str]:
        return {x for b in self.blocks for x in b.languages}

    def text(self) -> str:
        out: list[str] = []
        last = ""
        for b in self.blocks:
            if b.kind == "residue":
                continue
            line = {"heading": "#" * max(1, min(6, b.level)) + " " + b.text, "list": "• " + b.text}.get(b.kind, b.text)
            if out:
                out.append("\n" if b.kind == last and b.kind in ("list", "table") else "\n\n")
            out.append(line)
            last = b.kind
        return "".join(out)


# Private characters that stand for what was taken out: code and formulas (number between the first two), heading, item and row
# of HTML, a removed tag, a character reference.
_HELD = re.compile("\ue000(\\d+)\ue001")
_HEAD, _ITEM_, _ROW_, _GONE, _CHAR_ = "\ue002", "\ue003", "\ue004", "\ue005", "\ue008"
_RESERVED = dict.fromkeys(range(0xE000, 0xE009))
_IN_LINK = re.compile(f"{_LINK}([^{_LINK_END}]*)")
_WORDS = re.compile(r"\w+")
_NAME = re.compile(r"<(/?)([A-Za-z][\w:]*)")
_ALT = re.compile(r"\balt\s*=\s*[\"']([^\"']*)[\"']", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>.*?</title\s*>", re.I | re.S)
_CELLS = re.compile(r"</t[dh]\s*>\s*(?=<t[dh])", re.I)
_ROW_BEGIN = re.compile(r"(<tr\b[^<>]*>)\s+", re.I)
#: Elements that begin a new line.
_BREAKS = frozenset("p div br hr section article header footer main nav aside blockquote ul ol dl dd dt table tbody thead tfoot caption figure figcaption form body html head center address".split())


def _removed(m: re.Match) -> str:
    """What is left of a tag: a line break where it makes one, and a mark that it was there."""
    tag = _NAME.match(m.group())
    if not tag:
        return _GONE
    close, name = tag[1], tag[2].lower()
    if name in _BREAKS:
        return "\n" + _GONE
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        return "\n" + _GONE if close else f"\n{_GONE}{_HEAD}{name[1]}"
    if name == "li":
        return "\n" + _GONE if close else f"\n{_GONE}{_ITEM_}"
    if name == "tr":
        return "\n" + _GONE if close else f"\n{_GONE}{_ROW_}"
    if name == "a":
        return _GONE + (_LINK_END if close else _LINK)
    if name == "img" and (alt := _ALT.search(m.group())):
        return _GONE + alt[1]
    return _GONE


class _Reader:
    def __init__(self, text: str):
        self.held: list[tuple[str, str, str]] = []
        text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff").translate(_RESERVED)
        parts, at = [], 0
        for s in code_spans(text):
            parts += [text[at : s.start], _GONE if s.kind == "hidden" else self._hold(s.kind, s.body, s.language)]
            at = s.end
        parts.append(text[at:])
        self.text = "".join(parts) if at else text

    def _hold(self, kind: str, body: str, language: str) -> str:
        self.held.append((kind, body, language))
        token = f"\ue000{len(self.held) - 1}\ue001"
        return f"\n{token}\n" if kind in ("code", "formula") else token

    def formulas(self) -> None:
        if "$" not in self.text and "\\" not in self.text:
            return

        def hold(m: re.Match) -> str:
            body = next(g for g in (m["a"], m["b"], m["c"], m["d"], m["e"]) if g is not None).strip()
            return self._hold("inline" if m["d"] is not None or m["e"] is not None else "formula", body, "latex")

        self.text = _MATH.sub(hold, self.text)

    def html(self) -> None:
        t = self.text
        if "<" in t:
            t = _TITLE.sub("\n" + _GONE, t)
            t = _ROW_BEGIN.sub(r"\1", _CELLS.sub(f"{_GONE} | ", t)) if "<t" in t or "<T" in t else t
            t = _TAG.sub(_removed, t)
        if "&" in t:
            t = _REFERENCE.sub(lambda m: _char(m.group()) + _CHAR_ if _known(m.group()) else m.group(), t)
        self.text = t

    def inline(self, text: str, signs: dict[str, int]) -> str:
        for language, hint, rule, to in _INLINE:
            if hint in text:
                text, n = rule.subn(to, text)
                if n:
                    signs[language] = signs.get(language, 0) + n
        return text

    def restore(self, text: str) -> str:
        return _HELD.sub(lambda m: self.held[int(m.group(1))][1], text) if "\ue000" in text else text

    def blocks(self) -> list[Block]:
        out: list[Block] = []
        paragraph: list[str] = []
        paragraph_signs: dict[str, int] = {}
        here: dict[str, int] = {}  # signs of the line at hand
        wiki_table = tabular = False

        def note(language: str, n: int = 1) -> None:
            here[language] = here.get(language, 0) + n

        def keep(line: str) -> None:
            paragraph.append(line)
            for k, n in here.items():
                paragraph_signs[k] = paragraph_signs.get(k, 0) + n

        def flush() -> None:
            nonlocal paragraph_signs
            if paragraph:
                joined, signs = "\n".join(paragraph), paragraph_signs
                paragraph.clear()
                paragraph_signs = {}
                put(joined, "", 0, signs)

        def put(raw: str, mark: str, level: int = 0, signs: dict[str, int] | None = None) -> None:
            signs = dict(here) if signs is None else signs
            if "\ue000" in raw:
                for m in _HELD.finditer(raw):
                    language = self.held[int(m[1])][2]
                    signs[language] = signs.get(language, 0) + 1
            text = self.inline(raw, signs)
            linked = text.count("://")
            if _LINK in text or _LINK_END in text:
                linked += sum(len(_WORDS.findall(x)) for x in _IN_LINK.findall(text))
                text = text.replace(_LINK, "").replace(_LINK_END, "")
            text = self.restore(text).strip()
            if text or mark == "fence" or signs:
                out.append(Block(text, mark if text else "fence", level, len(_WORDS.findall(text)), linked, signs))

        # tags and references count for the line they stood in; everything below sees it without their traces
        raw_lines = self.text.split("\n")
        traced = _GONE in self.text or _CHAR_ in self.text
        lines = [x.replace(_GONE, "").replace(_CHAR_, "") for x in raw_lines] if traced else raw_lines
        for i, line in enumerate(lines):
            here = {"html": n} if traced and (n := len(raw_lines[i]) - len(line)) else {}
            s = line.strip()
            if not s:
                flush()
                if here:
                    put("", "fence")
                continue
            c = s[0]
            if c == "\ue000" and (m := _HELD.fullmatch(s)) and self.held[int(m.group(1))][0] in ("code", "formula"):
                flush()
                kind, body, language = self.held[int(m.group(1))]
                note(language)
                out.append(Block(body, kind, 0, len(_WORDS.findall(body)), 0, here))
                continue
            if c == "\ue002":
                flush()
                put(s[2:], "heading", int(s[1]))
                continue
            if c in "\ue003\ue004":
                flush()
                put(s[1:], "item" if c == "\ue003" else "row")
                continue
            if c.isalnum() and "|" not in s and not ("&" in s and (tabular or "\\" in s or s.count(" & ") > 1)):  # most lines
                following = lines[i + 1] if i + 1 < len(lines) else ""
                if following[:1] in ("=", "-") and _SETEXT.match(following) and not paragraph:
                    note("markdown")
                    put(s, "heading", 1 if following[0] == "=" else 2)
                elif _PLAIN_ITEM.match(line):
                    flush()
                    put(_PLAIN_ITEM.sub("", line), "item")
                else:
                    keep(line)
                continue
            if c in "=-" and _SETEXT.match(line) and i and lines[i - 1].strip():
                flush()
                continue  # the line above was the heading, or this is a plain underline
            if c == "#" and (m := _ATX.match(line)):
                beside = any(_HASH.match(lines[k]) for k in (i - 1, i + 1) if 0 <= k < len(lines))
                flush()
                if len(m[1]) == 1 and beside:
                    note(SHARED)
                    put(m[2], "item")
                else:
                    note("markdown")
                    put(m[2], "heading", len(m[1]))
                continue
            if c == "=" and (m := _WIKI_HEAD.match(line)):
                flush()
                note("wiki")
                put(m[2], "heading", len(m[1]))
                continue
            if c == "\\":
                if m := _LATEX_HEAD.match(line):
                    flush()
                    note("latex")
                    put(m[1] + line[m.end() :], "heading", 1 + line.count("sub", 0, m.end()))
                    continue
                if m := _ITEM.match(line):
                    flush()
                    note("latex")
                    put((m[1] + " " if m[1] else "") + line[m.end() :], "item")
                    continue
                if m := _ENV.search(line):
                    flush()
                    if "tab" in m.group() or "array" in m.group():
                        tabular = m.group().startswith("\\begin")
                    note("latex")
                    rest = _ENV.sub("", line)
                    put(rest, "row" if "&" in rest else "" if rest.strip() else "fence")
                    continue
            if _RULE.match(line):
                flush()
                note(SHARED)
                put("", "fence")
                continue
            if c in "-+*" and _TASK.match(line):
                flush()
                note("markdown")
                put(_TASK.sub("", line), "item")
                continue
            if c in "-+" and _DASH.match(line):
                flush()
                note("markdown")
                put(_DASH.sub("", line), "item")
                continue
            if c == "*" and _STAR.match(line):
                flush()
                note(SHARED)
                put(_STAR.sub("", line), "item")
                continue
            if c in "*#:;" and (_STARS.match(line) or _COLON.match(line)):
                flush()
                note("wiki")
                put((_STARS if _STARS.match(line) else _COLON).sub("", line), "item")
                continue
            if c == ">" and _QUOTE.match(line):
                flush()
                note("markdown")
                put(_QUOTE.sub("", line), "quote")
                continue
            if s.startswith("{|"):
                flush()
                note("wiki")
                wiki_table = True
                put("", "fence")
                continue
            if c in "|!" and (wiki_table or s[:2] in ("|-", "|}", "|+")) and not _DIVIDER.match(line) and not _ROW.match(line):
                flush()
                if wiki_table or s in ("|-", "|}"):
                    note("wiki")
                if s.startswith("|}"):
                    wiki_table = False
                if s[:2] in ("|-", "|}"):
                    put("", "fence")
                else:
                    put(" | ".join(x.strip() for x in re.split(r"\|\||!!", s.lstrip("|!+")) if x.strip()), "row")
                continue
            if "|" in s and _DIVIDER.match(line):
                flush()
                note("markdown")
                put("", "fence")
                continue
            if c == "|" and _ROW.match(line):
                flush()
                put(" | ".join(x.strip() for x in s.strip("|").split("|")), "row")
                continue
            if "&" in s and (tabular or re.search(r"\s&\s.*\\\\\s*$|^[^&]*(?:\s&\s[^&]*){2,}$", s)):
                flush()
                put(re.sub(r"\\\\(?:\[[^\]]*\])?\s*$|\\hline", "", s).replace(" & ", " | "), "row")
                if s.rstrip().endswith("\\\\"):
                    note("latex")
                continue
            if _PLAIN_ITEM.match(line):
                flush()
                put(_PLAIN_ITEM.sub("", line), "item")
                continue
            following = lines[i + 1] if i + 1 < len(lines) else ""
            if following[:1] in ("=", "-") and _SETEXT.match(following) and not paragraph and c not in "=-|":
                note("markdown")
                put(s, "heading", 1 if following[0] == "=" else 2)
                continue
            keep(line)
        flush()
        return out


# --- the decision trees ----------------------------------------------------------------------------
#: Classes of a block; a mark with which it was written has decided already.
ROLE = {"heading": "heading", "item": "list", "row": "table", "code": "code", "formula": "formula", "quote": "text", "fence": "residue"}
KINDS = ("text", "residue")


def density(b: Block) -> float:
    return min(1.0, b.linked / b.words) if b.words else float(b.linked > 0)


def features(blocks: list[Block]) -> np.ndarray:
    """Word count and link density of each block and of the blocks before and after."""
    own = np.array([(b.words, density(b)) for b in blocks], float).reshape(-1, 2)
    x = np.zeros((len(blocks), 6))
    x[:, 0:2] = own
    x[1:, 2:4] = own[:-1]
    x[:-1, 4:6] = own[1:]
    return x


#: The labelled table of roles: class, words, link density, and the same of the block before and of the one after.
LABELLED = [
    ("text", 24, 0, 3, 0, 4, 0), ("text", 4, 0, 24, 0, 3, 0), ("text", 11, 0, 0, 0, 0, 0), ("text", 3, 0, 0, 0, 0, 0), ("text", 1, 0, 0, 0, 0, 0), ("text", 2, 0, 30, 0, 25, 0), ("text", 3, 0, 2, 0, 40, 0),
    ("text", 60, 0.1, 2, 0, 2, 0), ("text", 40, 0.3, 5, 0, 30, 0.2), ("text", 25, 0.5, 30, 0, 20, 0), ("text", 18, 0.6, 0, 0, 25, 0), ("text", 120, 0, 80, 0, 90, 0), ("text", 7, 0.3, 20, 0, 20, 0), ("text", 6, 0.5, 18, 0, 22, 0),
    ("text", 1, 1, 20, 0, 25, 0), ("text", 5, 1, 30, 0, 0, 0), ("text", 3, 1, 12, 0, 14, 0), ("text", 2, 1, 0, 0, 0, 0), ("text", 8, 1, 0, 0, 0, 0), ("text", 12, 0.9, 15, 0.1, 0, 0), ("text", 0, 0, 5, 0, 9, 0),
    ("text", 9, 0, 1, 1, 2, 1), ("text", 5, 0, 2, 1, 1, 1), ("text", 30, 0.1, 1, 1, 1, 1), ("text", 2, 0, 1, 1, 1, 1), ("text", 14, 0, 4, 0.9, 20, 0), ("text", 10, 0.4, 2, 1, 2, 1), ("text", 4, 1, 25, 0, 3, 0),
    ("text", 30, 0.8, 1, 1, 1, 1), ("text", 22, 0.75, 2, 1, 3, 1), ("text", 45, 0.9, 2, 1, 1, 1), ("text", 28, 1, 3, 1, 2, 1),
    ("residue", 1, 1, 1, 1, 1, 1), ("residue", 2, 1, 1, 1, 2, 1), ("residue", 1, 1, 0, 0, 2, 1), ("residue", 3, 1, 2, 1, 0, 0), ("residue", 2, 1, 0, 0, 1, 1), ("residue", 4, 1, 3, 1, 5, 1), ("residue", 5, 0.9, 4, 1, 25, 0),
    ("residue", 2, 1, 30, 0, 3, 1), ("residue", 6, 1, 2, 1, 3, 0.8), ("residue", 3, 0.8, 1, 1, 2, 1), ("residue", 12, 1, 4, 0.9, 3, 1), ("residue", 9, 0.9, 5, 1, 6, 0.9), ("residue", 0, 1, 1, 1, 1, 1), ("residue", 2, 1, 3, 1, 40, 0.1),
]


def evidence(blocks: list[Block], i: int, language: str, total: dict[str, int]) -> list[float]:
    """What tells whether block i holds a language: its signs, those it shares, those around it, word counts and densities."""
    b = blocks[i]
    before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
    near = lambda x, k: min(x.signs.get(k, 0), 9) if x else 0
    other = "markdown" if language == "wiki" else "wiki"
    out = [near(b, language), near(b, SHARED), language == "wiki", language == "markdown", near(before, language) + near(after, language), near(before, other) + near(after, other)]
    out += [min(total.get(language, 0), 9), min(total.get(other, 0), 9), min(b.words, 99), density(b)]
    return [*out, *(v for x in (before, after) for v in ((min(x.words, 99), density(x)) if x else (0, 0)))]


def suspects(b: Block) -> list[str]:
    """Languages of which a block has signs, its own or shared ones."""
    if not b.signs:
        return []
    found = [x for x in LANGUAGES if x in b.signs]
    return found + [x for x in ("markdown", "wiki") if x not in found] if SHARED in b.signs else found


#: The labelled texts of the languages.
WRITTEN = [
    ("markdown", "# Office handbook\n\nWe keep the **plan** in the [wiki](http://w.test/a), and the team owns it.\n\n- label the boxes\n- list what changed"), ("markdown", "* one\n* two\n* three of the long list"), ("markdown", "A line.\n\n* * *\n\nAnother line."),
    ("markdown", "# one\n# two"), ("markdown", "Read `this` first.\n\n---\n\n> said in the meeting\n\n* a\n* b"), ("markdown", "Title\n=====\n\nSome text.\n\n* item of the list"), ("markdown", "Notes of the day.\n\n* close the tickets\n\nThe end of it, as the team says."), ("markdown", "~~gone~~ and **kept**"),
    ("wiki", "== Head ==\n* one\n* two"), ("wiki", "'''Plan''' of the year, see [[Plan|the plan]].\n\n----\n\n# one\n# two"), ("wiki", "* one\n* two\n\n== Later ==\nText."), ("wiki", "{| class=t\n|-\n| a || b\n|}\n* one"), ("wiki", "Some text about it.\n\n* [[One]]\n* two\n\n{{stub}}"), ("wiki", "# first\n# second\n\nSee [[Other]]."),
    ("wiki", "* one\n\nA long paragraph that stands between the list and the rest of the page, so that nothing near tells.\n\nAnd another one.\n\n[[Category:Plans]]"), ("wiki", "== A ==\n\nText.\n\nMore of the text.\n\nEven more.\n\n----\n\nThe end."),
    ("html", "<h1>Title</h1><p>It is <b>so</b>.</p><ul><li>one</li></ul>"), ("html", "R&amp;D work"), ("html", "Text.<!-- draft -->"), ("html", "<a href=x>Home</a><br><a href=y>Imprint</a>"), ("html markdown", "<div>\n\n**bold** text\n\n</div>"), ("html wiki", "== H ==\nText<ref>x</ref> and <br/>\n* one"),
    ("latex", "\\section{Scope}\n\nWith $a^2$ it \\emph{holds}.\n\n\\begin{itemize}\n\\item one\n\\end{itemize}"), ("latex", "up 9 \\% now"), ("latex", "\\[ a = b \\]"), ("latex markdown", "## Head\n\nIt is $x_1$ here."), ("latex wiki", "== Head ==\n\n$x_1$ and '''b'''\n\n* one"),
    ("markdown wiki", "# Head one\n\n[[Page|shown]] text\n\n* a"), ("markdown wiki", "**bold** and '''bold'''\n\n---\n\ntext"), ("html markdown", "<p>x</p>\n\n* one\n* two"), ("latex markdown", "\\textbf{x}\n\n* one\n* two"), ("", "• one\n• two\n\nPlain text."), ("", "1. one\n2. two"),
]


@dataclass
class Node:
    kind: int = 0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A binary tree by Gini impurity; ties go to the first feature and cut."""
    counts = np.bincount(y)
    node = Node(int(counts.argmax()))
    if depth == 0 or (counts > 0).sum() == 1:
        return node
    best = 1e-12
    base = 1 - ((counts / len(y)) ** 2).sum()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            gain = base
            for side in (low, ~low):
                share = np.bincount(y[side]) / side.sum()
                gain -= side.mean() * (1 - (share**2).sum())
            if gain > best:
                best, node.feature, node.cut = gain, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] < node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def decide(node: Node, row) -> int:
    """The class of one row of features."""
    while node.feature >= 0:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.kind


@dataclass
class Trees:
    role: Node  # of KINDS
    language: Node  # 1 if a block holds the language asked for


def _read(text: str) -> list[Block]:
    reader = _Reader(text)
    reader.formulas()
    reader.html()
    return reader.blocks()


def _totals(blocks: list[Block]) -> dict[str, int]:
    total: dict[str, int] = {}
    for b in blocks:
        for k, n in b.signs.items():
            total[k] = total.get(k, 0) + n
    return total


def trained() -> Trees:
    """Both trees, from the tables above."""
    roles = np.array([row[1:] for row in LABELLED], float)
    rows, held = [], []
    for languages, text in WRITTEN:
        blocks = _read(text)
        total = _totals(blocks)
        for i, b in enumerate(blocks):
            for language in suspects(b):
                rows.append(evidence(blocks, i, language, total))
                held.append(int(language in languages.split()))
    return Trees(grow(roles, np.array([KINDS.index(row[0]) for row in LABELLED])), grow(np.array(rows, float), np.array(held)))


TREES = trained()


def convert(text: str, trees: Trees = TREES) -> Converted:
    """The classified blocks of a text."""
    blocks = _read(text)
    total = _totals(blocks)
    open_ = False
    for i, b in enumerate(blocks):
        b.languages = [x for x in suspects(b) if decide(trees.language, evidence(blocks, i, x, total))]
        b.kind = ROLE.get(b.mark, "")
        open_ = open_ or not b.kind
    if open_:
        shown = [b for b in blocks if b.text]  # neighbours are those a reader sees
        for b, row in zip(shown, features(shown)):
            if not b.kind:
                b.kind = KINDS[decide(trees.role, row)]
    return Converted(blocks)


_PLAIN = re.compile(r"[<>&\\$#*_`\[{}|=~+-]|''|^[:;]", re.M)


def clean_heading(text: str) -> tuple[str, set[str]]:
    """A heading alone, as in breadcrumbs: one line, all markup removed."""
    if not _PLAIN.search(text):
        return text.strip(), set()
    done = convert(text)
    return " ".join(" ".join(b.text.split()) for b in done.blocks if b.text), done.languages


CLEANED = T.StructType(
    [T.StructField("record_kind", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("markup", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())]
)
_ARROW = pa.schema([("record_kind", pa.string()), ("record_id", pa.string()), ("markup", pa.list_(pa.string())), ("clean_text", pa.string())])


def _emit(kind: str, ids: list, found: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())], schema=_ARROW)


def _clean_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, texts = [], []
        for text in batch.column(1).to_pylist():
            done = convert(text)
            found.append(sorted(done.languages))
            texts.append(done.text())
        yield _emit("doc", batch.column(0).to_pylist(), found, texts)


def _clean_crumbs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, set[str]]] = {}
    for batch in batches:
        found, texts = [], []
        for crumbs in batch.column(1).to_pylist():
            languages: set[str] = set()
            parts = []
            for crumb in crumbs:
                if crumb is None:
                    continue
                if crumb not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[crumb] = clean_heading(crumb)
                part, langs = known[crumb]
                languages |= langs
                if part:
                    parts.append(part)
            found.append(sorted(languages))
            texts.append(" › ".join(parts))
        yield _emit("chunk", batch.column(0).to_pylist(), found, texts)


def clean_documents(docs: DataFrame, record_id: Column, text: Column) -> DataFrame:
    """``record_kind, record_id, markup, clean_text`` of each text that isn't null.

    Row by row, without a shuffle: repeated rows come out repeated, several
    texts of an id once each.  Empty and blank texts give an empty clean text
    and no markup; null ids are kept.
    """
    rows = docs.select(record_id.cast("string").alias("id"), text.alias("text")).where("text is not null")
    return spread(rows).mapInArrow(_clean_docs, CLEANED)


def clean_breadcrumbs(chunks: DataFrame, record_id: Column, breadcrumbs: Column) -> DataFrame:
    """The same of breadcrumbs, joined by `` › ``; null elements are left out."""
    rows = chunks.select(record_id.cast("string").alias("id"), breadcrumbs.alias("crumbs")).where("crumbs is not null")
    return rows.mapInArrow(_clean_crumbs, CLEANED)


def markup_found(cleaned: DataFrame) -> DataFrame:
    """``record_kind, record_id, markup``: one row for each record and language it holds."""
    return cleaned.select("record_kind", "record_id", F.explode("markup").alias("markup")).distinct()

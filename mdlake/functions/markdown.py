"""Markdown structure: CommonMark blocks with tables, task items, footnotes,
strike-through and bare links.

``Parser.document`` gives a tree of ``Node``; containers are parsed by stripping
their prefix from their lines and parsing what is left, with a stack of its own,
so no nesting is too deep. Every text has a tree, and no text without nesting
takes more than about linear time. Known differences from a
complete CommonMark parser: a tab counts as up to the next multiple of four
columns only at the start of a line, and lazy continuation is judged by the last
line of the container alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from typing import Iterator


@dataclass
class Node:
    """``raw`` is the source of the node as its container sees it; ``text`` the
    inline source of a leaf, or the literal of code and HTML."""

    kind: str
    raw: str = ""
    text: str = ""
    level: int | None = None
    info: str = ""
    ordered: bool | None = None
    name: str = ""
    children: list["Node"] = field(default_factory=list)
    cells: list[str] = field(default_factory=list)


#: Every container holds its source, so the rows of a text grow as its nesting.
#: Below level DEPTH, where the level times the characters of a container is more
#: than NESTED, no further containers are opened: their marks are text.
DEPTH, NESTED = 100, 1 << 24

_BLANK = re.compile(r"[ \t]*\Z")
_ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|\Z)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)\Z")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|\Z)")
_PREFIXES = re.compile(r"(?: {0,3}(?:> ?|(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|\Z)))*")
_TASK = re.compile(r"\[[ xX]\](?=[ \t])")
_FOOT = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_DEFINE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:\n[ \t]*)?(<[^<>\n]*>|\S+)(?:[ \t]*(?:\n[ \t]*)?(?<=\s)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_ATTRIBUTES = r"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*"
_ONE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTES}\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_BLOCK_TAGS})(?:\s|/?>|\Z)", re.I), None),
    (re.compile(rf" {{0,3}}(?:{_ONE_TAG})[ \t]*\Z"), None),
]


def _expand(line: str) -> str:
    """Tabs in the indentation as spaces."""
    if "\t" not in line[: len(line) - len(line.lstrip(" \t"))]:
        return line
    at = 0
    for i, c in enumerate(line):
        if c == " ":
            at += 1
        elif c == "\t":
            at += 4 - at % 4
        else:
            return " " * at + line[i:]
    return " " * at


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _html_start(line: str, in_paragraph: bool) -> int | None:
    if "<" not in line[:5]:
        return None
    for i, (begin, _) in enumerate(_HTML[: 6 if in_paragraph else 7]):
        if begin.match(line):
            return i
    return None


def _interrupts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _indent(line) > 3:
        return False
    if _RULE.match(line) or _ATX.match(line) or _QUOTE.match(line) or _html_start(line, True) is not None:
        return True
    m = _FENCE.match(line)
    if m and not (m[2][0] == "`" and "`" in m[3]):
        return True
    m = _ITEM.match(line)
    return bool(m and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))


def cells(line: str) -> list[str]:
    """The cells of a row of a table."""
    row = line.strip()
    out = [x.strip().replace("\\|", "|") for x in re.split(r"(?<!\\)\|", row[1:] if row.startswith("|") else row)]
    return out if out[-1] else out[:-1]


def heading_text(line: str, m: re.Match) -> str:
    """The text of an ATX heading, without closing marks."""
    text = line[m.end() :].strip(" \t")
    bare = text.rstrip("#")
    return bare.rstrip(" \t") if bare != text and (not bare or bare[-1] in " \t") else text


class Parser:
    """``defined``: link reference definitions by folded label."""

    def __init__(self) -> None:
        self.defined: dict[str, str] = {}
        self.notes: list[Node] = []
        self.flat = False
        self.inside: list[tuple[list[str], list[Node]]] = []  # the containers of the block at hand: their lines, and where their nodes go

    def document(self, body: str) -> list[Node]:
        lines = [_expand(x) for x in re.split(r"\r\n|\n|\r", body.replace("\0", "\ufffd"))]
        nodes = self.blocks(lines)
        return self._notes_last(nodes)

    def blocks(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        stack = [[lines, 0, out, False]]
        while stack:
            frame = stack[-1]
            lines, i, into, self.flat = frame
            while i < len(lines) and _BLANK.match(lines[i]):
                i += 1
            if i >= len(lines):
                stack.pop()
                continue
            self.inside = []
            frame[1] = self._one(lines, i, lines[i], into)
            # what is inside of a container comes before what is behind it
            level = len(stack)
            stack += [[inner, 0, children, level > DEPTH and level * sum(map(len, inner)) > NESTED] for inner, children in reversed(self.inside)]
        return out

    def _container(self, kind: str, raw: str, inner: list[str], **more: str) -> Node:
        node = Node(kind, raw, **more)
        self.inside.append((inner, node.children))
        return node

    def _one(self, lines: list[str], i: int, line: str, out: list[Node]) -> int:
        """Parses the block that begins at line i; the line behind it."""
        if _indent(line) >= 4:
            return self._indented(lines, i, out)
        if m := _FENCE.match(line):
            if not (m[2][0] == "`" and "`" in m[3]):
                return self._fenced(lines, i, m, out)
        if m := _ATX.match(line):
            out.append(Node("heading", line, heading_text(line, m), level=len(m[1])))
            return i + 1
        if _RULE.match(line):
            out.append(Node("thematic_break", line))
            return i + 1
        if self.flat and (_QUOTE.match(line) or _ITEM.match(line)):
            return self._paragraph(lines, i, out)
        if _QUOTE.match(line):
            return self._quote(lines, i, out)
        if _ITEM.match(line):
            return self._list(lines, i, out)
        if (kind := _html_start(line, False)) is not None:
            return self._html(lines, i, kind, out)
        if m := _FOOT.match(line):
            return self._note(lines, i, m)
        return self._paragraph(lines, i, out)

    def _indented(self, lines: list[str], i: int, out: list[Node]) -> int:
        end = i
        for j in range(i, len(lines)):
            if _indent(lines[j]) >= 4 and lines[j].strip():
                end = j + 1
            elif lines[j].strip():
                break
        text = "".join(x[4:] + "\n" for x in lines[i:end])
        out.append(Node("code_block", "\n".join(lines[i:end]), text))
        return end

    def _fenced(self, lines: list[str], i: int, m: re.Match, out: list[Node]) -> int:
        shut = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*\Z")
        j, text = i + 1, []
        while j < len(lines) and not shut.match(lines[j]):
            x = lines[j]
            text.append(x[min(_indent(x), len(m[1])) :])
            j += 1
        if j == len(lines):  # not closed: empty lines at the end of all input aren't part of it
            while text and j == len(lines) and text[-1] == "":
                text.pop()
        info = unescape(m[3].strip(" \t"))
        out.append(Node("code_block", "\n".join(lines[i : j + 1]), "".join(x + "\n" for x in text), info=info))
        return j + 1

    def _html(self, lines: list[str], i: int, kind: int, out: list[Node]) -> int:
        end = _HTML[kind][1]
        j = i
        while j < len(lines):
            if end is None and not lines[j].strip():
                break
            j += 1
            if end is not None and end.search(lines[j - 1]):
                break
        out.append(Node("html", "\n".join(lines[i:j]), "".join(x + "\n" for x in lines[i:j])))
        return j

    def _lazy(self, inner: list[str], fences: int, line: str) -> bool:
        """Whether a line without the container's prefix goes on with its last
        paragraph; ``fences`` counts the fences of its lines."""
        if fences % 2 or not line.strip() or not inner or not inner[-1].strip() or _interrupts(line) or (m := _ITEM.match(line)) and line[m.end() :].strip():
            return False
        last = inner[-1]
        last = last[_PREFIXES.match(last).end() :]
        return bool(last.strip()) and _indent(last) < 4 and not (_ATX.match(last) or _RULE.match(last) or _FENCE.match(last))

    def _quote(self, lines: list[str], i: int, out: list[Node]) -> int:
        inner: list[str] = []
        j, fences = i, 0
        while j < len(lines):
            m = _QUOTE.match(lines[j])
            if m:
                inner.append(lines[j][m.end() :])
            elif self._lazy(inner, fences, lines[j]):
                inner.append(lines[j])
            else:
                break
            fences += bool(_FENCE.match(inner[-1]))
            j += 1
        out.append(self._container("block_quote", "\n".join(lines[i:j]), inner))
        return j

    def _list(self, lines: list[str], i: int, out: list[Node]) -> int:
        m = _ITEM.match(lines[i])
        ordered, mark = m[2][0].isdigit(), m[2][-1]
        node = Node("list", ordered=ordered)
        j = i
        while j < len(lines):
            m = _ITEM.match(lines[j])
            if not m or m[2][0].isdigit() != ordered or m[2][-1] != mark or _RULE.match(lines[j]):
                break
            rest = lines[j][m.end() :]
            pad = len(m[3])
            if not rest.strip():
                pad, rest = 1, ""
            elif pad > 4:
                rest, pad = " " * (pad - 1) + rest, 1
            width = len(m[1]) + len(m[2]) + pad
            inner, k, fences = [rest], j + 1, int(bool(_FENCE.match(rest)))
            while k < len(lines):
                line = lines[k]
                if not line.strip():
                    if len(inner) == 1 and not inner[0].strip():
                        break  # an item that begins with an empty line ends at a second one
                    inner.append("")
                elif _indent(line) >= width:
                    inner.append(line[width:])
                elif self._lazy(inner, fences, line):
                    inner.append(line)
                else:
                    break
                fences += bool(_FENCE.match(inner[-1]))
                k += 1
            last = k
            while inner and not inner[-1].strip() and len(inner) > 1:
                inner.pop()
                last -= 1
            task = _TASK.match(inner[0])
            if task:
                inner[0] = inner[0][task.end() :].lstrip(" \t")
            node.children.append(self._container("task_item" if task else "list_item", "\n".join(lines[j:last]), inner))
            j = k
            end = last
        node.raw = "\n".join(lines[i:end])
        out.append(node)
        return j

    def _note(self, lines: list[str], i: int, m: re.Match) -> int:
        inner, j = [lines[i][m.end() :]], i + 1
        fences = int(bool(_FENCE.match(inner[0])))
        while j < len(lines):
            line = lines[j]
            if not line.strip():
                inner.append("")
            elif _indent(line) >= 4:
                inner.append(line[4:])
            elif not _FOOT.match(line) and self._lazy(inner, fences, line):
                inner.append(line)
            else:
                break
            fences += bool(_FENCE.match(inner[-1]))
            j += 1
        self.notes.append(self._container("footnote_definition", "\n".join(lines[i:j]).rstrip(), inner, name=m[1]))
        return j

    def _paragraph(self, lines: list[str], i: int, out: list[Node]) -> int:
        j = i + 1
        while j < len(lines):
            line = lines[j]
            if not line.strip():
                break
            if (m := _SETEXT.match(line)) and (text := self._define("\n".join(lines[i:j]))).strip():
                out.append(Node("heading", "\n".join(lines[i : j + 1]), text.strip(), level=1 if m[1][0] == "=" else 2))
                return j + 1
            if j > i and "|" in lines[j - 1] and _DELIMITER.match(line) and len(cells(lines[j - 1])) == len(cells(line)) and ("|" in line or len(cells(line)) == 1):
                self._text(lines[i : j - 1], out)
                return self._table(lines, j - 1, out)
            if _interrupts(line):
                break
            j += 1
        self._text(lines[i:j], out)
        return j

    def _define(self, text: str) -> str:
        """Takes link reference definitions off the front of a paragraph."""
        at = 0
        while m := _DEFINE.match(text, at):
            if m[1].startswith("^"):
                break
            url = m[2][1:-1] if m[2].startswith("<") else m[2]
            self.defined.setdefault(label(m[1]), unescape(url))
            at = m.end()
        return text[at:]

    def _text(self, lines: list[str], out: list[Node]) -> None:
        raw = "\n".join(lines)
        text = self._define(raw)
        if text.strip():
            out.append(Node("paragraph", raw, "\n".join(x.lstrip(" ") for x in text.split("\n")).rstrip()))

    def _table(self, lines: list[str], i: int, out: list[Node]) -> int:
        width = len(cells(lines[i]))
        node, j = Node("table"), i + 2
        while j < len(lines) and lines[j].strip() and not _interrupts(lines[j]) and _indent(lines[j]) < 4:
            j += 1
        for k in (i, *range(i + 2, j)):
            node.cells += (cells(lines[k]) + [""] * width)[:width]
        node.raw = "\n".join(lines[i:j])
        out.append(node)
        return j

    def _notes_last(self, nodes: list[Node]) -> list[Node]:
        """Footnotes that are referred to go to the end, in the order of their
        first reference; others go."""
        if not self.notes:
            return nodes
        known = {label(n.name): n for n in reversed(self.notes)}
        order: list[str] = []

        def visit(some: list[Node]) -> None:
            for n in preorder(some):
                if n.kind in ("heading", "paragraph"):
                    order.extend(label(x) for x in re.findall(r"\[\^([^\]\s]+)\]", n.text))
                order.extend(label(x) for c in n.cells for x in re.findall(r"\[\^([^\]\s]+)\]", c))

        visit(nodes)
        done = 0
        found: dict[str, None] = {}
        while done < len(order):  # a footnote may refer to another
            name = order[done]
            done += 1
            if name in known and name not in found:
                found[name] = None
                visit(known[name].children)
        self.used = set(found)
        return nodes + [known[x] for x in found]


def preorder(nodes: list[Node]) -> Iterator[Node]:
    todo = nodes[::-1]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children[::-1]


def label(text: str) -> str:
    return " ".join(text.split()).casefold()


_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])|(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] if m[1] else html.unescape(m[2]), text)


@dataclass
class Link:
    image: bool
    url: str
    anchor: str
    start: int = 0


_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_TAG = re.compile(_ONE_TAG)
_SPANS = (("<!--", "-->"), ("<?", "?>"), ("<!", ">"))
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+|[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_TARGET = re.compile(r"\(\s*(<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_PUNCTUATION = re.compile(r"[^\w\s]|_")
_PLAIN = re.compile(r"[^\\`\n*_~\[\]!<&]+")
_LINK_START = re.compile(r"(?<=[ \t(])(?:https?://|ftp://|www\.|[A-Za-z0-9._+-]+@)")
_TICKS = re.compile("`+")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)


def _bare_end(text: str) -> str:
    """A bare link without the punctuation that ends its sentence."""
    while text:
        if text[-1] in "?!.,:*_~'\"":
            text = text[:-1]
        elif text[-1] == ")" and text.count(")") > text.count("("):
            text = text[:-1]
        elif m := re.search(r"&[A-Za-z0-9]+;\Z", text):
            text = text[: m.start()]
        else:
            break
    return text


class _Inline:
    """Pieces of plain text; delimiter runs that turn out to be emphasis become
    empty, brackets that turn out to be links too."""

    def __init__(self, text: str, parser: Parser, notes: set[str]):
        self.s, self.parser, self.notes = text, parser, notes
        self.pieces: list[str] = []
        self.runs: list[list] = []  # [piece, character, count, opens, closes, first count]
        self.open: list[tuple[int, bool, int, int]] = []  # (piece, image, source position, runs so far)
        self.inactive, self.live = 0, 0  # brackets below can't be links any more; brackets above that may be links
        self.links: list[Link] = []
        self.next_link = -1
        self.absent: set[str] = set()  # ends that don't occur any more
        self.ticks: dict[int, list[int]] | None = None

    def run(self) -> "_Inline":
        s, i, n = self.s, 0, len(self.s)
        while i < n:
            c = s[i]
            if c == "\\" and i + 1 < n:
                if s[i + 1] == "\n":
                    self.pieces.append(" ")
                    i = self._skip(i + 2)
                elif _PUNCTUATION.match(s[i + 1]) and s[i + 1] < "\x80":
                    self.pieces.append(s[i + 1])
                    i += 2
                else:
                    self.pieces.append(c)
                    i += 1
            elif c == "`":
                i = self._code(i)
            elif c == "\n":
                if self.pieces:
                    self.pieces[-1] = self.pieces[-1].rstrip(" ")
                self.pieces.append(" ")
                i = self._skip(i + 1)
            elif c in "*_~":
                i = self._delimiter(i)
            elif c == "[" or c == "!" and s[i + 1 : i + 2] == "[":
                m = _NOTE.match(s, i) if self.notes else None
                if m and label(m[1]) in self.notes:
                    i = m.end()
                    continue
                size = 1 + (c == "!")
                self.open.append((len(self.pieces), c == "!", i + size, len(self.runs)))
                self.live += c == "["
                self.pieces.append(s[i : i + size])
                i += size
            elif c == "]":
                i = self._close(i)
            elif c == "<" and (m := _AUTO.match(s, i)):
                text = m[1] or m[2]
                self.links.append(Link(False, text if m[1] else f"mailto:{text}", text, i))
                self.pieces.append(text)
                i = m.end()
            elif c == "<" and (end := self._tag(i)):
                i = end
            elif c == "&" and (m := _ESCAPE.match(s, i)):
                self.pieces.append(html.unescape(m[2]))
                i = m.end()
            elif (c.isalnum()) and (i == 0 or s[i - 1] in " \t\n*_~(") and not self.live and (m := _BARE.match(s, i)) and (text := _bare_end(m[0])):
                mail = "@" in text and not re.match(r"https?:|ftp:|www\.", text)
                if text in ("www", "http://", "https://", "ftp://") or mail and not re.search(r"@.*\..*[A-Za-z0-9]\Z", text):
                    self.pieces.append(c)
                    i += 1
                else:
                    self.links.append(Link(False, f"mailto:{text}" if mail else f"http://{text}" if text.startswith("www.") else text, text, i))
                    self.pieces.append(text)
                    i += len(text)
            else:
                if self.next_link <= i:
                    b = _LINK_START.search(s, i + 1)
                    self.next_link = b.start() if b else n
                m = _PLAIN.match(s, i, self.next_link)
                end = m.end() if m else i + 1
                self.pieces.append(s[i:end])
                i = end
        self._emphasis(0)
        self.links.sort(key=lambda x: x.start)
        return self

    def _skip(self, i: int) -> int:
        while i < len(self.s) and self.s[i] == " ":
            i += 1
        return i

    def _tag(self, i: int) -> int:
        """The end of a tag, comment, instruction or declaration, or 0."""
        s = self.s
        for begin, shut in _SPANS:
            if s.startswith(begin, i):
                if shut in self.absent or begin == "<!" and not ("A" <= s[i + 2 : i + 3].upper() <= "Z"):
                    return 0
                end = s.find(shut, i + len(begin))
                if end < 0:
                    self.absent.add(shut)
                    return 0
                return end + len(shut)
        m = None if ">" in self.absent else _TAG.match(s, i)
        if m is None and ">" not in self.absent and s.find(">", i) < 0:
            self.absent.add(">")
        return m.end() if m else 0

    def _code(self, i: int) -> int:
        s = self.s
        if self.ticks is None:
            self.ticks = {}
            for m in _TICKS.finditer(s):
                self.ticks.setdefault(m.end() - m.start(), []).append(m.start())
        n = _TICKS.match(s, i).end() - i
        same = self.ticks.get(n, [])
        k = bisect_left(same, i + n)
        if k == len(same):
            self.pieces.append("`" * n)
            return i + n
        text = s[i + n : same[k]].replace("\n", " ")
        if len(text) > 1 and text[0] == text[-1] == " " and text.strip():
            text = text[1:-1]
        self.pieces.append(f"`{text}`")
        return same[k] + n

    def _delimiter(self, i: int) -> int:
        s, c, j = self.s, self.s[i], i
        while j < len(s) and s[j] == c:
            j += 1
        before, after = s[i - 1] if i else " ", s[j] if j < len(s) else " "
        space = (before.isspace(), after.isspace())
        punct = (bool(_PUNCTUATION.match(before)), bool(_PUNCTUATION.match(after)))
        left = not space[1] and (not punct[1] or space[0] or punct[0])
        right = not space[0] and (not punct[0] or space[1] or punct[1])
        if c == "_":
            left, right = left and (not right or punct[0]), right and (not left or punct[1])
        if c == "~" and j - i > 2:
            left = right = False
        self.runs.append([len(self.pieces), c, j - i, left, right, j - i])
        self.pieces.append(c * (j - i))
        return j

    def _emphasis(self, bottom: int) -> None:
        """Pairs delimiter runs from ``bottom`` on. ``before`` links the runs
        that may still open; ``floor`` says, for runs that close alike, below
        which none of these fits."""
        before: dict[int, int] = {}
        floor: dict[tuple[str, bool, int], int] = {}
        last = -1
        for k in range(bottom, len(self.runs)):
            shut = self.runs[k]
            while shut[4] and shut[2]:
                key = (shut[1], shut[3], shut[2] if shut[1] == "~" else shut[5] % 3)
                o, stop = last, floor.get(key, -1)
                while o > stop and not self._fits(self.runs[o], shut):
                    o = before[o]
                if o <= stop:
                    floor[key] = last
                    break
                start = self.runs[o]
                used = shut[2] if shut[1] == "~" else 2 if start[2] >= 2 and shut[2] >= 2 else 1
                for r in (start, shut):
                    r[2] -= used
                    self.pieces[r[0]] = r[1] * r[2]
                last = o if start[2] else before[o]
            if shut[3] and shut[2]:
                before[k], last = last, k
        del self.runs[bottom:]

    @staticmethod
    def _fits(start: list, shut: list) -> bool:
        if start[1] != shut[1]:
            return False
        if shut[1] == "~":
            return start[2] == shut[2]
        return not ((start[4] or shut[3]) and (start[5] + shut[5]) % 3 == 0 and (start[5] % 3 or shut[5] % 3))

    def _close(self, i: int) -> int:
        if not self.open:
            self.pieces.append("]")
            return i + 1
        piece, image, start, runs = self.open.pop()
        active = image or len(self.open) >= self.inactive
        self.inactive = min(self.inactive, len(self.open))
        if not active:
            self.pieces.append("]")
            return i + 1
        self.live -= not image
        s, url, end = self.s, None, i + 1
        if m := _TARGET.match(s, i + 1):
            target = m[1]
            url, end = unescape(target[1:-1] if target.startswith("<") else target), m.end()
        elif self.parser.defined:
            m = _LABEL.match(s, i + 1)
            name = m[1] if m and m[1].strip() else s[start:i] if i - start < 1000 else ""
            url = self.parser.defined.get(label(name))
            if url is not None and m:
                end = m.end()
        if url is None:
            self.pieces.append("]")
            return i + 1
        self._emphasis(runs)
        self.pieces[piece] = ""
        anchor = "".join(self.pieces[piece:])
        self.pieces[piece:] = [anchor]  # one piece from now on
        self.links.append(Link(image, url, anchor.strip(), start))
        if not image:  # links aren't nested
            self.inactive, self.live = len(self.open), 0
        return end


def inline(text: str, parser: Parser) -> tuple[str, list[Link]]:
    """(plain text, links and images in document order) of inline source."""
    if not re.search(r"[\\`\n*_~\[\]!<&@]|https?://|ftp://|www\.", text):
        return text, []
    done = _Inline(text, parser, getattr(parser, "used", set())).run()
    return "".join(done.pieces), done.links


def link_type(link: Link) -> str:
    if link.image:
        return "image_link"
    return "auto_link" if link.anchor == link.url or link.url == f"mailto:{link.anchor}" else "markdown_link"


def wiki_links(body: str) -> list[tuple[str, str]]:
    """(target, anchor) of every ``[[target|anchor]]`` of the raw body, also in
    code. One with nothing in it or with a line feed is skipped."""
    out, at = [], 0
    while (at := body.find("[[", at)) >= 0:
        end = body.find("]]", at + 2)
        if end < 0:
            break
        inner = body[at + 2 : end]
        at = end + 2
        if not inner or "\n" in inner:
            continue
        target, _, anchor = inner.partition("|")
        target = target.strip()
        if target:
            out.append((target, anchor.strip() if "|" in inner else target))
    return out

"""Go source -> functions: a tokenizer and a scanner of declarations.

A file whose literals, comments or brackets don't end, or whose tokens don't follow the
grammar (``grammar.check``), gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import grammar

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS_STATEMENT = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)
      |(?P<ident>[^\W\d]\w*)
      |(?P<number>0[xX][\da-fA-F_.]+(?:[pP][+-]?[\d_]+)?i?|(?:\d[\d_]*)?\.?\d[\w_]*(?:\.[\d_]*)?(?:(?<=[eE])[+-][\d_]+)?i?\.?)
      |(?P<raw>`[^`]*`)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<rune>'(?:[^'\\\n]|\\.[^'\n]*)')
      |(?P<op><-|\+\+|--|&\^=|<<=|>>=|&&|\|\||&\^|<<|>>|:=|\.\.\.|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~()\[\]{},;:.])""",
    re.X,
)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_DIRECTIVE = re.compile(r"//(?:line |extern |export |[a-z0-9]+:[a-z0-9])")
_LINE = re.compile(r"//line (?:.*:)?(\d+)(?::\d+)?\s*$")


class Malformed(ValueError):
    """What makes a file give no rows."""


@dataclass
class Token:
    kind: str
    text: str
    start: int
    line: int


@dataclass
class Function:
    name: str
    receiver_type: str
    signature: str
    body: str
    start_line: int
    doc_comment: str
    exported: bool
    package: str
    callees: list[str] = field(default_factory=list)


def tokens(source: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens with the semicolons that line ends stand for, and comments as (first line, last line, text)."""
    out: list[Token] = []
    comments: list[tuple[int, int, str]] = []
    at, line, n = 0, 1, len(source)

    def end_line() -> None:
        if out and (out[-1].kind in ("ident", "number", "string", "rune", "raw") and (out[-1].text not in KEYWORDS or out[-1].text in _ENDS_STATEMENT) or out[-1].text in _ENDS_STATEMENT):
            out.append(Token("op", ";", at, line))

    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            raise Malformed(f"line {line}: {source[at]!r}")
        kind, text = m.lastgroup, m.group()
        if kind == "line":
            end_line()
            line += 1
        elif kind == "comment":
            lines = text.count("\n")
            if lines:
                end_line()
            comments.append((line, line + lines, text))
            line += lines
        elif kind != "space":
            out.append(Token(kind, text, at, line))
            line += text.count("\n") if kind == "raw" else 0
        at = m.end()
    end_line()
    return out, comments


def _closers(ts: list[Token]) -> dict[int, int]:
    """For each opening bracket its closing one."""
    stack, out = [], {}
    for i, t in enumerate(ts):
        if t.kind != "op":
            continue
        if t.text in "([{" and len(t.text) == 1:
            stack.append(i)
        elif t.text in _PAIRS:
            if not stack or ts[stack[-1]].text != _PAIRS[t.text]:
                raise Malformed(f"line {t.line}: {t.text}")
            out[stack.pop()] = i
    if stack:
        raise Malformed(f"line {ts[stack[-1]].line}: not closed")
    return out


def doc_text(comments: list[str]) -> str:
    """A comment group without its markers, directives and outer blank lines; inner blank lines come singly."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("//"):
            if not _DIRECTIVE.match(c):
                lines.append(c[3:] if c[2:3] == " " else c[2:])
        else:
            lines += c[2:-2].split("\n")
    out: list[str] = []
    for x in (x.rstrip() for x in lines):
        if x or out and out[-1]:
            out.append(x)
    return "\n".join(out).strip("\n")


def calls(ts: list[Token], closers: dict[int, int], first: int, last: int) -> list[str]:
    """Distinct names called between two tokens, sorted: ``f`` for f(), ``x.f`` for x.f(), ``f`` for any longer chain."""
    found: set[str] = set()
    i = first
    while i < last:
        t = ts[i]
        if t.text in ("interface", "struct") and ts[i + 1].text == "{":
            i = closers[i + 1] + 1  # method specifications and fields aren't calls
            continue
        if t.kind == "ident" and t.text not in KEYWORDS and ts[i + 1].text == "(":
            before = ts[i - 1]
            if before.text != ".":
                if before.text not in ("]", "chan", "func"):
                    found.add(t.text)
            else:
                x, y = ts[i - 2], ts[i - 3]
                if x.kind == "ident" and x.text not in KEYWORDS:
                    if y.text not in ("]", "chan"):
                        found.add(t.text if y.text == "." else f"{x.text}.{t.text}")
                else:
                    found.add(t.text)
        i += 1
    return sorted(found)


def _flat(source: str, ts: list[Token], a: int, b: int) -> str:
    """Source of tokens a to b, on one line."""
    if a > b:
        return ""
    return " ".join(source[ts[a].start : ts[b].start + len(ts[b].text)].split())


def _receiver(ts: list[Token], a: int, b: int) -> str:
    """The type of the first receiver between two brackets; an identifier before it is its name."""
    own = [t for t in ts[a + 1 : b] if t.text != ";"]
    depth, part = 0, []
    for t in own:
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
        if t.text == "," and not depth:
            break
        part.append(t)
    if len(part) > 1 and part[0].kind == "ident" and part[1].text not in (".", "["):
        part = part[1:]
    elif len(part) > 3 and part[1].text == "[" and part[-1].text != "]":
        part = part[1:]
    return "".join(", " if t.text == "," else t.text for t in part)


def _function(source: str, ts: list[Token], closers: dict[int, int], i: int) -> tuple[int, dict]:
    """The declaration at ``func``: the first token after it, and what it says."""
    start, receiver = ts[i], ""
    i += 1
    if ts[i].text == "(":
        receiver = _receiver(ts, i, closers[i])
        if not receiver:
            raise Malformed(f"line {ts[i].line}: receiver")
        i = closers[i] + 1
    if ts[i].kind != "ident" or ts[i].text in KEYWORDS:
        raise Malformed(f"line {ts[i].line}: name")
    name = ts[i].text
    i += 1
    if ts[i].text == "[":
        i = closers[i] + 1
    if ts[i].text != "(":
        raise Malformed(f"line {ts[i].line}: parameters")
    params = (i, closers[i])
    i = closers[i] + 1
    a = i
    while i < len(ts) and ts[i].text not in (";", "{"):
        if ts[i].text in ("struct", "interface") and i + 1 < len(ts) and ts[i + 1].text == "{":
            i = closers[i + 1] + 1
        elif i in closers:
            i = closers[i] + 1
        elif ts[i].kind == "ident" or ts[i].text in ("*", ".", "<-", "..."):
            i += 1
        else:
            raise Malformed(f"line {ts[i].line}: result")
    results = _flat(source, ts, a, i - 1)
    signature = _flat(source, ts, *params)
    if results:
        signature += " " + (results if results.startswith("(") else f"({results})")
    names: list[str] = []
    end = i - 1
    if i < len(ts) and ts[i].text == "{":
        end = closers[i]
        names = calls(ts, closers, i + 1, end)
        i = end + 1
    text = source[start.start : ts[end].start + len(ts[end].text)]
    return i, {"name": f"{receiver}.{name}" if receiver else name, "receiver_type": receiver, "signature": signature, "body": text, "exported": name[0].isupper(), "callees": names, "line": start.line}


def functions(source: str) -> list[Function]:
    """The top-level functions and methods of a file, in order; none if the file is malformed."""
    try:
        return _functions(source.removeprefix("﻿"))
    except (Malformed, grammar.Unexpected, IndexError, KeyError):
        return []


def _functions(source: str) -> list[Function]:
    ts, comments = tokens(source)
    closers = _closers(ts)
    if len(ts) < 2 or ts[0].text != "package" or ts[1].kind != "ident" or ts[1].text in KEYWORDS or len(ts) > 2 and ts[2].text != ";":
        raise Malformed("package")
    grammar.check(ts, KEYWORDS)
    package, out, i, imports = ts[1].text, [], 3, True
    ends = {last: k for k, (_, last, _) in enumerate(comments)}
    moved = [(line, int(m.group(1)) - line - 1) for line, _, c in comments if (m := _LINE.match(c))]
    while i < len(ts):
        t = ts[i]
        if t.text == ";":
            i += 1
            continue
        if t.text == "func":
            before = i - 1
            i, found = _function(source, ts, closers, i)
            line, doc, above = found.pop("line"), [], None
            k = ends.get(line - 1)
            while k is not None and k >= 0 and (above is None or comments[k][1] == above - 1):
                doc.insert(0, comments[k][2])
                above = comments[k][0]
                k -= 1
            while doc and before >= 0 and ts[before].line >= comments[ends[line - 1]][0]:
                if ts[before].line == comments[ends[line - 1]][0] and ts[before].text != ";":
                    doc = []  # it trails other code on its line
                before -= 1
            shift = next((d for at, d in reversed(moved) if at < line), 0)
            out.append(Function(package=package, start_line=line + shift, doc_comment=doc_text(doc), **found))
            imports = False
        elif t.text in ("import", "type", "var", "const"):
            if t.text == "import" and not imports:
                raise Malformed(f"line {t.line}: import")
            imports &= t.text == "import"
            i += 1
            if ts[i].text == ";":
                raise Malformed(f"line {t.line}: {t.text}")
            while i < len(ts) and ts[i].text != ";":
                i = closers[i] + 1 if i in closers else i + 1
        else:
            raise Malformed(f"line {t.line}: {t.text}")
        if i < len(ts) and ts[i].text != ";":
            raise Malformed(f"line {ts[i].line}: {ts[i].text}")
    return out

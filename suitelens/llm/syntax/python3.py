"""Logical lines and tokens of Python 3."""

from __future__ import annotations

import re

_PREFIX = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
_TOKEN = re.compile(
    r"""(?P<gap>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<nl>\r\n|\n|\r)"""
    rf"""|(?P<string>{_PREFIX}(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?:[^'\\\n\r]|\\\r?\n|\\[\s\S])*'|"(?:[^"\\\n\r]|\\\r?\n|\\[\s\S])*"))"""
    r"""|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|!=|==|<=|>=|<<|>>|\*\*|//|[+\-*/%@&|^]=|[+\-*/%@&|^~<>()\[\]{},:.;=])|(?P<bad>[\s\S])"""
)
_KEYWORDS = set(
    "and as assert async await break class continue def del elif else except finally for from global if import in is"
    " lambda nonlocal not or pass raise return try while with yield".split()
)
_OPS = dict.fromkeys("== != <= >= < > << >> // % & | ^ and or".split(), "BIN")
_OPS |= dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "AUG")
_OPS |= {"+": "PM", "-": "PM", "~": "INV", "...": "ELLIPSIS"}


def tokens(code: str, cache: dict) -> tuple[list[str], list[int]]:
    """(kinds, offsets). What can't be a token, or breaks the indentation, is BAD."""
    kinds: list[str] = []
    at: list[int] = []
    indents, depth, fresh = [0], 0, True
    code = code.removeprefix("\ufeff")
    column = 0
    line_start = 0

    def add(kind: str, where: int) -> None:
        kinds.append(kind)
        at.append(where)

    stack: list[str] = []
    for m in _TOKEN.finditer(code):
        group, text, where = m.lastgroup, m.group(), m.start()
        if group == "gap":
            if fresh and depth == 0 and where == line_start:
                column = len(text.expandtabs(8))
            continue
        if group == "comment":
            continue
        if group == "nl":
            if not fresh and depth == 0:
                add("NEWLINE", where)
            if depth == 0:
                fresh, column, line_start = True, 0, m.end()
            continue
        if fresh and depth == 0:
            fresh = False
            if column > indents[-1]:
                indents.append(column)
                add("INDENT", where)
            while column < indents[-1]:
                indents.pop()
                add("DEDENT", where)
                if column > indents[-1]:
                    add("BAD", where)
                    break
        if group == "string":
            add("STRING", where)
        elif group == "number":
            follow = code[m.end() : m.end() + 1]
            bad = follow.isalnum() or follow == "_" or re.fullmatch(r"0[\d_]*[1-9][\d_]*", text) is not None
            add("BAD" if bad else "ATOM", where)
        elif group == "name":
            add("ATOM" if text in ("None", "True", "False") else text if text in _KEYWORDS else "NAME", where)
            if text in ("and", "or"):
                kinds[-1] = "BIN"
        elif group == "bad":
            add("BAD", where)
        else:
            if text in "([{":
                stack.append(text)
                depth += 1
            elif text in ")]}":
                if not stack or stack.pop() + text not in ("()", "[]", "{}"):
                    add("BAD", where)
                depth = max(0, depth - 1)
            add(_OPS.get(text, text), where)
    end = len(code)
    if not fresh and depth == 0:
        add("NEWLINE", end)
    for _ in indents[1:]:
        add("DEDENT", end)
    _soft(kinds, at, code)
    return kinds, at


def _soft(kinds: list[str], at: list[int], code: str) -> None:
    """match and case are words of the language only where a block follows; with ( ) may hold several items."""
    n = len(kinds)
    for i, k in enumerate(kinds):
        new_line = i == 0 or kinds[i - 1] in ("NEWLINE", "INDENT", "DEDENT")
        if k == "NAME" and new_line and code.startswith(("match", "case"), at[i]):
            word = re.match(r"\w+", code[at[i] :]).group()
            j = i + 1
            while j < n and kinds[j] != "NEWLINE":
                j += 1
            if word == "match" and i + 1 < n and kinds[i + 1] not in ("=", ".", ",", ")", ":", "AUG", "NEWLINE") and kinds[j - 1] == ":" and kinds[j + 1 : j + 2] == ["INDENT"]:
                kinds[i] = "match"
            elif word == "case" and i + 1 < n and kinds[i + 1] not in ("=", ".", ",", ")", ":", "AUG", "NEWLINE") and ":" in kinds[i:j]:
                kinds[i] = "case"
        elif k == "with" and i + 1 < n and kinds[i + 1] == "(":
            depth, items, j = 0, False, i + 1
            while j < n:
                if kinds[j] in ("(", "[", "{"):
                    depth += 1
                elif kinds[j] in (")", "]", "}"):
                    depth -= 1
                    if not depth:
                        break
                elif kinds[j] == "as" and depth == 1:
                    items = True
                j += 1
            if items and kinds[j + 1 : j + 2] == [":"]:
                kinds[i + 1] = "WLP"

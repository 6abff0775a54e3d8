"""Tokens of JSON, XML and YAML."""

from __future__ import annotations

import re

_JSON = re.compile(
    r'[ \t\n\r]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
    r"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b|[\s\S]",
    re.ASCII,
)


def json_tokens(code: str, cache: dict) -> tuple[list[str], list[int]]:
    kinds, at, where = [], [], 0
    for text in _JSON.findall(code):
        c = text[0]
        if c not in " \t\n\r":
            if c == '"':
                kinds.append("STRING" if len(text) > 1 else "BAD")
            elif c in "{}[]:,":
                kinds.append(c)
            else:
                kinds.append("SCALAR" if len(text) > 1 or c.isdigit() and c.isascii() else "BAD")
            at.append(where)
        where += len(text)
    return kinds, at


_NAME = r"[A-Za-z_:À-˿Ͱ-῿Ⰰ-퟿豈-�][\w:.\-·À-�]*"
_ATTRIBUTE = rf"""[ \t\r\n]+({_NAME})[ \t\r\n]*=[ \t\r\n]*("[^<"]*"|'[^<']*')"""
_XML = re.compile(
    rf"""(?P<decl><\?xml[ \t\r\n][^>]*\?>)|(?P<comment><!--(?:[^-]|-(?!-))*-->)|(?P<cdata><!\[CDATA\[[\s\S]*?\]\]>)"""
    rf"""|(?P<doctype><!DOCTYPE[ \t\r\n]+{_NAME}(?:[^<>\[\]"']|"[^"]*"|'[^']*')*(?:\[[^\]]*\][ \t\r\n]*)?>)"""
    rf"""|(?P<pi><\?(?!(?i:xml)[ \t\r\n?]){_NAME}(?:[ \t\r\n][\s\S]*?)?\?>)"""
    rf"""|<(?P<open>{_NAME})(?P<attrs>(?:{_ATTRIBUTE})*)[ \t\r\n]*(?P<slash>/?)>|</(?P<close>{_NAME})[ \t\r\n]*>"""
    r"""|(?P<space>[ \t\r\n]+(?=<|\Z))|(?P<text>[^<]+)|(?P<bad><)"""
)
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_REFERENCE = re.compile(rf"&(?:(#\d+|#x[0-9a-fA-F]+)|({_NAME}));")
_DECLARATION = re.compile(
    r"""<\?xml[ \t\r\n]+version[ \t\r\n]*=[ \t\r\n]*(?:"1\.\d+"|'1\.\d+')(?:[ \t\r\n]+encoding[ \t\r\n]*=[ \t\r\n]*(?:"[A-Za-z][\w.\-]*"|'[A-Za-z][\w.\-]*'))?"""
    r"""(?:[ \t\r\n]+standalone[ \t\r\n]*=[ \t\r\n]*(?:"(?:yes|no)"|'(?:yes|no)'))?[ \t\r\n]*\?>""",
    re.ASCII,
)
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def xml_tokens(code: str, cache: dict) -> tuple[list[str], list[int]]:
    kinds, at, names = [], [], []
    declared = {"amp", "lt", "gt", "apos", "quot"}
    code = code.removeprefix("﻿")
    wrong = _NOT_XML.search(code)

    def whole(text: str) -> bool:
        """Every & begins a reference to a character or a known entity."""
        n = 0
        for m in _REFERENCE.finditer(text):
            n += 1
            if m[2] and m[2] not in declared:
                return False
            if m[1] and not _valid(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:])):
                return False
        return n == text.count("&")

    for m in _XML.finditer(code):
        kind, text = m.lastgroup, m.group()
        if m["open"]:
            found = _ATTRIBUTES.findall(m["attrs"]) if m["attrs"] else []
            fine = len({a for a, _ in found}) == len(found) and all(whole(v) for _, v in found)
            kind = "EMPTY" if m["slash"] else "OPEN"
            if kind == "OPEN":
                names.append(m["open"])
            kind = kind if fine else "BAD"
        elif m["close"]:
            kind = "CLOSE" if names and names.pop() == m["close"] else "BAD"
        elif kind == "decl":
            kind = "DECL" if not m.start() and _DECLARATION.fullmatch(text) else "BAD"
        elif kind == "doctype":
            declared |= set(re.findall(rf"<!ENTITY[ \t\r\n]+({_NAME})", text))
            kind = "DOCTYPE"
        elif kind == "text":
            kind = "TEXT" if whole(text) and "]]>" not in text else "BAD"
        else:
            kind = kind.upper()
        if wrong and m.start() <= wrong.start() < m.end():
            kind = "BAD"
        kinds.append(kind)
        at.append(m.start())
    return kinds, at


def _valid(c: int) -> bool:
    return c in (9, 10, 13) or 0x20 <= c <= 0xD7FF or 0xE000 <= c <= 0xFFFD or 0x10000 <= c <= 0x10FFFF


class _Stop(Exception):
    """No token can stand at this offset."""


_BLANK = " \t\n\r\x85  \0"
_BREAKS = "\n\r\x85  "
_NOT_YAML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\ud800-\udfff￾￿]")


class _Yaml:
    """Scans YAML to tokens. A key is recognised when its ':' comes, so places where one may have begun are kept."""

    def __init__(self, code: str):
        self.code = code.removeprefix("﻿") + "\0"
        self.i, self.line, self.line_at = 0, 0, 0
        self.kinds: list[str] = []
        self.at: list[int] = []
        self.flow: list[str] = []
        self.indent, self.indents = -1, []
        self.may_be_key = True
        self.keys: dict[int, tuple[int, bool, int, int, int]] = {}  # by flow depth: token, needed, line, offset, column

    @property
    def column(self) -> int:
        return self.i - self.line_at

    def add(self, kind: str) -> None:
        self.kinds.append(kind)
        self.at.append(self.i)

    def put(self, where: int, kind: str, offset: int) -> None:
        self.kinds.insert(where, kind)
        self.at.insert(where, offset)

    def next_line(self) -> None:
        if self.code.startswith("\r\n", self.i):
            self.i += 1
        self.i += 1
        self.line += 1
        self.line_at = self.i

    def close_to(self, column: int) -> None:
        if self.flow:
            return
        while self.indent > column:
            self.indent = self.indents.pop()
            self.add("END")

    def opened(self, column: int) -> bool:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def forget_old_keys(self) -> None:
        for depth, (_, needed, line, offset, _) in list(self.keys.items()):
            if line != self.line or self.i - offset > 1024:
                if needed:
                    raise _Stop
                del self.keys[depth]

    def note_key(self) -> None:
        needed = not self.flow and self.indent == self.column
        if self.may_be_key:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.kinds), needed, self.line, self.i, self.column)

    def drop_key(self) -> None:
        old = self.keys.pop(len(self.flow), None)
        if old and old[1]:
            raise _Stop

    def spaces(self) -> None:
        code = self.code
        while True:
            while code[self.i] == " ":
                self.i += 1
            if code[self.i] == "#":
                while code[self.i] not in _BREAKS + "\0":
                    self.i += 1
            if code[self.i] in _BREAKS:
                self.next_line()
                if not self.flow:
                    self.may_be_key = True
            else:
                return

    def run(self) -> None:
        code = self.code
        wrong = _NOT_YAML.search(code[:-1])
        while True:
            self.spaces()
            self.forget_old_keys()
            self.close_to(self.column)
            if wrong and self.i > wrong.start():
                raise _Stop
            c, after = code[self.i], code[self.i + 1 : self.i + 2]
            blank_after = after in _BLANK or not after
            if c == "\0":
                if self.i < len(code) - 1:
                    raise _Stop
                self.close_to(-1)
                self.drop_key()
                return
            marker = self.column == 0 and code[self.i + 3 : self.i + 4] in _BLANK
            if c == "%" and self.column == 0:
                self.close_to(-1)
                self.drop_key()
                self.may_be_key = False
                self.add("DIRECTIVE")
                while code[self.i] not in _BREAKS + "\0":
                    self.i += 1
            elif marker and code.startswith(("---", "..."), self.i):
                self.close_to(-1)
                self.drop_key()
                self.may_be_key = False
                self.add(code[self.i : self.i + 3])
                self.i += 3
            elif c in "[{":
                self.note_key()
                self.add(c)
                self.flow.append(c)
                self.may_be_key = True
                self.i += 1
            elif c in "]}":
                self.drop_key()
                if self.flow:
                    self.flow.pop()
                self.may_be_key = False
                self.add(c)
                self.i += 1
            elif c == ",":
                self.may_be_key = True
                self.drop_key()
                self.add(c)
                self.i += 1
            elif c == "-" and blank_after:
                if not self.flow:
                    if not self.may_be_key:
                        raise _Stop
                    if self.opened(self.column):
                        self.add("SEQ")
                self.may_be_key = True
                self.drop_key()
                self.add("-")
                self.i += 1
            elif c == "?" and (self.flow or blank_after):
                if not self.flow:
                    if not self.may_be_key:
                        raise _Stop
                    if self.opened(self.column):
                        self.add("MAP")
                self.may_be_key = not self.flow
                self.drop_key()
                self.add("KEY")
                self.i += 1
            elif c == ":" and (self.flow or blank_after):
                self.value()
            elif c in "*&":
                self.note_key()
                self.may_be_key = False
                self.add("ALIAS" if c == "*" else "ANCHOR")
                name = re.compile(r"[\w-]+").match(code, self.i + 1)
                if not name or code[name.end()] not in _BLANK + "?:,]}%@`":
                    raise _Stop
                self.i = name.end()
            elif c == "!":
                self.note_key()
                self.may_be_key = False
                self.add("TAG")
                tag = re.compile(r"!<[^>\s]+>|!(?:[\w-]*!)?(?:[\w;/?:@&=+$.~*'()%\[\]-]|,(?=\S))*").match(code, self.i)
                text = tag.group()
                if self.flow:
                    text = re.match(r"!<[^>]+>|[^,\[\]]*", text).group()
                if code[self.i + len(text)] not in _BLANK and not (self.flow and code[self.i + len(text)] in ",]}"):
                    raise _Stop
                self.i += len(text)
            elif c in "|>" and not self.flow:
                self.may_be_key = True
                self.drop_key()
                self.add("SCALAR")
                self.block_text()
            elif c in "'\"":
                self.note_key()
                self.may_be_key = False
                self.add("SCALAR")
                self.quoted(c)
            elif c not in _BLANK + "-?:,[]{}#&*!|>'\"%@`" or not blank_after and (c == "-" or not self.flow and c in "?:"):
                self.note_key()
                self.may_be_key = False
                self.add("SCALAR")
                self.plain()
            else:
                raise _Stop

    def value(self) -> None:
        depth = len(self.flow)
        if depth in self.keys:
            token, _, _, offset, column = self.keys.pop(depth)
            self.put(token, "KEY", offset)
            if not self.flow and self.opened(column):
                self.put(token, "MAP", offset)
            self.may_be_key = False
        else:
            if not self.flow:
                if not self.may_be_key:
                    raise _Stop
                if self.opened(self.column):
                    self.add("MAP")
            self.may_be_key = not self.flow
            self.drop_key()
        self.add("VALUE")
        self.i += 1

    def block_text(self) -> None:
        code = self.code
        head = re.compile(r"[|>](?:[+-][1-9]?|[1-9][+-]?)?[ ]*(?:#[^\n\r\x85  \0]*)?").match(code, self.i)
        self.i = head.end()
        if code[self.i] not in _BREAKS + "\0":
            raise _Stop
        if code[self.i] != "\0":
            self.next_line()
        least = max(self.indent + 1, 1)
        digit = re.search(r"[1-9]", head.group().split("#")[0])
        own = least + int(digit.group()) - 1 if digit else 0
        while True:
            spaces = 0
            while code[self.i] == " " and (not own or spaces < own):
                self.i += 1
                spaces += 1
            if code[self.i] in _BREAKS:
                self.next_line()
                continue
            if not own:
                own = max(least, spaces)
            if spaces < own or code[self.i] == "\0":
                return
            while code[self.i] not in _BREAKS + "\0":
                self.i += 1
            if code[self.i] == "\0":
                return
            self.next_line()

    def quoted(self, quote: str) -> None:
        code = self.code
        self.i += 1
        while True:
            c = code[self.i]
            if c == "\0":
                raise _Stop
            if c in _BREAKS:
                self.next_line()
                if code.startswith(("---", "..."), self.i) and code[self.i + 3 : self.i + 4] in _BLANK:
                    raise _Stop
            elif c == quote:
                if quote == "'" and code[self.i + 1] == "'":
                    self.i += 2
                    continue
                self.i += 1
                return
            elif c == "\\" and quote == '"':
                escape = re.compile(r"\\(?:[0abtnvfre \t\"/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})").match(code, self.i)
                if escape:
                    self.i = escape.end()
                elif code[self.i + 1] in _BREAKS:
                    self.i += 1
                    self.next_line()
                else:
                    raise _Stop
            else:
                self.i += 1

    def plain(self) -> None:
        code, inner = self.code, self.indent + 1
        stops = ",[]{}"
        while True:
            begin = self.i
            while True:
                c = code[self.i]
                if c in _BLANK:
                    break
                if c == ":" and (code[self.i + 1] in _BLANK or self.flow and code[self.i + 1] in ",[]{}"):
                    break
                if self.flow and c in stops:
                    break
                self.i += 1
            if self.i == begin:
                return
            self.may_be_key = False
            end, line, line_at = self.i, self.line, self.line_at
            while code[self.i] in " \t" and code[self.i] != "\0":
                self.i += 1
            broken = False
            while code[self.i] in _BREAKS:
                broken = True
                self.next_line()
                self.may_be_key = True
                if code.startswith(("---", "..."), self.i) and code[self.i + 3 : self.i + 4] in _BLANK:
                    return
                while code[self.i] == " ":
                    self.i += 1
            if code[self.i] in "#\0" or not broken and self.i == end or broken and not self.flow and self.column < inner:
                if not broken:
                    self.i, self.line, self.line_at = end, line, line_at
                return


def yaml_tokens(code: str, cache: dict) -> tuple[list[str], list[int]]:
    scan = _Yaml(code)
    try:
        scan.run()
    except _Stop:
        scan.add("BAD")
    return scan.kinds, scan.at

"""Tokens of Java 17, with what one token can't tell decided by a look at its surroundings."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?:[\s\x1a]++|//[^\n\r]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+"""
    r'''((?:[^\W\d]|\$)[\w$]*+(?<!\bnon)|non-sealed\b|non\b|[.;,()\[\]{}@?~](?!\.\.|\d)|"""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""|"(?:[^"\\\n\r]|\\[^\n\r])*+"'''
    r"""|'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"""
    r"""|(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?"""
    r"""|>>>=|<<=|>>=|>>>|>>|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|<<|/\*|[\s\S]|\Z)"""
)
_MODIFIERS = "public protected private abstract static final transient volatile strictfp native non-sealed".split()
_PRIMITIVES = "boolean byte short int long char float double".split()
_KEYWORDS = (
    "package import class interface enum extends implements throws void new this super if else while do for return break"
    " continue throw assert try catch finally switch case instanceof default synchronized"
).split()
_CLASS = {w: "MOD" for w in _MODIFIERS} | {w: "PRIM" for w in _PRIMITIVES} | {w: w for w in _KEYWORDS}
_CLASS |= dict.fromkeys(("true", "false", "null"), "LIT") | dict.fromkeys(("goto", "const", "_"), "BAD")
#: Words that are names unless their surroundings say otherwise.
_CLASS |= {w: w for w in ("record", "yield", "permits", "sealed")}
_CLASS |= {c: c for c in ("(", ")", "{", "}", "[", "]", ";", ",", ".", "...", "@", "::", "->", "?", ":", "=", "*", "&", "|", "<", ">", ">>", ">>>")}
_CLASS |= {"++": "INCDEC", "--": "INCDEC", "+": "PM", "-": "PM", "!": "NOT", "~": "NOT"}
_CLASS |= dict.fromkeys(("&&", "||", "==", "!=", "<=", ">=", "<<", "/", "%", "^"), "BIN")
_CLASS |= dict.fromkeys(("+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=", ">>=", ">>>="), "ASSIGN")
_IN_BRACKETS = {"ID", ".", ",", "?", "extends", "super", "&", "PRIM", "[", "]", "@", "<", ">", ">>", ">>>", "DIM", ""}
_AFTER_BRACKETS = {
    "ID", "(", ")", "]", "}", ".", ",", ";", "{", "::", "...", "[", "@", "extends", "implements", ":", "=", "?", ">", "&",
    "this", "super", "throws", "PRIM", "void", "BIN",
}
_OPERAND = {"ID", "LIT", "(", "NOT", "this", "super", "new", "switch", "PRIM", "void"}
_NO_CAST_AFTER = {"ID", ")", "]", "this", "super", "if", "while", "for", "switch", "synchronized", "catch", "try", "LIT", "DIM", "TGT", "TGT2", "TGT3"}
_DECIDE = {")", "<", ">", ">>", ">>>", "[", "@", "(", "case", "default", "synchronized", "record", "yield", "permits", "sealed"}
_AS_NAME = {"record", "yield", "permits", "sealed", "RECORD", "YIELD", "PERMITS"}


_ESCAPE = re.compile(r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})")
_BLOCK_ESCAPE = re.compile(_ESCAPE.pattern + r"|\\\r?\n")
#: Numbers as the lexer takes them that are none: no digits, an octal 8 or 9, a loose underscore, a hexadecimal fraction without exponent.
_NO_NUMBER = re.compile(r"0[xXbB][lL]?|0[xX][^pP]*\.[^pP]*|0_*[0-7_]*[89][\d_]*[lL]?|.*_[lLfFdD]?|0[xXbB]_.*|.*(?:_\.|\._).*")


def _kind(token: str) -> str:
    c = token[0]
    if c in "\"'":
        if len(token) == 1:
            return "BAD"
        known = _BLOCK_ESCAPE if token.startswith('"""') else _ESCAPE
        return "BAD" if "\\" in token and "\\" in known.sub("", token) else "LIT"
    if c.isdigit() or c == "." and len(token) > 1 and token != "...":
        return "BAD" if _NO_NUMBER.fullmatch(token) else "LIT"
    if c == "_" and token != "_" or c == "$" or c.isalpha():
        return _CLASS.get(token, "ID")
    return _CLASS.get(token, "BAD")


def tokens(code: str, cache: dict) -> tuple[list[str], list[int]]:
    """(kinds, numbers of the tokens they begin in), for positions() to tell where those are."""
    words = _TOKEN.findall(code)
    while words and not words[-1]:
        words.pop()
    kinds = list(map(cache.get, words))
    if None in kinds:
        for i, k in enumerate(kinds):
            if k is None:
                word = words[i]
                kinds[i] = k = _kind(word) if word else "BAD"
                if len(word) < 40 and len(cache) < 500_000:
                    cache[word] = k
    number = _decided(kinds)
    if number is None:
        return kinds, range(len(kinds))
    return [kinds[i] for i in number], number


def offset(code: str, number: int) -> int:
    """Where the token with this number begins."""
    for i, m in enumerate(_TOKEN.finditer(code)):
        if i == number:
            return m.start(1)
    return len(code)


def _close(kinds: list[str], places: list[int]) -> dict[int, int]:
    out, stack = {}, []
    for i in places:
        k = kinds[i]
        if k == "(":
            stack.append(i)
        elif k == ")" and stack:
            out[stack.pop()] = i
    return out


def _brackets(kinds: list[str], i: int) -> int:
    """Where type brackets that begin at ``i`` end, or -1 if it is a comparison."""
    depth, n = 0, len(kinds)
    for j in range(i, n):
        k = kinds[j]
        if k not in _IN_BRACKETS:
            return -1
        if k == "<":
            depth += 1
        elif k in (">", ">>", ">>>"):
            depth -= len(k)
            if depth == 0:
                after = kinds[j + 1] if j + 1 < n else ";"
                return j if after in _AFTER_BRACKETS or after in _AS_NAME or i and kinds[i - 1] in (".", "::") else -1
            if depth < 0:
                return -1
    return -1


_OPENERS = {"ID", ".", "::", "MOD", "new", ";", "{", "}", "this", "default", ")"} | _AS_NAME
_BRACKET_KINDS = {"<": "TLT", ">": "TGT", ">>": "TGT2", ">>>": "TGT3"}


def _decided(kinds: list[str]) -> list[int] | None:
    """Settle the kinds in place. Returns which to keep, repeated where a token counts more than once; None: all."""
    n = len(kinds)
    places = [i for i, k in enumerate(kinds) if k in _DECIDE]
    close = _close(kinds, places)
    opened: dict[int, int] | None = None
    changed = False
    for i in places:  # in order: later decisions see earlier ones
        k = kinds[i]
        if k == ")":
            continue
        before = kinds[i - 1] if i else ""
        if k == "(":
            j = close.get(i)
            if j is None or j + 1 >= n:
                continue
            beyond = kinds[j + 1]
            if before == "ID" and beyond != "->":
                continue
            if beyond == "->" and before != "ID" and before != "case":
                kinds[i] = "LLP"
                continue
            if before in _NO_CAST_AFTER:
                if before != ")":
                    continue
                if opened is None:
                    opened = {j: i for i, j in close.items()}
                if kinds[opened.get(i - 1, 0)] != "CLP":
                    continue
            inner = kinds[i + 1 : j]
            if not inner:
                continue
            if inner[0] == "PRIM" and beyond != "->" and all(x in ("PRIM", "[", "]") for x in inner):
                kinds[i] = "CLP"
            elif beyond in _OPERAND or beyond in _AS_NAME:
                if inner[0] in ("ID", "@") and inner[-1] in ("ID", ">", ">>", ">>>", "]") and all(x in _IN_BRACKETS for x in inner):
                    if not any(a == b == "ID" for a, b in zip(inner, inner[1:])):
                        kinds[i] = "CLP"
            continue
        after = kinds[i + 1] if i + 1 < n else ""
        if k == "<":
            end = _brackets(kinds, i) if before in _OPENERS else -1
            if end > 0:
                for j in range(i, end + 1):
                    kinds[j] = _BRACKET_KINDS.get(kinds[j], kinds[j])
                    changed = changed or kinds[j] in ("TGT2", "TGT3")
            else:
                kinds[i] = "BIN"
        elif k in (">", ">>", ">>>"):
            kinds[i] = "BIN"  # what is left are comparisons and shifts
        elif k == "[":
            if after == "]":
                kinds[i], kinds[i + 1], changed = "DIM", "", True
        elif k == "@":
            if after == "interface":
                kinds[i], kinds[i + 1], changed = "ATINTERFACE", "", True
        elif k == "case":
            depth = 0
            for j in range(i + 1, n):
                if kinds[j] in ("(", "{", "[", "LLP", "CLP"):
                    depth += 1
                elif kinds[j] in (")", "}", "]"):
                    depth -= 1
                elif not depth and kinds[j] == "->":
                    kinds[j] = "CARROW"
                    break
                if depth < 0 or not depth and kinds[j] in (":", ";"):
                    break
        elif k == "default":
            if after in (":", "->"):
                kinds[i] = "DEFAULT"
                if after == "->":
                    kinds[i + 1] = "CARROW"
            else:
                kinds[i] = "DEFVAL" if before in (")", "", "DIM") else "MOD"
        elif k == "synchronized":
            kinds[i] = "SYNC" if after == "(" else "MOD"
        elif k == "sealed":
            kinds[i] = "MOD" if after in ("MOD", "class", "interface", "@") else "ID"
        elif k == "record":
            named = (after == "ID" or after in _AS_NAME) and i + 2 < n and kinds[i + 2] in ("(", "<")
            kinds[i] = "RECORD" if named else "ID"
        elif k == "permits":
            kinds[i] = "PERMITS" if after == "ID" and before in ("ID", "TGT", "TGT2", "TGT3") else "ID"
        elif k == "yield":
            goes_on = after in ("ID", "LIT", "NOT", "new", "this", "super", "switch", "(", "PM")
            begins = not i or before in ("{", "}", ";", ")", "else", ":", "->", "CARROW")
            call = after == "(" and kinds[close.get(i + 1, i) + 1 :][:1] == [";"]
            kinds[i] = "YIELD" if goes_on and begins and not call else "ID"
    if not changed:
        return None
    out = []
    for i, k in enumerate(kinds):
        if k == "TGT2" or k == "TGT3":
            out += [i] * int(k[3])
            kinds[i] = "TGT"
        elif k:
            out.append(i)
    return out

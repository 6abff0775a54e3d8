"""Classes, methods and calls of Java texts, by a scanner of braces and declarations."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_HIDE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
_METHOD = re.compile(
    r"(?P<mods>(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^<>{};]*>\s+)?(?P<type>[A-Za-z_][\w.]*(?:<[^{};()]*>)?(?:\[\])*)\s+(?P<name>[A-Za-z_]\w*)\s*\((?P<params>[^(){};]*)\)\s*(?:throws\s+[\w.,\s]+)?\{"
)
_CALL = re.compile(r"(?:\b(?P<on>[A-Za-z_]\w*)\s*\.\s*)?\b(?P<name>[a-z_]\w*)\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "synchronized", "try", "throw", "super", "this", "assert", "do", "case"}
_SCHEMA = "kind string, class_name string, name string, visibility string, result string, params int, start_line int, end_line int, line_count int, on string"


def blanked(code: str) -> str:
    """Comments and literals become blanks of the same length, so braces and places can be trusted."""
    return _HIDE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def closing(text: str, at: int) -> int:
    """Where the brace that opens at ``at`` closes; the end of the text if it doesn't."""
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return at + m.start()
    return len(text)


def split_parameters(params: str) -> list[str]:
    """Parameters apart at commas outside of type brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(params):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(params[last:i])
            last = i + 1
    return [p.strip() for p in [*out, params[last:]] if p.strip()]


def facts(code: str) -> list[tuple]:
    text = blanked(code)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda i: bisect_left(ends, i) + 1
    types = []
    for m in _TYPE.finditer(text):
        opens = text.find("{", m.end())
        if opens >= 0:
            types.append((m.start(), closing(text, opens), m.group(2), m.group(1)))
    out = [(kind, name, name, None, None, 0, line(a), line(b), line(b) - line(a) + 1, None) for a, b, name, kind in types]
    owner = lambda i: next((n for a, b, n, _ in reversed(types) if a <= i <= b), None)
    spans = []
    for m in _METHOD.finditer(text):
        if m["name"] in _WORDS or m["type"] in _WORDS:
            continue
        end = closing(text, m.end() - 1)
        spans.append((m.start(), end, m["name"]))
        shown = re.search(r"public|protected|private", m["mods"])
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        out.append(("method", owner(begin), m["name"], shown.group() if shown else "package", m["type"], len(split_parameters(m["params"])), line(begin), line(end), line(end) - line(begin) + 1, None))
    heads = {m.start("name") for m in _METHOD.finditer(text)}
    # Calls come in order of their place, so the methods around one are a stack: those that have begun and not ended.
    spans.sort()
    around, next_span = [], 0
    for m in _CALL.finditer(text):
        if m["name"] not in _WORDS and m.start("name") not in heads:
            at = m.start()
            while next_span < len(spans) and spans[next_span][0] <= at:
                around.append(spans[next_span])
                next_span += 1
            while around and around[-1][1] < at:
                around.pop()
            caller = around[-1][2] if around else None
            out.append(("call", owner(m.start()), m["name"], None, caller, 0, line(m.start()), line(m.start()), 1, m["on"]))
    return out


def java_facts(df: DataFrame, id_column: str, code: str) -> DataFrame:
    """(id, kind, ...): a row for each type, method and call. For calls ``result`` is the method that calls.

    Null and empty texts give no rows. Texts that do not parse give what can be made out.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_column, *(x.split()[0] for x in _SCHEMA.split(", "))]
        for frame in frames:
            rows = [(i, *fact) for i, text in zip(frame[id_column], frame[code]) if text for fact in facts(text)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(id_column, code).mapInPandas(scan, f"{id_column} {kind}, {_SCHEMA}")

"""LALR(1) tables from bundled grammars, and a recogniser that runs them.

A grammar is text: ``name : alternative | alternative`` until the next such head, words quoted or in capitals are
terminals, and groups may be followed by ``?``, ``*`` or ``+``. Options are multiplied out and repetitions become left
recursion, so no rule is empty but the start. Where tables leave a choice, shifting wins, then the earlier rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

END = "$end"


def _alternatives(words: list[str], at: int, rules: list, fresh: dict) -> tuple[list[tuple[str, ...]], int]:
    """All expansions of a group that begins at ``at``, and where it ends."""
    out: list[tuple[str, ...]] = []
    parts: list[list[tuple[str, ...]]] = []
    while True:
        word = words[at] if at < len(words) else ")"
        if word in ("|", ")"):
            out += [sum(x, ()) for x in product(*parts)]
            parts = []
            if word == ")":
                return list(dict.fromkeys(out)), at + 1
            at += 1
            continue
        if word == "(":
            item, at = _alternatives(words, at + 1, rules, fresh)
        else:
            item, at = [(word,)], at + 1
        mark = words[at] if at < len(words) else ""
        if mark in ("?", "*", "+"):
            at += 1
            if mark != "?":
                key = tuple(item)
                if key not in fresh:
                    fresh[key] = f"many{len(fresh)}"
                    for x in item:
                        rules.append((fresh[key], x))
                        rules.append((fresh[key], (fresh[key], *x)))
                item = [(fresh[key],)]
            if mark != "+":
                item = [(), *item]
        parts.append(item)


def read_grammar(text: str) -> list[tuple[str, tuple[str, ...]]]:
    text = re.sub(r"(?m)^#.*$", "", text)
    words = re.findall(r"'[^']+'|[A-Za-z_]\w*(?=\s*:)\s*:|[A-Za-z_]\w*|[()|?*+]", text)
    heads = [i for i, w in enumerate(words) if w.endswith(":") and w[0] != "'"]
    rules: list[tuple[str, tuple[str, ...]]] = []
    fresh: dict = {}
    for i, j in zip(heads, [*heads[1:], len(words)]):
        name = words[i].rstrip(":").strip()
        body = [w.strip("'") if w[0] == "'" else w for w in words[i + 1 : j]]
        quoted = [w[0] == "'" for w in words[i + 1 : j]]
        body = [f"\0{w}" if q else w for w, q in zip(body, quoted)]
        for x in _alternatives(body, 0, rules, fresh)[0]:
            rules.append((name, x))
    strip = lambda w: w.lstrip("\0")
    start = words[heads[0]].rstrip(":").strip()
    rules = list(dict.fromkeys((n, tuple(map(strip, x))) for n, x in rules if (strip(n),) != tuple(map(strip, x))))
    return [("$start", (start, END)), *rules]


@dataclass
class Tables:
    terminals: dict[str, int]
    action: list[dict[int, int]]  # >= 0: shift to that state; < 0: reduce by rule -x - 1; accepting: shift END
    goto: list[dict[int, int]]
    rules: list[tuple[int, int]]  # (what it makes, length)
    accept: int
    conflicts: list[str] = field(default_factory=list)


def build(text: str) -> Tables:
    """Tables by DeRemer and Pennello's lookahead relations over the LR(0) automaton."""
    rules = read_grammar(text)
    made = {n for n, _ in rules}
    by: dict[str, list[int]] = {}
    for i, (n, _) in enumerate(rules):
        by.setdefault(n, []).append(i)
    nullable: set[str] = set()
    while True:
        more = {n for n, x in rules if n not in nullable and all(s in nullable for s in x)}
        if not more:
            break
        nullable |= more

    def closure(kernel):
        items, todo = set(kernel), list(kernel)
        while todo:
            r, d = todo.pop()
            x = rules[r][1]
            if d < len(x) and x[d] in made:
                for q in by[x[d]]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        return items

    states, number, moves = [frozenset({(0, 0)})], {frozenset({(0, 0)}): 0}, []
    i = 0
    while i < len(states):
        to: dict[str, set] = {}
        for r, d in closure(states[i]):
            x = rules[r][1]
            if d < len(x):
                to.setdefault(x[d], set()).add((r, d + 1))
        moves.append({})
        for s in sorted(to):
            k = frozenset(to[s])
            if k not in number:
                number[k] = len(states)
                states.append(k)
            moves[i][s] = number[k]
        i += 1
    # Lookaheads over the transitions by what rules make.
    trans = [(p, s) for p in range(len(states)) for s in moves[p] if s in made]
    index = {t: i for i, t in enumerate(trans)}
    direct = [{s for s in moves[moves[p][n]] if s not in made} for p, n in trans]
    reads = [[index[(moves[p][n], s)] for s in moves[moves[p][n]] if s in nullable and s in made] for p, n in trans]
    includes: list[list[int]] = [[] for _ in trans]
    lookback: dict[tuple[int, int], list[int]] = {}
    for t, (p, n) in enumerate(trans):
        for r in by[n]:
            q, x = p, rules[r][1]
            for d, s in enumerate(x):
                if s in made and all(y in nullable for y in x[d + 1 :]):
                    includes[index[(q, s)]].append(t)
                q = moves[q][s]
            lookback.setdefault((q, r), []).append(t)

    def spread(sets: list[set], relation: list[list[int]]) -> list[set]:
        sets = [set(s) for s in sets]
        back: list[list[int]] = [[] for _ in sets]
        for a, bs in enumerate(relation):
            for b in bs:
                back[b].append(a)
        todo = list(range(len(sets)))
        while todo:
            b = todo.pop()
            for a in back[b]:
                if not sets[b] <= sets[a]:
                    sets[a] |= sets[b]
                    todo.append(a)
        return sets

    follow = spread(spread(direct, reads), includes)
    terminals = {s: i for i, s in enumerate(sorted({s for _, x in rules for s in x} - made))}
    numbers = {n: i for i, n in enumerate(sorted(made))}
    conflicts, action, goto = [], [], []
    for p in range(len(states)):
        act = {terminals[s]: q for s, q in moves[p].items() if s not in made}
        for r, d in sorted(closure(states[p])):
            if d == len(rules[r][1]) and r:
                for s in set().union(*(follow[t] for t in lookback.get((p, r), []))):
                    if (old := act.get(terminals[s])) is None:
                        act[terminals[s]] = -r - 1
                    else:
                        kind = f"shift {old}" if old >= 0 else f"rule {rules[-old - 1]}"
                        conflicts.append(f"state {p} at {s}: {kind} before {rules[r]}")
        action.append(act)
        goto.append({numbers[s]: q for s, q in moves[p].items() if s in made})
    accept = next(q for p in range(len(states)) for s, q in moves[p].items() if s == END and (0, 2) in states[q])
    return Tables(terminals, action, goto, [(numbers[n], len(x)) for n, x in rules], accept, conflicts)


class Recogniser:
    """Runs tables over streams of terminal numbers.

    What a stretch of terminals does to the stack depends on no more than the states it pops. Stretches that pop at
    most one state below where they began are remembered with the two topmost states, so texts made of the same kinds
    of statements are not parsed twice.
    """

    def __init__(self, tables: Tables, ends: tuple[str, ...] = (), remember: int = 200_000):
        self.t = tables
        self.end = tables.terminals[END]
        stops = bytes(tables.terminals[x] for x in ends if x in tables.terminals)
        self.stretch = re.compile(b"[^" + re.escape(stops) + b"]*(?:[" + re.escape(stops) + b"]|$)") if stops else None
        self.known: dict = {}
        self.remember = remember

    def first_error(self, kinds: bytes) -> int | None:
        """Where the first terminal stands that no text could go on with (the length: at the end); None: it parses."""
        action, goto, rules, end = self.t.action, self.t.goto, self.t.rules, self.end
        kinds += bytes([end])
        stack, i, known = [0], 0, self.known
        while True:
            if self.stretch is None:
                stop = len(kinds)
            else:
                stop = min(self.stretch.match(kinds, i).end(), len(kinds) - 1)
                if stop <= i:
                    stop = i + 1
            key = (stack[-1], stack[-2] if len(stack) > 1 else -1, kinds[i : stop + 1])
            if (hit := known.get(key)) is not None:
                del stack[-1:]
                stack += hit
                i = stop
                continue
            base = len(stack) - 1
            low = base
            # Shift to the stop, then reduce as far as the next terminal says.
            while True:
                act = action[stack[-1]].get(kinds[i])
                if act is None:
                    return i
                if act >= 0:
                    if i >= stop:
                        break
                    if kinds[i] == end:
                        return None
                    stack.append(act)
                    i += 1
                    if i >= len(kinds):
                        return None
                else:
                    made, n = rules[-act - 1]
                    if n:
                        del stack[-n:]
                    if len(stack) < low:
                        low = len(stack)
                    stack.append(goto[stack[-1]][made])
            if low >= base and len(known) < self.remember:
                known[key] = tuple(stack[base:])

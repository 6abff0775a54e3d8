"""A linear-chain conditional random field over the lexical tokens of a line, with labels outside, begin and inside.

Every token is scored by features of its own shape and of its surroundings, hashed into one table of weights, plus
scores for the step from label to label. Training climbs the log-likelihood, computed by the forward-backward recursion
over padded batches; use takes the best labelling by the Viterbi recursion.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain
from operator import ne
from string import ascii_lowercase, ascii_uppercase, digits
from zlib import crc32

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
BITS = 16
TOKEN = re.compile(r"[^\W_](?:[\w$-]*[\w$])?|-{3,}|[\w$-]|[^\s\w]", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEAD = re.compile(r"[A-Za-z]+[-_](?:[a-z]{2,5}_)?")
#: Steps that no labelling takes: nothing is inside that hasn't begun.
_NEVER = -1e4


_CLASSES = str.maketrans(ascii_lowercase + ascii_uppercase + digits + "_$-", "a" * 26 + "A" * 26 + "0" * 10 + "---")


def shape(token: str) -> str:
    """What a token looks like: its classes of characters, how they alternate, and how long it is."""
    c = token[0]
    if not (c.isalnum() or c == "_"):
        return c if len(token) == 1 else c * 2
    n = len(token)
    size = "1" if n < 3 else "3" if n < 6 else "6" if n < 9 else "9" if n < 13 else "d" if n < 20 else "k" if n < 30 else "u"
    if token.isdigit():
        return "0" + size
    if token[:2] == "0x":
        return "0x" + size
    classes = token.translate(_CLASSES)
    lower, upper, digit = "a" in classes, "A" in classes, "0" in classes
    turns = 1 + sum(map(ne, classes, classes[1:]))
    few = len(set(token.lower())) <= max(2, n // 6)
    if few and n > 3:
        return "same" + size
    hexed = n >= 16 and not set(token) - set("0123456789abcdef-")
    if hexed:
        return ("uuid" if token.count("-") == 4 else "hex") + size
    kinds = ("a" if lower else "") + ("A" if upper else "") + ("0" if digit else "") + ("-" if "-" in token or "_" in token else "")
    rate = "r" if digit and turns * 3 > n else "s" if digit and turns * 6 > n else "p"
    return kinds + rate + size


@lru_cache(maxsize=100_000)
def name_parts(name: str) -> tuple[str, ...]:
    return tuple([p.lower() for p in _PARTS.findall(name)][:6]) or (name[:8],)


@lru_cache(maxsize=100_000)
def _speaks_of(name: str) -> tuple[tuple[str, ...], str]:
    """(parts, kinds of what they speak of)"""
    parts = name_parts(name) if name else ("-",)
    return parts, "".join(sorted({_OF[p] for p in parts if p in _OF}))


def _id(text: str) -> int:
    return crc32(text.encode()) & ((1 << BITS) - 1)


def own_features(token: str, quoted: bool, s: str = "") -> list[int]:
    s, low = s or shape(token), token.lower()
    out = ["s" + s, f"sq{s}{quoted}", "w" + low[:24]]
    if len(token) > 5:
        head = _HEAD.match(token)
        out += ["h" + (head.group() if head else "-"), f"hs{bool(head)}{s}", f"d{len(set(token)) // 4}", f"l{min(len(token), 70) // 4}"]
        letters, vowels = sum(map(str.isalpha, low)), sum(map(low.count, "aeiou"))
        out += [f"v{10 * vowels // max(1, letters) // 2}{s[0]}", "b" + low[:3], "e" + low[-3:]]
        out += ["p" + p for p in name_parts(token)[:4]]
    return [_id(x) for x in out]


def context_features(side: str, near: str, far: str, s: str) -> list[int]:
    return [_id(f"{side}1{near}|{s}"), _id(f"{side}1{near}"), _id(f"{side}2{near}|{far}"), _id(f"{side}2{near}|{far}|{s}")]


# Parts of names by what they speak of.
_SPEAKS = {
    "pw": "password passwd pwd pass pw kennwort passwort contrasena motdepasse passphrase pin mima pgpassword",
    "sec": "secret token key apikey auth authorization bearer credential credentials signing private access hmac aes jwt webhook",
    "url": "url dsn uri datasource connection broker endpoint jdbc database webhook",
    "sum": "checksum digest sha sha256 md5 hash etag commit revision fingerprint id uuid run trace request build",
    "ref": "env getenv environ vault secretname file path field policy count budget max min limit verify public header icon image",
}
_OF = {w: k for k, ws in _SPEAKS.items() for w in ws.split()}


def name_features(which: str, name: str, s: str) -> list[int]:
    parts, of = _speaks_of(name)
    out = [_id(f"{which}{p}|{s}") for p in parts] + [_id(f"{which}{p}") for p in parts]
    return out + [_id(f"{which}={of}"), _id(f"{which}={of}|{s}"), _id(f"{which}={of}|{s[:-1]}")]


_CURLY = dict.fromkeys("“”„«»", '"') | dict.fromkeys("‘’‚", "'")
_ESCAPED = {'"', "'", "\\"}
_NAMING = set("=:,(>?&;")
_IN_URL = re.compile(r"://[^\s/:@\"']*:([^\s\"'/]+)@")


#: What the tokens leave out.
_BLANK = " \t\n\r\f\v"


class Line:
    """The tokens of one line (or of lines that go on), with what governs each: the names before it, and quotes."""

    __slots__ = ("tokens", "at", "names", "quoted")

    def __init__(self, text: str, field: str = ""):
        self.tokens, self.at, self.names, self.quoted = [], [], [], []
        first, second, word, quote, said, escaped = field, "", field, "", "", False
        login = _IN_URL.search(text) if "://" in text else None
        low, high = login.span(1) if login else (0, 0)
        for m in TOKEN.finditer(text):
            t = m.group()
            if t in _CURLY:
                t = _CURLY[t]
            self.tokens.append(t)
            self.at.append((m.start(), m.end()))
            self.names.append((first, second) if not low <= m.start() < high else ("urlPassword", first))
            self.quoted.append(bool(quote))
            if escaped:
                escaped = False
                if t in _ESCAPED:
                    continue
            if t == "\\":
                escaped = True
            elif t in ('"', "'"):
                quote = "" if quote == t else quote or t
            elif t in _NAMING:
                if word:
                    if word.lower() == "value" and said:
                        word = said  # name="x" value="y": the name is what was quoted before
                    if word != first:
                        first, second = word, first
                    word = ""
            elif t[0].isalpha() or t[0] == "_":
                word = t
                said = t if quote else said

    def key(self, i: int) -> str:
        """A token as its neighbours see it: by its word if it is short, else by its shape."""
        if not 0 <= i < len(self.tokens):
            return "^"
        t = self.tokens[i]
        return t.lower() if len(t) < 9 and not any(c.isdigit() for c in t) else shape(t)

    def features(self) -> list[list[int]]:
        keys = [self.key(i) for i in range(-2, len(self.tokens) + 2)]
        out = []
        for i, t in enumerate(self.tokens):
            s = shape(t)
            out.append(
                own_features(t, self.quoted[i])
                + context_features("<", keys[i + 1], keys[i], s)
                + context_features(">", keys[i + 3], keys[i + 4], s)
                + name_features("n", self.names[i][0], s)
                + name_features("m", self.names[i][1], s)
            )
        return out


def train(lines: list[tuple[Line, list[int]]], epochs: int = 9, batch: int = 128, rate: float = 0.08, seed: int = 7, decay: float = 1e-5):
    """(weights by feature and label, steps): by Adagrad over shuffled batches."""
    weights, steps = np.zeros(((1 << BITS) + 1, 3)), np.zeros((4, 3))
    never = np.zeros((4, 3))
    never[OUT, INSIDE] = never[3, INSIDE] = _NEVER
    gw, gs = np.full(weights.shape, 1e-2), np.full(steps.shape, 1e-2)
    pad = 1 << BITS
    made = []
    for line, labels in lines:
        f = line.features()
        wide = max(map(len, f))
        ids = np.full((len(f), wide), pad)
        for i, x in enumerate(f):
            ids[i, : len(x)] = x
        made.append((ids, np.array(labels)))
    rng = np.random.default_rng(seed)
    width = max(x.shape[1] for x, _ in made)
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        order = order[np.argsort([len(made[i][1]) // 4 + rng.random() for i in order], kind="stable")]
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        for chunk in (chunks[i] for i in rng.permutation(len(chunks))):
            n = max(len(made[i][1]) for i in chunk)
            ids = np.full((len(chunk), n, width), pad)
            gold, size = np.zeros((len(chunk), n), int), np.array([len(made[i][1]) for i in chunk])
            for b, i in enumerate(chunk):
                x, y = made[i]
                ids[b, : len(x), : x.shape[1]] = x
                gold[b, : len(y)] = y
            e = weights[ids].sum(2)
            step = steps + never
            live = np.arange(n)[None] < size[:, None]
            alpha = np.zeros((len(chunk), n, 3))
            alpha[:, 0] = e[:, 0] + step[3]
            for t in range(1, n):
                a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step[:3], axis=1) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            beta = np.zeros_like(alpha)
            pairs = np.zeros((4, 3))
            for t in range(n - 1, 0, -1):
                b = np.logaddexp.reduce(step[:3] + (e[:, t] + beta[:, t])[:, None], axis=2)
                beta[:, t - 1] = np.where(live[:, t, None], b, beta[:, t])
                p = alpha[:, t - 1, :, None] + step[:3] + (e[:, t] + beta[:, t])[:, None] - z[:, None, None]
                pairs[:3] += (np.exp(p) * live[:, t, None, None]).sum(0)
            marginal = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
            pairs[3] += marginal[:, 0].sum(0)
            np.subtract.at(pairs, (3, gold[:, 0]), 1)
            at = np.nonzero(live[:, 1:])
            np.subtract.at(pairs, (gold[:, :-1][at], gold[:, 1:][at]), 1)
            marginal[np.nonzero(live) + (gold[live],)] -= 1
            flat = np.repeat(marginal[live], width, axis=0)
            where = ids[live].ravel()
            keys, inverse = np.unique(where, return_inverse=True)
            g = np.stack([np.bincount(inverse, flat[:, k], len(keys)) for k in range(3)], 1)
            g += decay * len(chunk) * weights[keys]
            gw[keys] += g * g
            weights[keys] -= rate * g / np.sqrt(gw[keys])
            gs += pairs * pairs
            steps -= rate * pairs / np.sqrt(gs)
            weights[pad] = 0
    return weights.astype(np.float32), (steps + never).astype(np.float32)


class Labeller:
    """Viterbi with remembered scores: what a feature group adds depends on few values that come again and again.

    Scores are those of begin and inside less that of outside, which leaves the best labelling the same.
    """

    def __init__(self, weights: np.ndarray, steps: np.ndarray, remember: int = 200_000):
        self.w, self.steps = weights.astype(float), steps.astype(float).tolist()
        self.over = self.w[:, 1:] - self.w[:, :1]
        self.caches: list[dict] = [{}, {}, {}, {}]
        self.parts: dict[tuple[str, str, str], tuple[float, float]] = {}
        self.shapes: dict[str, tuple] = {}
        self.lines: dict[str, dict[str, list[tuple[int, int]]]] = {}
        self.remember = remember
        self.batches: Batches | None = None
        (oo, ob, _), (bo, bb, bi), (io, ib, ii), (so, sb, _) = self.steps
        # A stretch of k tokens gains at most k times (its best score + this) over outside: if no token reaches that, none is labelled.
        self.hopeless = -max(max(ob - oo, sb - so) + max(bo - oo, io - oo, 0), max(bb, bi, ib, ii) - oo)

    def _made(self, cache: dict, key, ids: list[int]) -> tuple[float, float]:
        if len(cache) > self.remember:
            cache.clear()
        hit = cache[key] = tuple(self.over[ids].sum(0).tolist())
        return hit

    def _seen(self, token: str) -> tuple:
        """(shape, key, scores outside of quotes, scores in quotes)"""
        if len(self.shapes) > self.remember:
            self.shapes.clear()
        s = shape(token)
        key = token.lower() if len(token) < 9 and not any(c.isdigit() for c in token) else s
        b, i = self.over[own_features(token, False, s)].sum(0).tolist()
        k = ("q", s, "")
        x, y = self.parts.get(k) or self._made(self.parts, k, [_id(f"sq{s}True")])
        k = ("q", "", s)
        v, w = self.parts.get(k) or self._made(self.parts, k, [_id(f"sq{s}False")])
        hit = self.shapes[token] = (s, key, (b, i), (b + x - v, i + y - w))
        return hit

    def _named(self, cache: dict, which: str, name: str, s: str) -> tuple[float, float]:
        """The sums of ``name_features``, from those of the parts of the name."""
        if len(cache) > self.remember:
            cache.clear()
        parts, of = _speaks_of(name)
        b = i = 0.0
        for p in parts:
            k = (which, p, s)
            x, y = self.parts.get(k) or self._made(self.parts, k, [_id(f"{which}{p}|{s}"), _id(f"{which}{p}")])
            b, i = b + x, i + y
        k = (which + "=", of, s)
        x, y = self.parts.get(k) or self._made(self.parts, k, [_id(f"{which}={of}"), _id(f"{which}={of}|{s}"), _id(f"{which}={of}|{s[:-1]}")])
        hit = cache[name, s] = (b + x, i + y)
        return hit

    def many(self, lines: list[str], field: str = "") -> list[list[tuple[int, int]]]:
        """``spans`` of each line; those of short ones are remembered, without what is around them."""
        if self.batches is None:
            self.batches = Batches(self)
        known = self.lines.setdefault(field, {})
        if len(known) > self.remember:
            known.clear()
        bare = [x.strip(_BLANK) for x in lines]
        new = list(dict.fromkeys([x for x in bare if x not in known]))
        found: dict[str, list[tuple[int, int]]] = dict.fromkeys(new, [])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for u in self.batches.promising(part, field):
                found[part[u]] = self.spans(part[u], field)
        out = []
        for x, line in zip(bare, lines):
            spans = found[x] if x in found else known[x]
            if spans:
                skipped = len(line) - len(line.lstrip(_BLANK))
                spans = [(a + skipped, b + skipped) for a, b in spans]
            out.append(spans)
        for x in new:
            if len(x) <= 300:
                known[x] = found[x]
        return out

    def spans(self, text: str, field: str = "") -> list[tuple[int, int]]:
        """The stretches of ``text`` to redact."""
        line = Line(text, field)
        if not line.tokens:
            return []
        shapes, (before, after, first, second) = self.shapes, self.caches
        seen = [shapes.get(t) or self._seen(t) for t in line.tokens]
        keys = ["^", "^", *[x[1] for x in seen], "^", "^"]
        scores, most = [], self.hopeless
        for t, (x, names, quoted) in enumerate(zip(seen, line.names, line.quoted)):
            s = x[0]
            own = x[3] if quoted else x[2]
            k = (keys[t + 1], keys[t], s)
            l = before.get(k) or self._made(before, k, context_features("<", *k))
            k = (keys[t + 3], keys[t + 4], s)
            r = after.get(k) or self._made(after, k, context_features(">", *k))
            f = first.get((names[0], s)) or self._named(first, "n", names[0], s)
            g = second.get((names[1], s)) or self._named(second, "m", names[1], s)
            b, i = own[0] + l[0] + r[0] + f[0] + g[0], own[1] + l[1] + r[1] + f[1] + g[1]
            scores.append((b, i))
            if b > most:
                most = b
            if i > most:
                most = i
        return self._best(line, scores) if most > self.hopeless else []

    def _best(self, line: Line, scores: list[tuple[float, float]]) -> list[tuple[int, int]]:
        (oo, ob, _), (bo, bb, bi), (io, ib, ii), (so, sb, _) = self.steps
        back = []
        o, b, i = so, sb + scores[0][0], _NEVER
        for eb, ei in scores[1:]:
            to_o = max((o + oo, 0), (b + bo, 1), (i + io, 2))
            to_b = max((o + ob, 0), (b + bb, 1), (i + ib, 2))
            to_i = max((b + bi, 1), (i + ii, 2))
            back.append((to_o[1], to_b[1], to_i[1]))
            o, b, i = to_o[0], to_b[0] + eb, to_i[0] + ei
        label = max((o, 0), (b, 1), (i, 2))[1]
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        labels.reverse()
        out: list[tuple[int, int]] = []
        for t, y in enumerate(labels):
            if y == BEGIN:
                out.append(line.at[t])
            elif y == INSIDE:
                out[-1] = (out[-1][0], line.at[t][1])
        return out


# Kinds of tokens for what governs others.
_OTHER, _WORD, _ASSIGNS, _DOUBLE, _SINGLE, _SLASH = range(6)
_KEYS, _SHAPES = 1 << 22, 1 << 12
#: Lines with more tokens are labelled one by one.
_WIDE = 600


class _Numbers(dict):
    """Numbers of strings; a new one gets the next."""

    def __init__(self, add=None):
        super().__init__()
        self.add = add

    def __missing__(self, x: str) -> int:
        n = self[x] = len(self)
        if self.add:
            self.add(x)
        return n


class _Made(dict):
    """Scores by code; missing ones are made when asked for."""

    make = None

    def __missing__(self, code: int) -> tuple[float, float]:
        hit = self[code] = self.make(code)
        return hit


class Batches:
    """Which lines have a credential at all, for many lines at once: the best score of any labelling against that of outside only.

    The same scores as in ``Labeller``, gathered for arrays of tokens; no line is left out.
    """

    def __init__(self, labeller: Labeller):
        self.l = labeller
        self._empty()

    def _empty(self) -> None:
        self.shapes, self.keys = _Numbers(), _Numbers()
        self.rows: list[tuple] = []
        self.made = [_Made() for _ in range(4)]
        self.known = _Numbers(self._add)
        self.known["^"]  # 0 stands around each line
        self.known[""]
        self._flat = (0,)

    def _add(self, token: str) -> None:
        t = _CURLY.get(token, token)
        if not t:
            self.rows.append((0, 0, _OTHER, 0, 0.0, 0.0, 0.0, 0.0))
            return
        s, key, (b, i), (x, y) = self.l.shapes.get(t) or self.l._seen(t)
        kind = (
            _SLASH if t == "\\" else _DOUBLE if t == '"' else _SINGLE if t == "'" else _ASSIGNS if t in _NAMING else _WORD if t[0].isalpha() or t[0] == "_" else _OTHER
        )
        self.rows.append((self.shapes[s], self.keys["^" if not self.rows else key], kind, t.lower() == "value", b, i, x, y))

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(shape, key, kind, whether "value"; scores out of quotes and in quotes) by number of token."""
        if self._flat[0] != len(self.rows):
            new = np.array(self.rows[self._flat[0] :])
            parts = new[:, :4].astype(np.int32).T, new[:, 4:]
            if self._flat[0]:
                parts = np.concatenate([self._flat[1], parts[0]], 1), np.concatenate([self._flat[2], parts[1]])
            self._flat = (len(self.rows), *parts)
        return self._flat[1:]

    def _scores(self, which: int, codes: np.ndarray, made) -> np.ndarray:
        """(begin, inside) for each code; ``made`` gives those of one code."""
        cache = self.made[which]
        cache.make = made
        kinds, at = np.unique(codes, return_inverse=True)
        pairs = np.fromiter(chain.from_iterable(map(cache.__getitem__, kinds.tolist())), float, 2 * len(kinds))
        return pairs.reshape(-1, 2)[at]

    def promising(self, lines: list[str], field: str = "") -> list[int]:
        """The numbers of the lines whose best labelling is not outside only."""
        if len(self.rows) > self.l.remember or max(map(len, self.made)) > 4 * self.l.remember:
            self._empty()
        known = self.known
        lists = [list(map(known.__getitem__, TOKEN.findall(x))) for x in lines]
        wide = [u for u, x in enumerate(lists) if len(x) > _WIDE]
        units = [u for u, x in enumerate(lists) if 0 < len(x) <= _WIDE]
        if not units:
            return wide
        units.sort(key=lambda u: -len(lists[u]))
        sizes = np.array([len(lists[u]) for u in units])
        named, none = known[field], known[""]
        # Lines side by side, with two marks around each.
        start = np.cumsum(sizes) - sizes + 2 * np.arange(1, len(units) + 1)
        tokens = np.zeros(int(sizes.sum()) + 2 * len(units) + 2, np.int64)
        of = np.repeat(np.arange(len(units)), sizes)
        at = np.arange(len(of)) + 2 * (of + 1)
        tokens[at] = np.fromiter(chain.from_iterable([lists[u] for u in units]), np.int64, len(of))
        hard = [k for k, u in enumerate(units) if "\\" in lines[u] or ("://" in lines[u]) or (_quotes(lines[u]))]
        states = [Line(lines[units[k]], field) for k in hard]
        pairs = [[(known[a], known[b]) for a, b in x.names] for x in states]
        (shape, key, kind, value), table = self._arrays()
        kinds = kind[tokens]
        # In quotes: an odd number of them before, in the line.
        marks = np.cumsum((kinds == _DOUBLE) | (kinds == _SINGLE))
        quoted = ((marks[at - 1] - marks[start - 1][of]) & 1).astype(bool)
        first, second = self._governing(tokens, kinds, value, quoted, at, of, start, named, none)
        for k, x, p in zip(hard, states, pairs):
            a, n = start[k] - 2 * (k + 1), sizes[k]
            quoted[a : a + n] = x.quoted
            first[a : a + n], second[a : a + n] = [f for f, _ in p], [s for _, s in p]
        s, ks = shape[tokens[at]].astype(np.int64), key[tokens].astype(np.int64)
        key_names, shape_names, names = list(self.keys), list(self.shapes), list(known)

        l = self.l

        def near(cache: dict, side: str):
            def of_code(c: int) -> tuple[float, float]:
                k = key_names[c // (_KEYS * _SHAPES)], key_names[c // _SHAPES % _KEYS], shape_names[c % _SHAPES]
                return l._made(cache, k, context_features(side, *k))

            return of_code

        def name(cache: dict, which: str):
            return lambda c: l._named(cache, which, names[c // _SHAPES], shape_names[c % _SHAPES])

        score = table.reshape(-1, 2)[2 * tokens[at] + quoted]
        score = score + self._scores(0, (ks[at - 1] * _KEYS + ks[at - 2]) * _SHAPES + s, near(l.caches[0], "<"))
        score += self._scores(1, (ks[at + 1] * _KEYS + ks[at + 2]) * _SHAPES + s, near(l.caches[1], ">"))
        score += self._scores(2, first * _SHAPES + s, name(l.caches[2], "n"))
        score += self._scores(3, second * _SHAPES + s, name(l.caches[3], "m"))
        best, outside = self._forward(score, start - 2 * np.arange(1, len(units) + 1), sizes)
        return wide + [units[k] for k in np.flatnonzero(best >= outside - 1e-6)]

    @staticmethod
    def _governing(tokens, kinds, value, quoted, at, of, start, named: int, none: int):
        """The names that govern each token, as ``Line`` has them where there is no escape and one kind of quotes."""
        n = len(tokens)
        place = np.arange(n)
        unit = np.zeros(n, np.int64)
        unit[at] = of
        word = np.maximum.accumulate(np.where(kinds == _WORD, place, -1))
        inside = np.zeros(n, bool)
        inside[at] = quoted
        said = np.maximum.accumulate(np.where((kinds == _WORD) & inside, place, -1))
        assigns = np.flatnonzero(kinds == _ASSIGNS)
        before = np.maximum(np.concatenate([[-1], assigns[:-1]]), start[unit[assigns]] - 1)
        events = assigns[word[assigns] > before]
        names = tokens[word[events]]
        swap = (value[names] > 0) & (said[events] >= start[unit[events]])
        names = np.where(swap, tokens[said[events]], names)
        line = unit[events]
        opens = np.ones(len(events), bool)
        opens[1:] = line[1:] != line[:-1]
        same = np.where(opens, names == named, np.concatenate([[-1], names[:-1]]) == names) if len(events) else opens
        events, names, line = events[~same], names[~same], line[~same]
        e = np.searchsorted(events, at) - 1
        padded, lines = np.concatenate([names, [none]]), np.concatenate([line, [-1]])
        has = (e >= 0) & (lines[e] == of)
        earlier = np.maximum(e - 1, -1)
        two = (e >= 1) & (lines[earlier] == of) & has
        first = np.where(has, padded[e], named)
        second = np.where(two, padded[earlier], np.where(has, named, none))
        return first, second

    def _forward(self, score: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of the best labelling with a begin, of outside only) of each line; lines come the longest first."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii), (so, sb, _) = self.l.steps
        o, b, i = np.full(len(sizes), _NEVER), sb + score[start, 0], np.full(len(sizes), _NEVER)
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        for t in range(1, int(sizes[0])):
            m = live[t]
            eb, ei = score[start[:m] + t].T
            p, q, r = o[:m], b[:m], i[:m]
            to_o = np.maximum(np.maximum(p + oo, q + bo), r + io)
            to_b = np.maximum(np.maximum(np.maximum(p, so + (t - 1) * oo) + ob, q + bb), r + ib) + eb
            to_i = np.maximum(q + bi, r + ii) + ei
            o[:m], b[:m], i[:m] = to_o, to_b, to_i
        return np.maximum(np.maximum(o, b), i), so + (sizes - 1) * oo


def _quotes(line: str) -> bool:
    return any(c in line for c in "\"“”„«»") and any(c in line for c in "'‘’‚")


def marked(text: str) -> tuple[str, str, list[tuple[int, int]]]:
    """(field, text, spans) of a marked example."""
    field, _, text = text.rpartition("\x1f")
    spans, out, begin = [], "", 0
    for part in re.split(r"(\[\[|\]\])", text):
        if part == "[[":
            begin = len(out)
        elif part == "]]":
            spans.append((begin, len(out)))
        else:
            out += part
    return field, out, spans


def labelled(text: str) -> tuple[Line, list[int]] | None:
    field, plain, spans = marked(text)
    line = Line(plain, field)
    labels = [OUT] * len(line.tokens)
    for a, b in spans:
        inside = [i for i, (x, y) in enumerate(line.at) if x >= a and y <= b]
        for k, i in enumerate(inside):
            labels[i] = INSIDE if k else BEGIN
    return (line, labels) if labels else None

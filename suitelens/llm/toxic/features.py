"""What of a sentence is compared: its words, what they speak of, and how that goes together.

A text is read once by one expression; each distinct token is looked at once and then known by number, so that the rest
works on arrays of numbers for a whole batch of texts. Nothing depends on the language a text is said to be in.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np

from suitelens.llm.toxic.examples import labelled
from suitelens.llm.toxic.lexicon import HEADS, NAMES, RUDE, WHOLE, plain_word

BITS = 18
T = len(NAMES)
#: Numbers of terms: words (those of the labelled sentences have their own, all others share the rest by hash), then what
#: they speak of, ordered neighbours (two, three), and sets of two.
TAG, PAIR, TRIPLE, BOTH = 1 << BITS, (1 << BITS) + T, (1 << BITS) + T + T * T, (1 << BITS) + T + T * T + T**3
TERMS = BOTH + T * T
# Letters of other scripts that look like these.
_LOOKS = str.maketrans("аеорсухіјѕԁһӏԛԝкмтвнгАЕОРСУХІЈЅКМТВНαεορυνκιτ", "aeopcyxijsdhlqwkmtbhrAEOPCYXIJSKMTBHaeopuvkit")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile("[ÃâÂ][\x80-¿€™œž“”][^\n]*")
_HAN_ANY = re.compile("[一-鿿]")
_HAN_GAP = re.compile(r"(?<=[一-鿿])[ *_.-](?=[一-鿿])")
_FOREIGN = re.compile("[\u0370-\u04ff\u0500-\u052f]")
#: Signs between words. What may be part of a word in disguise or end a sentence stays.
_SIGNS = bytes(32 if chr(i) in "\"#%&()+,/:;<=>[\\]^`{|}~-" else i for i in range(256))
_WIDE_SIGNS = "“”„«»…，、：（）《》「」【】—–·¿¡"
_LINE, _HAN_END = " \0 ", "。！？；"
_ENDS = re.compile(r"\n|[.!?]+(?=\s|\Z)|[。！？；]")
_PARTS = re.compile(r"[一-鿿]+|(?:(?![一-鿿])[\w$@*'’!])+")
_NAME = re.compile(r"[a-z]+(?:[A-Z][a-z]{2,}\d*)+|(?:[A-Z][a-z]+){2,}\d*|[A-Za-z0-9$]+_\w*[A-Za-z0-9]\w*|\w*\d{2,}\w*")
_NAME_PARTS = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])")
_JOINED = re.compile(r"[^\W_](?:([_*])[^\W_])(?:\1[^\W_])+")
_LEET = (str.maketrans("013457@$!", "oieastasi"), str.maketrans("013457@$!", "oleastasl"))
_DOTTED = re.compile(r"(?:[^\W_]\.){2,}[^\W_]?[!?]*")
_LONG = re.compile(r"(.)\1{2,}")
_STOP, _NONE = 0, 1  # numbers of tokens: the end of a sentence, nothing

# Rude words by first letter, last letter and length, as they look with their middle masked.
_MASKED: dict[tuple[str, str, int], str] = {}
for _w, _tags in [*WHOLE.items(), *HEADS.items()]:
    if _w.isascii() and len(_w) > 3 and RUDE.intersection(_tags):
        _MASKED.setdefault((_w[0], _w[-1], len(_w)), _w)
_HAN = sorted((w for w in WHOLE if "一" <= w[0] <= "鿿"), key=len, reverse=True)
_HAN_MOST = max(map(len, _HAN))


def cleaned(text: str) -> str:
    """Without hidden signs, letters of other scripts, broken encoding, entities and gaps between Chinese signs."""
    if "\0" in text:
        text = text.replace("\0", " ")
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    if _BROKEN.search(text):
        text = _BROKEN.sub(lambda m: _mended(m.group()), text)
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if _FOREIGN.search(text):
        text = text.translate(_LOOKS)
    return _HAN_GAP.sub("", text) if _HAN_ANY.search(text) else text


def gaps(text: str) -> str:
    """As long as ``text``, with signs between words as blanks."""
    if text.isascii():
        return text.encode().translate(_SIGNS).decode()
    for c in _WIDE_SIGNS:
        text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_SIGNS).decode("utf-8", "surrogatepass")


def _mended(part: str) -> str:
    for encoding in ("cp1252", "latin-1"):
        try:
            return part.encode(encoding).decode("utf-8")
        except UnicodeError:
            pass
    # Single signs that were encoded twice.
    return re.sub("[ÃÂ][\x80-¿]", lambda m: m.group().encode("latin-1").decode("utf-8", "ignore"), part)


def tags_of(word: str) -> list[int]:
    """What a plain word speaks of."""
    out = list(WHOLE.get(word, ()))
    for n in range(len(word), 2, -1):
        if (found := HEADS.get(word[:n])) is not None:
            out += [t for t in found if t not in out]
            break
    return out


def _looked_up(word: str) -> tuple[str, list[int]]:
    """The word meant and its tags; disguises are taken off only if a known word comes to light."""
    tags = tags_of(word)
    if tags:
        return word, tags
    tries = []
    if not word.isalpha() and len(word) > 3 and sum(map(str.isalpha, word)) > 1 and not word[-2:].isdigit():
        tries += [word.translate(t) for t in _LEET]
    for w in [word, *tries]:
        if _LONG.search(w):
            tries += [_LONG.sub(r"\1", w), _LONG.sub(r"\1\1", w)]
    for w in tries:
        if w.isalpha() and (tags := tags_of(w)):
            return w, tags
    return word, []


@lru_cache(maxsize=200_000)
def _word(raw: str) -> tuple[list[int], list[int]]:
    """(terms, tags) of one word."""
    word = plain_word(raw)
    if "*" in word:
        bare = word.strip("*")
        if not bare:
            return [], []
        stars = len(word) - len(word.rstrip("*"))
        if "*" in bare:
            meant = _MASKED.get((bare[0], bare[-1], len(bare)), "")
        else:
            meant = next((w for (a, _, n), w in _MASKED.items() if stars > 1 and a == bare[0] and n == len(bare) + stars and w.startswith(bare)), bare)
        word = meant or bare.replace("*", "")
    if not word or word.isdigit():
        return [], []
    word, tags = _looked_up(word)
    terms = [_bucket("w" + word)]
    if len(word) > 5:
        terms.append(_bucket("p" + word[:5]))
    return terms, tags


def _bucket(feature: str) -> int:
    """32 bits; ``_numbered`` makes the number of a term of it."""
    return crc32(feature.encode())


@lru_cache(maxsize=1)
def _own_numbers() -> dict[int, int]:
    """The words of all labelled sentences by number, so that no other word is taken for one of them."""
    tokens = {token for text in labelled()[0] for token in gaps(cleaned(text)).split()}
    return {h: i for i, h in enumerate(sorted({h for token in tokens for h in resolved(token)[0]}))}


def _numbered(hashes: list[int]) -> list[int]:
    own = _own_numbers()
    n = len(own)
    return [own[h] if h in own else n + h % ((1 << BITS) - n) for h in hashes]


def _han(run: str) -> tuple[list[int], list[int]]:
    terms = [_bucket("c" + a) for a in run] + [_bucket("b" + run[i : i + 2]) for i in range(len(run) - 1)]
    tags, i = [], 0
    while i < len(run):
        for n in range(min(_HAN_MOST, len(run) - i), 0, -1):
            if (found := WHOLE.get(run[i : i + n])) is not None:
                tags += found
                i += n - 1
                break
        i += 1
    return terms, tags


_SPOKEN = {NAMES.index(n) for n in ("YOU", "YOUR", "INSULT", "FOUL", "SWEAR", "DIE")}


def resolved(token: str) -> tuple[list[int], list[int]]:
    """(terms, tags in order) of what stands between two gaps of a text."""
    terms, tags = [], []
    if "." in token and _DOTTED.fullmatch(token):
        return _spelled(token.replace(".", ""))
    for part in _PARTS.findall(token):
        a, b = _part(part)
        terms += a
        tags += b
    return terms, tags


def _part(token: str) -> tuple[list[int], list[int]]:
    if "一" <= token[0] <= "鿿":
        return _han(token)
    token = token.replace("’", "'").strip("'_").rstrip("!")
    if not token:
        return [], []
    if _JOINED.fullmatch(token):
        return _spelled(re.sub(r"[_*]", "", token))
    if _NAME.fullmatch(token) and plain_word(token.strip("*")) not in WHOLE:
        # Names of code say nothing, unless they speak to somebody.
        parts = [_word(p) for p in _NAME_PARTS.findall(token)]
        tags = [t for _, ts in parts for t in ts]
        if len(set(tags) & _SPOKEN) > 1:
            return [x for ts, _ in parts for x in ts], tags
        terms, tags = _word(token) if "_" not in token and any(c in "01345$@" for c in token) else ([], [])
        return (terms, tags) if tags else ([], [])
    terms, tags = [], []
    for part in re.split(r"['_]", token):
        if part:
            a, b = _word(part)
            terms += a
            tags += b
    return terms, tags


def _spelled(letters: str) -> tuple[list[int], list[int]]:
    """Letters set apart, of one or more words."""
    terms, tags = _word(letters)
    if not tags and len(letters) > 4:
        low = plain_word(letters)
        inside = [w for w in [*WHOLE, *HEADS] if len(w) > 4 and w in low]
        tags = [t for w in inside for t in (WHOLE.get(w) or HEADS[w])]
    return terms, tags


class _Known(dict):
    """Numbers of tokens; one not seen yet gets its number when asked for."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, token: str) -> int:
        return self.add(token)


class Vocabulary:
    """Distinct tokens by number, with their terms and tags in flat arrays."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.known = _Known(self.add)
        self.terms: list[list[int]] = []
        self.tags: list[list[int]] = []
        self.single: list[bool] = []
        self.stops: list[bool] = []
        self.letters: dict[int, str] = {}
        self._flat_for = -1
        self._put("\0", [], [], stops=True)
        self._put("", [], [])

    def _put(self, token: str, terms: list[int], tags: list[int], stops: bool = False, single: bool = False) -> int:
        i = self.known[token] = len(self.terms)
        self.terms.append(_numbered(terms))
        self.tags.append(tags)
        self.stops.append(stops)
        self.single.append(single)
        if single:
            self.letters[i] = token
        return i

    def add(self, token: str) -> int:
        stops = token[-1] in ".!?。！？；"
        return self._put(token, *resolved(token), stops, len(token) == 1 and token.isalpha() and not "一" <= token <= "鿿")

    def numbers(self, text: str) -> list[int]:
        text = cleaned(text)
        if not text.isascii():
            for end in _HAN_END:
                text = text.replace(end, end + " ")
        out = list(map(self.known.__getitem__, gaps(text).replace("\n", _LINE).split()))
        out.append(_STOP)
        return out

    def flat(self) -> None:
        """Bring the arrays up to date."""
        done = max(self._flat_for, 0)
        if self._flat_for != len(self.terms):
            t_size, t_flat = _ragged(self.terms[done:])
            g_size, g_flat = _ragged(self.tags[done:])
            flags = np.array([self.single[done:], self.stops[done:]])
            if done:
                t_size, t_flat = np.append(self.t_size, t_size), np.append(self.t_flat, t_flat)
                g_size, g_flat = np.append(self.g_size, g_size), np.append(self.g_flat, g_flat)
                flags = np.append([self.lone, self.last], flags, 1)
            self.t_size, self.t_flat, self.g_size, self.g_flat, (self.lone, self.last) = t_size, t_flat, g_size, g_flat, flags
            self.t_at, self.g_at = (np.append(0, np.cumsum(n)) for n in (t_size, g_size))
            self._flat_for = len(self.terms)


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def _expanded(which: np.ndarray, sizes: np.ndarray, at: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, value): all values of the lists that ``which`` names."""
    n = sizes[which]
    place = np.repeat(np.arange(len(which)), n)
    inner = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, flat[np.repeat(at[which], n) + inner]


class Terms:
    """The terms of every sentence of a batch of texts: ``sentence`` and ``term`` side by side, sorted, with counts.

    ``document`` is the text each sentence is of. Sentences without words are left out of the pairs, not of the numbering.
    """

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary):
        if len(vocabulary.terms) > vocabulary.most:
            vocabulary._empty()
        lists = [vocabulary.numbers(x) if x else [_STOP] for x in texts]
        sizes, tokens = _ragged(lists)
        vocabulary.flat()
        tokens = _letters_joined(tokens, vocabulary, texts)
        stop = vocabulary.last[tokens]
        sentence = np.cumsum(stop) - stop
        ends = np.cumsum(sizes) - 1  # each text ends with a stop
        self.sentences = int(stop.sum())
        self.document = np.searchsorted(sentence[ends], np.arange(self.sentences)) if len(texts) else np.zeros(0, int)
        self.first = np.concatenate([[0], sentence[ends] + 1])[:-1] if len(texts) else np.zeros(0, int)
        at, term = _expanded(tokens, vocabulary.t_size, vocabulary.t_at, vocabulary.t_flat)
        parts = [sentence[at] * TERMS + term]
        at, tag = _expanded(tokens, vocabulary.g_size, vocabulary.g_at, vocabulary.g_flat)
        if len(tag):
            of = sentence[at]
            parts.append(of * TERMS + TAG + tag)
            # Neighbours among what is spoken of; other words between them don't matter.
            new = np.ones(len(tag), bool)
            new[1:] = (of[1:] != of[:-1]) | (tag[1:] != tag[:-1])
            o, g = of[new], tag[new]
            two = o[1:] == o[:-1]
            parts.append((o[1:] * TERMS + PAIR + g[:-1] * T + g[1:])[two])
            if len(o) > 2:
                three = two[1:] & two[:-1]
                parts.append((o[2:] * TERMS + TRIPLE + (g[:-2] * T + g[1:-1]) * T + g[2:])[three])
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            masks = np.bitwise_or.reduceat(np.left_shift(np.int64(1), tag), starts)
            kinds, which = np.unique(masks, return_inverse=True)
            n, flat = _ragged([_sets(int(m)) for m in kinds])
            place, both = _expanded(which, n, np.concatenate([[0], np.cumsum(n)]), flat)
            parts.append(of[starts][place] * TERMS + BOTH + both)
        keys, self.count = _counted(np.concatenate(parts))
        self.sentence, self.term = keys // TERMS, keys % TERMS

    def frequencies(self, into: np.ndarray) -> None:
        """Add one for each text that has a term."""
        if len(self.term):
            keys, _ = _counted(self.document[self.sentence] * TERMS + self.term)
            into += np.bincount(keys % TERMS, minlength=TERMS)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


_SETS: dict[int, list[int]] = {}


def _sets(mask: int) -> list[int]:
    if mask not in _SETS:
        if len(_SETS) > 100_000:
            _SETS.clear()
        bits = [b for b in range(T) if mask >> b & 1]
        _SETS[mask] = [a * T + b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    return _SETS[mask]


def _letters_joined(tokens: np.ndarray, vocabulary: Vocabulary, texts: list) -> np.ndarray:
    """Three or more single letters in a row are one word, spelled out."""
    lone = vocabulary.lone[tokens]
    if lone.sum() < 3:
        return tokens
    edge = np.flatnonzero(np.diff(np.concatenate([[False], lone, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    long = ends - begins > 2
    if not long.any():
        return tokens
    letters = vocabulary.letters
    tokens = tokens.copy()
    for a, b in zip(begins[long], ends[long]):
        spelled = "".join(letters[i] for i in tokens[a:b])
        key = "\0" + spelled
        i = vocabulary.known[key] if key in vocabulary.known else vocabulary._put(key, *_spelled(spelled))
        tokens[a:b] = _NONE
        tokens[a] = i
    vocabulary.flat()
    return tokens


def sentence_text(text: str, number: int) -> str:
    """The ``number``-th sentence of a text, as it stands in its cleaned form."""
    text, begin, k = cleaned(text), 0, 0
    for m in _ENDS.finditer(gaps(text)):
        if k == number:
            return text[begin : m.end()].strip()
        k, begin = k + 1, m.end()
    return text[begin:].strip()

"""Where usable credentials stand in texts, and the texts with nothing but these replaced."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from suitelens.llm.batching import by_size
from suitelens.llm.secrets.crf import Labeller, labelled, train
from suitelens.llm.secrets.examples import examples
from suitelens.operators.spread import spread

_KEY_BEGINS = re.compile(r"BEGIN [A-Z ]*PRIVATE KEY")
_KEY_ENDS = re.compile(r"END [A-Z ]*PRIVATE KEY-*")
_MAYBE = re.compile(r"\n[ \t]*[\"'+]")
_GOES_ON = re.compile(r"[ \t\r]*(?:\+[ \t]*)?[\"'][^\"'\n]*[\"'][\s;,)+]*(?:\n|$)|[ \t]*\+")


@lru_cache(maxsize=2)
def model(seed: int = 11, n: int = 9000) -> tuple[np.ndarray, np.ndarray]:
    """Trained on ``n`` generated lines; the same for the same seed."""
    return train([x for x in map(labelled, examples(seed, n)) if x])


@lru_cache(maxsize=2)
def _kept(weights: bytes, steps: bytes) -> Labeller:
    """One labeller a Python worker, whose remembered scores serve all of its tasks."""
    return Labeller(np.frombuffer(weights, np.float32).reshape(-1, 3), np.frombuffer(steps, np.float32).reshape(-1, 3))


def _units(text: str) -> tuple[list[int], list[str]]:
    """(places, lines): the lines, each with those after that its string is put together from."""
    lines = text.split("\n")
    places = list(accumulate([len(x) + 1 for x in lines[:-1]], initial=0))
    if not _MAYBE.search(text):
        return places, lines
    starts, out = [], []
    for at, line in zip(places, lines):
        if out and line[:1] in _INDENT and line.lstrip()[:1] in _PIECE and _GOES_ON.match(line):
            out[-1].append(line)
        else:
            starts.append(at)
            out.append([line])
    return starts, ["\n".join(x) for x in out]


_INDENT, _PIECE = frozenset(" \t\"'+"), frozenset("\"'+")


def spans_of_all(texts: list[str | None], labeller: Labeller, field: str = "") -> list[list[tuple[int, int]]]:
    """``credential_spans`` of each text; nulls have none."""
    units = [_units(x) if x else ([], []) for x in texts]
    labels = labeller.many([line for _, lines in units for line in lines], field)
    out, at = [], 0
    for x, (places, _) in zip(texts, units):
        mine = labels[at : at + len(places)]
        at += len(places)
        out.append(_joined(x, zip(places, mine)) if any(mine) else [])
    return out


def credential_spans(text: str, labeller: Labeller, field: str = "") -> list[tuple[int, int]]:
    """The stretches of ``text`` that are usable credentials; every line is labelled. A string that goes on in the next lines is one."""
    return spans_of_all([text], labeller, field)[0]


def _joined(text: str, labels: Iterable[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, spans in labels:
        for a, b in spans:
            a, b = begin + a, begin + b
            if out and a < out[-1][1]:
                continue  # inside of a key's block
            if _KEY_BEGINS.search(text, a, b) and (last := _KEY_ENDS.search(text, a)):
                b = max(b, last.end())  # a key's block goes on to its last line, however it is cut into lines
            out.append((a, b))
    return out


def redacted(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """Each stretch replaced; what stands between its pieces (quotes, plus signs, line ends in strings) stays."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        pieces = re.split(r"(\"\s*\+?\s*\"|'\s*\+?\s*'|\"\s*[,)].*?\"|\n)", text[a:b])
        parts += [mask if k == 0 else "" if k % 2 == 0 else piece for k, piece in enumerate(pieces)]
        at = b
    return "".join([*parts, text[at:]])


def find_credentials(
    df: DataFrame, id_column: str, text: str, field: str = "", redact: bool = False, mask: str = "REDACTED", seed: int = 11
) -> DataFrame:
    """(id, line_no): the lines on which a credential begins; with ``redact``: (id, text, credentials) of every row instead.

    ``field`` names what the whole text is the value of, if it is one. Lines count from 1 and end at a line feed. Null
    texts have no lines and stay null, empty ones stay empty. Every text is read whole. Rows that repeat an id are
    searched each by itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(x.tobytes() for x in model(seed)))  # 2^BITS weights
    known = spread(df.select(id_column, text))
    id_type = df.schema[id_column].dataType
    if redact:
        schema = T.StructType([T.StructField(id_column, id_type), T.StructField(text, T.StringType()), T.StructField("credentials", T.IntegerType())])
    else:
        schema = T.StructType([T.StructField(id_column, id_type), T.StructField("line_no", T.LongType())])
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _kept(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, lines, clean, counts = [], [], [], []
            every = (s for _, part in by_size(texts) for s in spans_of_all(part, labeller, field))
            for i, (x, spans) in enumerate(zip(texts, every)):
                if redact:
                    clean.append(redacted(x, spans, mask) if spans else x)
                    counts.append(len(spans))
                elif spans:
                    found = sorted({1 if field else x.count("\n", 0, a) + 1 for a, _ in spans})
                    rows += [i] * len(found)
                    lines += found
            if redact:
                columns = [batch.column(0), pa.array(clean, pa.string()), pa.array(counts, pa.int32())]
            else:
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return known.mapInArrow(search, schema)

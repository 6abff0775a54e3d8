"""Scores of documents by their nearest labelled sentences, found exactly through block-max inverted lists.

Sentences are vectors of TF-IDF weights of length 1; document frequencies are counted over all documents. The labelled
sentences lie in blocks; for each term a list has its blocks with the largest weight in each. A sentence adds these up to
the most that any example of a block can reach. Those that can't come near a harmful one score 0; the others visit blocks
from the highest on, and stop when no further one can bring a neighbour nearer than those they have. All of it works on
whole batches of sentences at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.batching import by_size
from suitelens.llm.toxic.examples import labelled
from suitelens.llm.toxic.features import TAG, TERMS, Terms, Vocabulary, sentence_text
from suitelens.operators.spread import spread

#: Examples a block; neighbours that vote; the least cosine of a neighbour; what terms of sense weigh more than words;
#: documents of which the rarest terms count as being in one.
BLOCK, NEIGHBOURS, FLOOR, SENSE, RARE = 64, 6, 0.25, 2.0, 20_000


@lru_cache(maxsize=1)
def _vocabulary() -> Vocabulary:
    """One for each Python worker, which serves all of its tasks."""
    return Vocabulary()


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents have a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents, vocabulary = np.zeros(TERMS, np.int64), 0, _vocabulary()
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x]
            documents += len(texts)
            for _, part in by_size(texts, 512):
                Terms(part, vocabulary).frequencies(total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], documents))], names=["term", "n"])

    rows = spread(df.select(text)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS, np.int64)
    real = rows[rows.term >= 0]
    out[real.term.to_numpy()] = real.n.to_numpy()
    return out, int(rows[rows.term < 0].n.sum())


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Terms that no document has weigh as much as those of one in ``RARE``, so that they don't outweigh the others the more
    documents there are; terms of sense weigh ``SENSE`` times as much as words."""
    out = np.log((n + 2) / (np.maximum(df, max(1, n / RARE)) + 1)) + 0.05
    out[TAG:] *= SENSE
    return out


class Vectors:
    """Sentences as sparse vectors of length 1: of sentence ``of[i]`` the term ``term[i]`` weighs ``weight[i]``."""

    def __init__(self, terms: Terms, weights: np.ndarray):
        raw = (1 + np.log(terms.count)) * weights[terms.term]
        length = np.sqrt(np.bincount(terms.sentence, raw * raw, terms.sentences))
        self.of, self.term = terms.sentence, terms.term
        self.weight = raw / np.where(length > 0, length, 1)[self.of]


class Index:
    def __init__(self, texts: list[str], labels: list[int], weights: np.ndarray):
        self.weights = weights
        order = sorted(range(len(texts)), key=lambda i: (-labels[i], i))  # harmful ones first: whole blocks of one kind
        harmful = sum(labels)
        self.harmful_blocks = -(-harmful // BLOCK)
        place = [k if k < harmful else self.harmful_blocks * BLOCK + k - harmful for k in range(len(order))]
        self.blocks = self.harmful_blocks + -(-(len(order) - harmful) // BLOCK)
        self.labels = np.zeros(self.blocks * BLOCK)
        self.texts: list[str] = [""] * (self.blocks * BLOCK)
        for i, at in zip(order, place):
            self.labels[at], self.texts[at] = labels[i], texts[i]
        # One example is one vector, also where it has a full stop inside.
        made = Terms([t or None for t in self.texts], Vocabulary())
        made.sentence, made.sentences = made.document[made.sentence], len(self.texts)
        v = Vectors(_merged(made), weights)
        self.vectors = v
        rows, row = np.unique(v.term, return_inverse=True)
        self.row_of = np.full(TERMS, -1)
        self.row_of[rows] = np.arange(len(rows))
        cells, cell = np.unique(row * self.blocks + v.of // BLOCK, return_inverse=True)
        self.dense = np.zeros((len(cells) + 1, BLOCK))  # the last one stands for blocks without the term
        self.dense[cell, v.of % BLOCK] = v.weight
        self.cell = np.full((len(rows), self.blocks), len(cells))
        self.cell[cells // self.blocks, cells % self.blocks] = np.arange(len(cells))
        self.top = np.zeros((len(rows), self.blocks))
        self.top[cells // self.blocks, cells % self.blocks] = self.dense[:-1].max(1)
        self.harmful_tops = self.top[:, : self.harmful_blocks].copy()
        self.harmful_top = self.harmful_tops.max(1, initial=0.0)

    def neighbours(self, vectors: Vectors, sentences: int, k: int = NEIGHBOURS, without: np.ndarray | None = None, floor: float = FLOOR):
        """(scores, places) of the ``k`` most similar examples of each sentence, the nearest first; 0 and -1 where there are fewer.

        Only those with a cosine of ``floor`` or more count, and none are looked for if no harmful one can reach it.
        ``without`` names an example for each sentence that is left out, to score it by the others.
        """
        scores, places = np.zeros((sentences, k)), np.full((sentences, k), -1)
        row = self.row_of[vectors.term]
        known = row >= 0
        of, row, weight = vectors.of[known], row[known], vectors.weight[known]
        # A bound over all harmful blocks first, then one for each block.
        near = np.bincount(of, weight * self.harmful_top[row], sentences) >= floor
        keep = near[of]
        of, row, weight = of[keep], row[keep], weight[keep]
        if not len(of):
            return scores, places
        new = np.concatenate([[True], of[1:] != of[:-1]])
        starts, who = np.flatnonzero(new), of[new]
        keep = np.add.reduceat(weight[:, None] * self.harmful_tops[row], starts).max(1, initial=0.0) >= floor
        sizes = np.diff(np.append(starts, len(of)))
        keep_terms = np.repeat(keep, sizes)
        row, weight, who, sizes = row[keep_terms], weight[keep_terms], who[keep], sizes[keep]
        if not len(who):
            return scores, places
        starts = np.cumsum(sizes) - sizes
        most = np.add.reduceat(weight[:, None] * self.top[row], starts)
        visits = np.argsort(-most, axis=1, kind="stable")
        live = np.arange(len(who))
        for turn in range(self.blocks):
            block = visits[live, turn]
            least = np.maximum(scores[who[live], -1], floor)
            go = most[live, block] >= least
            live, block, least = live[go], block[go], least[go]
            if not len(live):
                break
            n = sizes[live]
            place = np.repeat(starts[live], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            got = np.add.reduceat(weight[place][:, None] * self.dense[self.cell[row[place], np.repeat(block, n)]], np.cumsum(n) - n)
            ids = block[:, None] * BLOCK + np.arange(BLOCK)
            if without is not None:
                got[ids == without[who[live]][:, None]] = 0
            got[got < floor] = 0
            w = who[live]
            both, at = np.concatenate([scores[w], got], 1), np.concatenate([places[w], np.where(got > 0, ids, -1)], 1)
            best = np.lexsort((at, -both), axis=1)[:, :k]
            scores[w], places[w] = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
        return scores, places

    def votes(self, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The share of harmful neighbours, each weighted by nearness; far ones leave room for doubt."""
        c = scores**3
        return (c * self.labels[places] * (places >= 0)).sum(1) / (c.sum(1) + 0.03)

    def score(self, texts: list[str | None], vocabulary: Vocabulary) -> tuple[Terms, np.ndarray, np.ndarray]:
        """(terms, votes, places of neighbours) of all sentences of some texts."""
        terms = Terms(texts, vocabulary)
        scores, places = self.neighbours(Vectors(terms, self.weights), terms.sentences)
        return terms, self.votes(scores, places), places


def _merged(terms: Terms) -> Terms:
    """Terms of several sentences that have become one, counted together."""
    keys, inverse = np.unique(terms.sentence * TERMS + terms.term, return_inverse=True)
    terms.count = np.bincount(inverse, terms.count).astype(np.int64)
    terms.sentence, terms.term = keys // TERMS, keys % TERMS
    return terms


def calibrated(index: Index) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from votes to chances, fitted on each example judged by the others."""
    known = np.array([bool(t) for t in index.texts])
    scores, places = index.neighbours(index.vectors, len(index.texts), without=np.arange(len(index.texts)))
    x, y = index.votes(scores, places)[known], index.labels[known]
    slope, offset = 4.0, -2.0
    for _ in range(200):  # Newton steps, held back a little
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([((y - p) * x).sum() - 0.01 * slope, (y - p).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + 0.5 * step[0], offset + 0.5 * step[1]
    return float(slope), float(offset)


@lru_cache(maxsize=1)
def _built(weights: bytes) -> Index:
    """One for each Python worker and corpus."""
    return Index(*labelled(), np.frombuffer(weights, np.float32).astype(float))


def harm_scores(df: DataFrame, id_column: str, text: str, keep: list[str] = (), evidence: bool = True) -> DataFrame:
    """(id, keep.., score, evidence, example): of each document, the score of its worst sentence.

    ``score`` is the calibrated chance that a sentence is harmful, 0 for documents without text or where no example comes
    near. ``evidence`` is that sentence (the first of equals), in its form without disguise of signs, and ``example`` the
    nearest harmful labelled one; both null where nothing comes near, and left out altogether on request. Whole texts are
    read, names of code and markup included as far as they say something to somebody.
    """
    counts, n = document_frequencies(df, text)
    weights = idf(counts, n).astype(np.float32).tobytes()  # TERMS numbers, whatever the corpus
    shared = df.sparkSession.sparkContext.broadcast(weights)
    slope, offset = calibrated(_built(weights))
    names = [id_column, *keep, "score", *(("evidence", "example") if evidence else ())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vocabulary = _built(shared.value), _vocabulary()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores, said, example = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
            for i, part in by_size(texts, 512):
                terms, votes, places = index.score(part, vocabulary)
                hit = np.flatnonzero(votes > 0)
                # The first of the worst sentences of each document.
                hit = hit[np.lexsort((hit, -votes[hit], terms.document[hit]))]
                of = terms.document[hit]
                hit = hit[np.concatenate([[True], of[1:] != of[:-1]])] if len(hit) else hit
                scores[i + terms.document[hit]] = np.round(1 / (1 + np.exp(-(slope * votes[hit] + offset))), 6)
                if evidence:
                    for s in hit:
                        d = terms.document[s]
                        said[i + d] = sentence_text(part[d], int(s - terms.first[d]))
                        example[i + d] = next((index.texts[p] for p in places[s] if p >= 0 and index.labels[p]), None)
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64())]
            if evidence:
                columns += [pa.array(said, pa.string()), pa.array(example, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    known = spread(df.select(id_column, *keep, F.col(text).alias("_text")))
    schema = known.drop("_text").schema.add("score", "double")
    if evidence:
        schema = schema.add("evidence", "string").add("example", "string")
    return known.mapInArrow(judge, schema)

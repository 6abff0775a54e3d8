"""Drawing texts so that sources reach target shares of all tokens, with a limit on how often a text is repeated.

Weights start at the targets. Where a budget would need a source more often than its limit, the weights are tempered:
w_i is in proportion to t_i (c_i / t_i)^e, where t are the targets and c the shares of the tokens that the limits allow;
the exponent is bisected to the least that keeps to all limits (0: the targets, 1: everything as often as allowed).
Without a budget the largest is taken for which no tempering is needed; the budget ``ALL`` is as many tokens as the listed
sources have, which limits below the targets' need bend towards what is there. Where an entropy is asked for instead of
targets, ``exponent_for_entropy`` bisects the exponent on the sources' own shares. A source's weight is realised in blocks,
one per repetition, each a permutation of its texts of its own, the last one up to the source's budget of tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitelens.llm.tokens import VOCABULARY, with_token_counts
from suitelens.operators.ordered_scan import ordered_scan
from suitelens.storage import staged


#: As many tokens as there are.
ALL = "all"


@dataclass
class Source:
    name: str
    target: float
    tokens: int
    limit: int | None  # None: no limit

    @property
    def most(self) -> float:
        return math.inf if self.limit is None else float(self.limit * self.tokens)


def source_name(c: Column) -> Column:
    """One spelling of a source: no outer blanks, lower case, '-' for '_'."""
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def weights(sources: list[Source], exponent: float) -> list[float]:
    total = sum(s.target for s in sources)
    open_end = [s for s in sources if s.limit is None]
    capped = sum(s.most for s in sources if s.limit is not None)
    capped_target = sum(s.target for s in sources if s.limit is not None)
    raw = []
    for s in sources:
        t = s.target / total
        # A source without limit keeps its target's relation to the others.
        c = t if s in open_end or not capped else s.most / capped * capped_target / total
        raw.append(t * (c / t) ** exponent)
    return [r / sum(raw) for r in raw]


def entropy(parts: list[float]) -> float:
    total = sum(parts)
    return -sum(p / total * math.log(p / total) for p in parts if p > 0)


def exponent_for_entropy(tokens: list[float], target: float) -> float:
    """The exponent e for which shares in proportion to tokens^e have this entropy (in nats).

    0 gives all sources the same, 1 leaves their own shares, more favours the large ones. A target that no exponent up
    to 64 meets gives the nearest end.
    """
    most = max(tokens, default=0)
    tokens = [t / most for t in tokens if t > 0]
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy([t**mid for t in tokens]) > target else (low, mid)
    return low


def plan(sources: list[Source], budget: int | str | None) -> tuple[dict[str, int], float, float]:
    """(tokens to draw of each source, exponent, total): the least tempering that keeps to the limits."""
    sources = [s for s in sources if s.tokens > 0 and s.target > 0 and s.limit != 0]
    if not sources:
        return {}, 0.0, 0.0

    def room(exponent: float) -> float:
        return min(s.most / w for s, w in zip(sources, weights(sources, exponent)))

    if budget == ALL:
        budget = sum(s.tokens for s in sources)
    if budget is None:
        budget = room(0.0) if math.isfinite(room(0.0)) else sum(s.tokens for s in sources)
    low, high = 0.0, 1.0
    if room(0.0) >= budget:
        high = 0.0
    else:
        budget = min(budget, room(1.0))
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if room(mid) >= budget else (mid, high)
    amounts = {s.name: int(min(s.most, w * budget + 1e-6)) for s, w in zip(sources, weights(sources, high))}
    return amounts, high, float(budget)


def _prepared(documents: DataFrame, targets: DataFrame, vocabulary: str):
    spark = documents.sparkSession
    listed = targets.filter(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    wanted = listed.collect()  # the list of targets, which someone wrote
    texts = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    texts = texts.join(F.broadcast(listed.select("source")), "source", "left_semi")
    sizes = staged(with_token_counts(texts, "text").filter("n_tokens > 0"), "mix-sizes")
    have = {r[0]: (r[1], r[2]) for r in sizes.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    sources = [Source(r.source, r.target_share or 0.0, have.get(r.source, (0, 0))[0], r.max_repeats) for r in wanted]
    return spark, sizes, sources, have


def draw(
    documents: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 0, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(source, repeat_no, position, doc_id, n_tokens): the draw; ``repeat_no`` counts a text's repetitions from 1.

    ``position`` is the place of a text in the block of its source and repetition; every block has an order of its own.
    Texts of sources that are null or not in ``targets``, null and empty texts are never drawn. A listed source
    without texts can't be; the others then share its part in proportion. A null limit is none. Equal for equal seeds.
    """
    _, sizes, sources, _ = _prepared(documents, targets, vocabulary)
    return _drawn(sizes, sources, plan(sources, budget)[0], seed)


def _drawn(sizes: DataFrame, sources: list[Source], amounts: dict[str, int], seed: int) -> DataFrame:
    spark = sizes.sparkSession
    tokens = {s.name: s.tokens for s in sources}
    rows = [(name, n // tokens[name], n % tokens[name]) for name, n in amounts.items()]
    planned = spark.createDataFrame(rows, "source string, whole long, rest long")  # the list of targets, which someone wrote
    blocks = F.sequence(F.lit(1).cast("long"), F.col("whole") + (F.col("rest") > 0).cast("long"))
    each = sizes.join(F.broadcast(planned), "source").filter("whole > 0 OR rest > 0").select("source", F.explode(blocks).alias("repeat_no"), "doc_id", "n_tokens", "whole", "rest")
    each = each.withColumn("_shuffled", F.xxhash64(F.lit(seed), "repeat_no", "doc_id"))
    scanned = ordered_scan(each, ["source", "repeat_no"], [F.col("_shuffled"), F.col("doc_id")], ["n_tokens"])
    # The text that crosses the budget is taken if that comes nearer to it.
    fits = F.col("_sum_n_tokens") * 2 - F.col("n_tokens") <= F.col("rest") * 2
    return scanned.filter((F.col("repeat_no") <= F.col("whole")) | fits).select("source", "repeat_no", F.col("_position").alias("position"), "doc_id", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per listed source its texts, target, drawn tokens and the share really reached, and the exponent of the whole draw."""
    spark, sizes, sources, have = _prepared(documents, targets, vocabulary)
    amounts, exponent, _ = plan(sources, budget)
    drawn = _drawn(sizes, sources, amounts, seed).groupBy("source").agg(
        F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat_no").alias("repeats"), F.count(F.lit(1)).alias("drawn_texts")
    )
    rows = [(s.name, s.target, s.limit, have.get(s.name, (0, 0))[1], s.tokens) for s in sources]
    listed = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, texts long, tokens long")
    joined = listed.join(drawn, "source", "left").na.fill(0, ["drawn_tokens", "repeats", "drawn_texts"])
    total = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0)))  # over the listed sources
    return joined.select(
        *listed.columns, "drawn_texts", "drawn_tokens", "repeats",
        F.round(F.try_divide(F.col("drawn_tokens"), total), 6).alias("actual_share"), F.lit(round(exponent, 6)).alias("exponent"),
    )

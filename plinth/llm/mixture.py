"""Mixing sources to target weights: whole copies that are certain, then Pareto order sampling.

Sizes are tokens. The mixture is as large as the scarcest source allows: with shares among the sources that hold documents, no
source is asked for more than its cap of repeats gives. Within a source a document of t tokens is wanted `level * weight(t)`
times on average, up to the cap; the level makes the expected tokens meet the source's budget. The whole part of that number is
certain. Its rest p is the inclusion probability of one more copy: documents are ranked by random odds u/(1-u) divided by the
inclusion odds p/(1-p), and the first in that order are taken until the budget is met (Pareto order sampling, of fixed size in
tokens). u is a hash of the seed and the document, so a mixture can be repeated.

The order is never sorted as a whole: ranks are 48-bit integers, and three rounds of sums per source over 4,096 digits each lead to
the few documents around the border. Sums by source and power of two of the size are all that the driver sees.

Defined results: null, empty and blank texts have no tokens and are not drawn; documents of a source without a target, or of none,
are not drawn and listed with share 0; a target without documents is listed with share 0 and its share falls to the others in
proportion; a repeated document id counts once (its row with the least source, then the fewest tokens); a target that is named
twice is an error; without any target or document the mixture is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import cut

DIGITS, WIDTH = 3, 12


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def weight(power: int, tilt: float) -> float:
    """The weight of documents with 2**power tokens or up to twice as many."""
    return 2.0 ** (power * tilt)


def _level(classes: list[tuple[float, float]], cap: float, budget: float) -> float:
    """The level at which the expected tokens, sum of tokens * min(cap, level * weight), meet the budget. classes: (weight, tokens)."""
    flat, rest = 0.0, sorted(classes, reverse=True)  # the heaviest reach the cap first
    while rest:
        slope = sum(w * t for w, t in rest)
        level = (budget - flat) / slope if slope else 0.0
        if level * rest[0][0] <= cap + 1e-12:
            return level
        flat += cap * rest[0][1]
        rest = rest[1:]
    return float("inf")


def plan(classes: dict[str, dict[int, float]], targets: list[Target], tilt: float, total: float | None = None) -> tuple[float, dict[str, dict]]:
    """The size of the mixture, and per source its budget and level. classes: source -> power of two -> tokens."""
    if len({t.source for t in targets}) < len(targets):
        raise ValueError("a source has two targets")
    there = [t for t in targets if t.share > 0 and t.max_repeats > 0 and sum(classes.get(t.source, {}).values()) > 0]
    shares = sum(t.share for t in there)
    if not there:
        return 0.0, {}
    most = min(sum(classes[t.source].values()) * t.max_repeats * shares / t.share for t in there)
    size = most if total is None else min(total, most)
    found = {}
    for t in there:
        budget = size * t.share / shares
        held = [(weight(p, tilt), x) for p, x in classes[t.source].items()]
        found[t.source] = {"budget": budget, "level": min(_level(held, t.max_repeats, budget), t.max_repeats / min(w for w, _ in held)), "cap": t.max_repeats}
    return size, found


def mix(sized: DataFrame, targets: list[Target], seed: int = 42, tilt: float = 0.25, total: float | None = None) -> DataFrame:
    """Rows (doc_id, source, n_tokens, copies) of the documents drawn. sized: (doc_id, source, n_tokens), written already."""
    docs = sized.where("doc_id is not null and source is not null and n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*")
    docs = docs.where(F.col("source").isin([t.source for t in targets])).withColumn("power", F.floor(F.log2("n_tokens")).cast("int"))
    classes: dict[str, dict[int, float]] = {}
    for r in docs.groupBy("source", "power").agg(F.sum("n_tokens").alias("t")).collect():  # at most 63 rows for each target
        classes.setdefault(r.source, {})[r.power] = float(r.t)
    size, found = plan(classes, targets, tilt, total)
    spark = sized.sparkSession
    if not size:
        return docs.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).limit(0)
    rates = spark.createDataFrame([(s, p, min(float(x["cap"]), x["level"] * weight(p, tilt))) for s, x in found.items() for p in classes[s]], "source string, power int, wanted double")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    whole = F.floor(F.col("wanted") + 1e-9)
    rest = F.greatest(F.lit(0.0), F.col("wanted") - whole)
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.when(F.col("p") > 0, F.col("p"))
    ranked = cut(
        docs.join(F.broadcast(rates), ["source", "power"])
        .select("doc_id", "source", "n_tokens", whole.alias("whole"), rest.alias("p"), u.alias("u"))
        .withColumn("odds", odds)
        .select("doc_id", "source", "n_tokens", "whole", F.floor(F.col("odds") / (1 + F.col("odds")) * float(1 << (DIGITS * WIDTH))).cast("bigint").alias("at"))
    )
    certain = {r.source: r.t for r in ranked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("t")).collect()}
    left = {s: x["budget"] - certain.get(s, 0) for s, x in found.items()}
    # Radix selection: prefix is the digits of the border so far; what lies below it is taken.
    prefix = dict.fromkeys(found, 0)
    for k in range(DIGITS):
        shift = WIDTH * (DIGITS - 1 - k)
        borders = F.create_map(*(F.lit(x) for kv in prefix.items() for x in kv))[F.col("source")]
        digit = F.shiftright(F.col("at"), shift)
        part = ranked.where("at is not null").withColumn("digit", digit).where(F.shiftright(F.col("digit"), WIDTH) == borders)
        sums: dict[str, list] = {}
        for r in part.groupBy("source", "digit").agg(F.sum("n_tokens").alias("t")).collect():  # at most 4,096 rows for each target
            sums.setdefault(r.source, []).append((r.digit, r.t))
        for s in prefix:
            border = (prefix[s] << WIDTH) + (1 << WIDTH) - 1
            for d, t in sorted(sums.get(s, [])):
                if t > left[s]:
                    border = d
                    break
                left[s] -= t
            prefix[s] = border
    ends = spark.createDataFrame([(s, prefix[s], float(left[s])) for s in found], "source string, border bigint, room double")
    drawn = ranked.join(F.broadcast(ends), "source")
    # Around the border stand the documents of one rank of 2**36: next to none, in the order of their ids.
    run = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    border = drawn.where("at = border").withColumn("sofar", F.sum("n_tokens").over(run)).select("*", (F.col("sofar") - F.col("n_tokens") / 2 <= F.col("room")).alias("more")).drop("sofar")
    others = drawn.where("at is null or at != border").withColumn("more", F.coalesce(F.col("at") < F.col("border"), F.lit(False)))
    return others.unionByName(border).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more").cast("int")).cast("int").alias("copies")).where("copies > 0")


def shares(sized: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """Rows (source, target_share, max_repeats, n_docs, n_tokens, drawn_docs, drawn_copies, drawn_tokens, share_reached), one per source of either table."""
    held = sized.groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_docs"), F.sum("copies").alias("drawn_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    every = targets.join(held.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "full").withColumn("source", F.coalesce("source", "s")).drop("s")
    every = every.join(got, "source", "left").fillna(0, ["n_docs", "n_tokens", "drawn_docs", "drawn_copies", "drawn_tokens"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())
    return every.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "drawn_docs", "drawn_copies", "drawn_tokens", F.when(total > 0, F.col("drawn_tokens") / total).otherwise(0.0).alias("share_reached"))

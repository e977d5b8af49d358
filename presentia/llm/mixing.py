"""Mixing sources to target weights: iterative proportional fitting (DataFrame functions only).

Documents are reduced to cells (source, language, topic) with their tokens. The cells' weights are raked:
scaled to the target of each source, then of each language, then of each topic, round after round, until no
weight moves. A document is then taken ``budget * raked / current`` times on average: the expected tokens of
every cell are its raked weight, and all of them together are the budget. Where that number is under 1 it is
the probability that the document is selected; a lifted cell's documents are taken several times.

Only cells are iterated on: the documents are read once to count and once to sample, and what is shuffled
is summed in the tasks first. A fit sums the cells by value, with the targets as rows of the same aggregate,
and merges the factors back by value; adaptive execution splits a hot value in that join. Nothing of a fit is
broadcast or collected: how far the weights moved is observed while a round is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize, release

DIMS = ("source", "lang", "topic")
#: A dimension's target share is its current share to this power, normalised: under 1 lifts the rare values.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: The most rounds, and the relative change of the weights at which they end.
ROUNDS, STILL = 10, 1e-13
#: The sample's tokens over all tokens.
BUDGET = 0.75
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """The number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, markup, list, notice or prose; short for under 200 characters."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) < 200, "short")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("%%%")) | F.contains(t, F.lit("$$$")), "markup")
        .when(F.contains(F.lower(t), F.lit("license")) | F.contains(F.lower(t), F.lit("licensed")), "notice")
        .when(F.contains(t, F.lit("\n")), "prose")
        .otherwise("line")
    )


def uniform(doc_id: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) for each id; the id alone decides."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def power_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): shares to a power, summing to 1. Values without tokens get none."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("t", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = shares.agg(F.sum("t")).first()[0]
    return shares.select(dim, (F.col("t") / F.lit(total or 1.0)).alias("target"))


def _fit(cur: DataFrame, dim: str, target: DataFrame) -> DataFrame:
    """``cur`` scaled to the target of one dimension; ``moved`` is the largest relative change so far. Null is a value."""
    both = cur.select(dim, "raked", F.lit(None).cast("double").alias("target")).unionByName(target.select(dim, F.lit(0.0).alias("raked"), F.col("target").cast("double")))
    sums = both.groupBy(dim).agg(F.sum("raked").alias("sum_"), F.max("target").alias("target_"))
    factor = sums.filter("sum_ > 0 and target_ is not null").select(F.col(dim).alias("value_"), (F.col("target_") / F.col("sum_")).alias("factor_"))
    out = cur.join(factor.hint("merge"), cur[dim].eqNullSafe(factor["value_"]))
    return out.select(*DIMS, "tokens", (F.col("raked") * F.col("factor_")).alias("raked"), F.greatest(F.col("moved"), F.abs(F.col("factor_") - 1)).alias("moved"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dims, tokens) with ``raked``: weights whose marginals approach the targets (dim, target).

    Dimensions are fitted in the order given, the last one exactly. Values without a target are dropped
    from the fit (weight 0 by absence). Rounds end when no weight moves.
    """
    fitted = {d: materialize(t, f"mix-target-{d}") for d, t in targets.items()}
    cur = cells.select(*DIMS, "tokens", F.col("tokens").cast("double").alias("raked"))
    last = None
    for r in range(rounds):
        out = cur.withColumn("moved", F.lit(0.0))
        for d, target in fitted.items():
            out = _fit(out, d, target)
        # A plan that feeds on itself grows with each round: every round is written, and the one before it goes.
        out = materialize(out, f"mix-{r}")
        if last is not None:
            release(last)
        last, cur = out, out.select(*DIMS, "tokens", "raked")
        if r and (out.agg(F.max("moved")).first()[0] or 0.0) < STILL:
            break
    for target in fitted.values():
        release(target)
    return cur


def marginal_error(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a share of ``raked`` from its target, over all dimensions."""
    total = raked.agg(F.sum("raked")).first()[0] or 1.0
    worst = 0.0
    for d, target in targets.items():
        shares = raked.select(d, (F.col("raked") / F.lit(total)).alias("x")).unionByName(target.select(d, (-F.col("target")).alias("x"))).groupBy(d).agg(F.abs(F.sum("x")).alias("x"))
        worst = max(worst, shares.agg(F.max("x")).first()[0] or 0.0)
    return worst


def cell_ratios(cells: DataFrame, rounds: int = ROUNDS, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, ratio) for each cell with tokens and targets: its raked share over its current share."""
    powers = powers or POWERS
    full = cells.filter("tokens > 0")
    raked = rake(full, targets or {d: power_targets(full, d, powers[d]) for d in DIMS}, rounds)
    tokens, weight = raked.agg(F.sum("tokens").cast("double"), F.sum("raked")).first()
    return raked.select(*DIMS, ((F.col("raked") / F.lit(weight or 1.0)) / (F.col("tokens") / F.lit(tokens or 1.0))).alias("ratio"))


def _keyed(docs: DataFrame, topic: Column | None) -> DataFrame:
    """``row`` (all columns of a document in one struct, so that no name is taken), and its cell and tokens."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("lang").alias("lang"),
        (topic_of(F.col("text")) if topic is None else topic).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"),
    )


def _rated(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """``rows`` with the ratio of their cell; 0 where it has none."""
    by = ratios.select(*[F.col(k).alias(f"{k}_") for k in (*DIMS, "ratio")])
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(by[f"{k}_"]) for k in DIMS])
    return rows.join(by, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce(by["ratio_"], F.lit(0.0)).alias("ratio"))


def _copies(ratio: Column, doc_id: Column, budget: float) -> Column:
    """How often a document is taken: the floor of the expected number, and one more for that share of the ids which is left."""
    expected = F.lit(float(budget)) * ratio
    return (F.floor(expected) + (uniform(doc_id, SEED) < expected - F.floor(expected)).cast("int")).cast("int")


def mix(docs: DataFrame, topic: Column | None = None, rounds: int = ROUNDS, budget: float = BUDGET, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, ratio (raked over current weight of its cell), p, selected, copies.

    One row for each row of ``docs`` (doc_id, text, source, lang). ``targets`` gives the target shares by
    dimension as tables (source, target), (lang, target), (topic, target); without them they are the current
    shares to ``powers``. ``copies`` is how often the sample has the row, ``selected`` whether it has it, and p
    the probability of that. Null sources and languages are values of their own. Cells without tokens (empty
    and null texts only) and values without a target have nothing to weigh: ratio, p and copies are 0. Very
    long texts count all their words. Repeated rows of one id are taken alike; documents of one cell are told
    apart by their id alone. An empty table gives an empty result. Other columns, whatever their names, are
    not read.
    """
    rows = materialize(_keyed(docs, topic).drop("row"), "mix-rows")
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    out = _rated(rows, cell_ratios(cells, rounds, powers, targets))
    copies = _copies(F.col("ratio"), F.col("doc_id"), budget)
    p = F.least(F.lit(1.0), F.lit(float(budget)) * F.col("ratio"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "ratio", p.alias("p"), (copies > 0).alias("selected"), copies.alias("copies"))


def _drawn(docs: DataFrame, topic: Column | None, rounds: int, budget: float, powers: dict[str, float] | None, targets: dict[str, DataFrame] | None) -> DataFrame:
    """``row`` and ``copies`` of every document; texts are not written again."""
    rows = _keyed(docs, topic)
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    ratios = cell_ratios(cells, rounds, powers, targets)
    return _rated(rows, ratios).select("row", _copies(F.col("ratio"), F.col("doc_id"), budget).alias("copies"))


def sample_mix(docs: DataFrame, topic: Column | None = None, rounds: int = ROUNDS, budget: float = BUDGET, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` selects, once each, with all their columns as they are.

    Cells lifted beyond what there is fall short of their target; see :func:`repeat_mix`. Nulls, empty and long
    texts, repeated rows, empty tables and further columns are treated as by :func:`mix`.
    """
    return _drawn(docs, topic, rounds, budget, powers, targets).filter("copies > 0").select("row.*")


def repeat_mix(docs: DataFrame, topic: Column | None = None, rounds: int = ROUNDS, budget: float = BUDGET, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the ``copies`` of :func:`mix` say, with all their columns as they are.

    The sample meets the raked weights. Nulls, empty and long texts, repeated rows, empty tables and further
    columns are treated as by :func:`mix`.
    """
    drawn = _drawn(docs, topic, rounds, budget, powers, targets).filter("copies > 0")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def mix_sql(documents: str = "documents", rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same in DuckDB SQL, the rounds written out."""
    topic = (
        "case when length(t) < 200 then 'short' when contains(t, ' | ') then 'table' when contains(t, '%%%') or contains(t, '$$$') then 'markup' "
        "when contains(lower(t), 'license') then 'notice' when contains(t, chr(10)) then 'prose' else 'line' end"
    )
    parts = [
        f"rows_ as (select doc_id, source, lang, {topic} as topic, cast(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens from (select *, coalesce(text, '') as t from {documents}))",
        "cells as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens, cast(sum(n_tokens) as double) as raked from rows_ group by all having sum(n_tokens) > 0)",
    ]
    for d in DIMS:
        parts.append(f"s_{d} as (select {d}, pow(sum(tokens), {POWERS[d]}) as t from cells group by {d})")
        parts.append(f"t_{d} as (select {d}, t / (select sum(t) from s_{d}) as target from s_{d})")
    last = "cells"
    for r in range(rounds):
        for d in DIMS:
            name = f"r{r}_{d}"
            parts.append(
                f"{name} as materialized (select c.source, c.lang, c.topic, c.tokens, c.raked * (t.target / s.sum_) as raked from {last} c "
                f"join (select {d}, sum(raked) as sum_ from {last} group by {d}) s on s.{d} is not distinct from c.{d} join t_{d} t on t.{d} is not distinct from c.{d})"
            )
            last = name
    parts.append(f"rated as (select source, lang, topic, tokens, (raked / (select sum(raked) from {last})) / (tokens / (select sum(tokens) from {last})) as ratio from {last})")
    u = f"cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(r.doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0"
    parts.append(
        f"drawn as (select r.*, coalesce(ratio, 0.0) as ratio, {budget} * coalesce(ratio, 0.0) as e, {u} as u from rows_ r "
        "left join rated q on q.source is not distinct from r.source and q.lang is not distinct from r.lang and q.topic is not distinct from r.topic)"
    )
    return (
        "with " + ",\n".join(parts) + "\nselect doc_id, source, lang, topic, n_tokens, ratio, least(1.0, e) as p, floor(e) + cast(u < e - floor(e) as int) > 0 as selected, "
        "cast(floor(e) + cast(u < e - floor(e) as int) as int) as copies from drawn"
    )

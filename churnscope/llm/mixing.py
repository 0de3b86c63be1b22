"""Mixing sources to target weights by raking (operator 2), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, small, unit_hash, written

DIMS = ("source", "lang", "topic")
#: Target share of a value: its token share to this power, made to sum to one.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.6
DOC = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}


def topic(text: Column, words: Column) -> Column:
    """The text's form, the topic for tables that carry none."""
    bars = F.regexp_count(text, F.lit(r"\|"))
    shouts = F.regexp_count(text, F.lit("!!"))
    return (F.when(words == 0, "empty").when(bars * 4 >= words, "table").when(shouts * 4 >= words, "shout")
            .when(text.rlike(r"(?i)licen[sc]e|copyright"), "licence")
            .when(text.rlike(r"@\w+\.|\+\d"), "contact").otherwise("prose"))


def features(docs: DataFrame, own: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One slim row for each document: its dimensions, whole-text token count
    and text hash.  Nulls become the value '' (a group of its own).  ``own``
    adds unchanged columns: new name to (name, type)."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    named = {"topic": "string"} if "topic" in docs.columns else {}
    more = {c: t for c, t in (own or {}).values()}
    df = pick(docs, more | DOC | named).withColumn("n_tokens", words.cast("long"))
    form = topic(text, F.col("n_tokens"))
    return df.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")],
                     (F.coalesce("topic", form) if named else form).alias("topic"), "n_tokens",
                     F.xxhash64(text).alias("text_hash"), *[F.col(c).alias(new) for new, (c, _) in (own or {}).items()])


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER, tolerance: float = 1e-4,
         rounds: int = 25) -> DataFrame:
    """Iterative proportional fitting of ``tokens`` over the cells.

    Each round scales the cells' weights to each dimension's target sums in
    turn, until no target is missed by more than ``tolerance`` of all tokens.
    Cells with no tokens keep weight 0.  Sums combine before their shuffle."""
    cells = written(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return cells
    targets = {}
    for dim in DIMS:
        share = cells.groupBy(dim).agg(F.pow(F.sum("w") / total, F.lit(temper[dim])).alias("t")).where("t > 0")
        share = written(share, f"target-{dim}")
        n, norm = share.agg(F.count("*"), F.sum("t")).first()
        targets[dim] = (share.withColumn("t", F.col("t") / norm * total), n)
    for _ in range(rounds):
        for dim in DIMS:
            goal, n = targets[dim]
            now = cells.groupBy(dim).agg(F.sum("w").alias("now")).join(small(goal, n), dim)
            scale = now.select(dim, (F.col("t") / F.col("now")).alias("f"))
            cells = cells.join(small(scale, n), dim, "left").withColumn(
                "w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
        cells = written(cells, "raked")
        missed = 0.0
        for dim in DIMS[:-1]:  # the last dimension was just met
            goal, n = targets[dim]
            gap = cells.groupBy(dim).agg(F.sum("w").alias("now")).join(small(goal, n), dim)
            missed = max(missed, gap.agg(F.max(F.abs(F.col("t") - F.col("now")))).first()[0] / total)
        if missed <= tolerance:
            break
    return cells


def rates(cells: DataFrame, budget: float) -> DataFrame:
    """Sampling probability of each raked cell: min(1, c * w / tokens), with c
    such that the expected tokens are the budget's share of all (all positive
    cells at 1 if even that is less).  c is found by exact sums at 32 candidate
    values a round, refined between the two that enclose the budget."""
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    total, top, least = cells.agg(F.sum("tokens"), F.max(ratio), F.min(F.when(ratio > 0, ratio))).first()
    if not total or not top:
        return cells.withColumn("probability", F.lit(1.0))
    lo, hi = 0.0, 1.0 / least
    for _ in range(6):
        tries = [lo + (hi - lo) * i / 32 for i in range(33)]
        sums = cells.agg(*[F.sum(F.least(F.lit(1.0), ratio * c) * F.col("tokens")).alias(f"s{i}")
                           for i, c in enumerate(tries)]).first()
        i = next((i for i, s in enumerate(sums) if s >= budget * total), 32)
        lo, hi = tries[max(0, i - 1)], tries[i]
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * hi))


def plan(slim: DataFrame, budget: float = BUDGET, temper: dict[str, float] = TEMPER) -> tuple[DataFrame, int]:
    """Weight and probability of every cell, and the number of cells."""
    cells = slim.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    cells = written(rates(rake(cells, temper), budget), "rates")
    weight = F.col("w") / F.greatest(F.col("tokens"), F.lit(1))
    return cells.select(*DIMS, weight.alias("weight"), "probability"), cells.count()


def decided(rows: DataFrame, cells: tuple[DataFrame, int], seed: int = 2) -> DataFrame:
    """Rows of ``features`` with their cell's weight, their probability and decision."""
    p = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("probability"))
    return rows.join(small(*cells), list(DIMS)).withColumn("probability", p).withColumn(
        "kept", unit_hash(seed, F.col("doc_id"), F.col("text_hash")) < F.col("probability"))


def mix(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] = TEMPER, seed: int = 2) -> DataFrame:
    """Raked weight, sampling probability and decision for every document.

    A document is kept if a hash of its id and text, as a number in [0, 1), is
    below its cell's probability, so equal rows share a decision and a rerun
    repeats it.  A document without tokens weighs nothing and is kept (it costs
    no budget); a null source, language or text counts as ''.  A text counts
    whole, however long.  An empty table gives no rows.  Columns are found by
    their exact names; one called ``topic`` takes the place of the text's form."""
    slim = written(features(docs), "mix")
    return decided(slim, plan(slim, budget, temper), seed)


def sample(docs: DataFrame, columns: dict[str, str], budget: float = BUDGET) -> DataFrame:
    """The named columns of the kept documents; their texts aren't shuffled."""
    cells = plan(written(features(docs), "mix"), budget)
    rows = features(docs, {f"own_{c}": (c, t) for c, t in columns.items()})
    return decided(rows, cells).where("kept").select(*[F.col(f"own_{c}").alias(c) for c in columns])


def op2_rake_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("text_hash")

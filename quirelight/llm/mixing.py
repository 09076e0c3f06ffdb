"""Mixing of sources to target weights by iterative proportional fitting (raking) of sampling probabilities.

Tokens are summed by cell (source, language, topic). A document of a cell is kept with probability p = min(1, f g h), the factors of its source,
language and topic, so that the expected tokens of the *sample* have the target marginals and together meet the budget. Raking works
under the bound of 1 (capped raking): cells that would be wanted more than once are taken whole, and the others are raked to what is left.
Each source's factor solves its own target exactly, in one pass over its cells sorted by g h, on the executors; what the driver gathers in a round
are sums by language and topic, not by source, of which there may be very many. Languages and topics take Newton steps on
those sums. Rounds end when every marginal is met to CLOSE of the sample; targets that no sample can meet at once end them when STALL rounds have not
brought the distance down by a tenth (ROUNDS at most). target_gap says how far off the worst marginal is, as a share of the sample.
Documents are then kept by a hash of their id, so a repeated run keeps the same ones.

A target beyond all the tokens that a value has is lowered to them, and what is left goes to the others in proportion to their targets.

Defined results: null source, language or topic is a value of its own, unlike any other. Null text has no tokens; documents without tokens are
kept with probability budget. Rows without a doc_id take no part. Repeated rows are kept or left together. An empty table gives no rows. Columns
of the input that are named as one of the result's (in any case of letters) are replaced by it; a given topic may read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stage

ROUNDS, CLOSE, STALL = 200, 1e-4, 10
OUT = ("n_tokens", "topic", "weight", "probability", "kept", "target_gap")
#: Names of the columns that are added on the way.
S, L, T, P, K = "__mix_source", "__mix_lang", "__mix_topic", "__mix_probability", "__mix_key"
#: Cells of source, language and topic that are broadcast; of more, those with a larger share of the tokens than its inverse.
CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables that have none: tables, symbols, notes (under 400 characters), books (over 8000), else prose."""
    n = F.length(text)
    return F.when(F.contains(text, F.lit(" | ")), "tables").when(text.rlike(r"[*$%&#]{3}"), "symbols").when(n < 400, "notes").when(n > 8000, "books").otherwise("prose")


def _key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def tempered(total: dict, power: float) -> dict:
    """Target shares: tokens to a power below 1 lift the small ones."""
    raised = {k: v**power for k, v in total.items() if v > 0}
    s = sum(raised.values())
    return {k: v / s for k, v in raised.items()}


def filled(share: dict, have: dict, amount: float) -> dict:
    """amount dealt in proportion to share, none getting more than it has."""
    out = dict.fromkeys(have, 0.0)
    open_ = {k for k in have if share.get(k, 0) > 0}
    while open_:
        scale = (amount - sum(out.values())) / sum(share[k] for k in open_)
        full = {k for k in open_ if share[k] * scale >= have[k]}
        if not full:
            return out | {k: share[k] * scale for k in open_}
        out |= {k: have[k] for k in full}
        open_ -= full
    return out


def _source_factor(cells: str, target: str) -> str:
    """SQL for the factor f at which a source's cells, sorted by r = g h, give sum(n min(1, f r)) = target.

    If the first i cells are below the bound, f = (target - tokens of the rest) / sum(n r); the last i for which that keeps cell i below it is right.
    """
    return (
        f"aggregate({cells}, named_struct('a', 0D, 'm', 0D, 'f', 1D / {cells}[0].r), (s, c) -> named_struct('a', s.a + c.n * c.r, 'm', s.m + c.n, "
        f"'f', if(({target} - (_n - s.m - c.n)) * c.r <= (s.a + c.n * c.r) * (1D + 1e-12), ({target} - (_n - s.m - c.n)) / (s.a + c.n * c.r), s.f)), s -> s.f)"
    )


def step_of(target: float, whole: float, rest: float) -> float:
    """What a factor is multiplied by, given the tokens of cells taken whole and those expected of the rest."""
    if rest <= 0:
        return 1.0
    step = (target - whole) / rest
    return step if step > 0 else target / (whole + rest)


def ended(gaps: list[float]) -> bool:
    """Whether the rounds are over, given their distances from the targets."""
    return gaps[-1] < CLOSE or len(gaps) == ROUNDS or (len(gaps) > STALL and gaps[-1] > 0.9 * gaps[-1 - STALL])


def mix(docs: DataFrame, budget: float = 0.5, power: float = 0.7, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None, sources: DataFrame | None = None, topic: Column | None = None, seed: int = 0) -> DataFrame:
    """docs with n_tokens, topic, weight (tokens wanted for each token there is, at a budget of one), probability, kept and target_gap.

    budget: share of all tokens to keep. Targets: langs and topics as shares, sources as a table (source, share); where they are not given,
    shares are those of the tokens raised to power. Targets for values that do not occur are left out, and the rest scaled to one.
    """
    docs = docs.where("doc_id is not null")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    made = {"__mix_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), "__mix_form": topic if topic is not None else topic_of(text)}
    rows = docs.withColumns(made)
    rows = rows.withColumns({S: _key(F.col("source")), L: _key(F.col("lang")), T: _key(F.col("__mix_form"))})
    cells = stage.written(spark, rows.groupBy(S, L, T).agg(F.sum("__mix_tokens").alias("n")), "cells").where("n > 0")
    by = cells.groupBy(L, T).agg(F.sum("n").alias("n")).collect()  # languages x topics

    def result(rows: DataFrame, probability: Column, gap: float) -> DataFrame:
        u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
        rows = rows.withColumn(P, probability)
        kept = [c for c in docs.columns if c.lower() not in OUT]
        return rows.select(*(F.col(f"`{c}`") for c in kept), F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_form").alias("topic"), (F.col(P) / budget).alias("weight"), F.col(P).alias("probability"), (u < F.col(P)).alias("kept"), F.lit(gap).alias("target_gap"))

    if not by:
        return result(rows, F.lit(float(budget)), 0.0)
    total = sum(r["n"] for r in by)
    have_l, have_t = ({v: sum(r["n"] for r in by if r[c] == v) for v in {r[c] for r in by}} for c in (L, T))

    def shares(given: dict[str, float] | None, have: dict) -> dict:
        return tempered(have, power) if given is None else {"" if k is None else f"={k}": v for k, v in given.items()}

    share_l, share_t = shares(langs, have_l), shares(topics, have_t)
    each = cells.groupBy(S).agg(F.sum("n").alias("_n"), F.collect_list(F.struct(F.col(L).alias("l"), F.col(T).alias("t"), "n")).alias("cells"))
    if sources is None:
        each = each.withColumn("share", F.pow(F.col("_n").cast("double"), F.lit(power)))
    else:
        given = sources.groupBy(_key(F.col("source")).alias(S)).agg(F.sum(F.col("share").cast("double")).alias("share"))
        each = each.join(given, S, "left").na.fill(0.0, ["share"])
    each = stage.written(spark, each, "sources")
    # what all three sides can give
    able = [sum(have[k] for k in have if share.get(k, 0) > 0) for share, have in ((share_l, have_l), (share_t, have_t))]
    amount = min([budget * total, *able, float(each.where("share > 0").agg(F.sum("_n")).first()[0] or 0)])
    want_l, want_t = filled(share_l, have_l, amount), filled(share_t, have_t, amount)
    # the sources' targets: the same filling, with sums instead of lists
    scale, full = 0.0, None
    while amount > 0:
        got = each.agg(F.sum(F.when(F.col("share") * scale >= F.col("_n"), F.col("_n")).otherwise(0)), F.sum(F.when(F.col("share") * scale < F.col("_n"), F.col("share")).otherwise(0.0))).first()
        if got[0] == full or not got[1]:
            break
        full, scale = got[0], (amount - got[0]) / got[1]
    wanted = each.withColumn("want", F.least(F.col("share") * scale, F.col("_n").cast("double")))
    g, h = dict.fromkeys(want_l, 1.0), dict.fromkeys(want_t, 1.0)

    def fitted() -> DataFrame:
        lm, tm = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (g, h))
        r = F.transform("cells", lambda c: F.struct((lm[c["l"]] * tm[c["t"]]).alias("r"), c["n"].cast("double").alias("n"), c["l"].alias("l"), c["t"].alias("t")))
        out = wanted.withColumn("cells", F.array_sort(F.filter(r, lambda c: c["r"] > 0))).where(F.size("cells") > 0)
        out = out.withColumn("_n", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["n"]))
        out = out.withColumn("f", F.expr(_source_factor("cells", "want"))).select(S, "f", F.explode("cells").alias("c"))
        return out.select(S, F.col("c.l").alias(L), F.col("c.t").alias(T), "c.n", F.least(F.lit(1.0), F.col("f") * F.col("c.r")).alias("p"))

    gaps: list[float] = []
    while True:
        whole = F.col("p") >= 1
        sums = fitted().groupBy(L, T).agg(F.sum(F.when(whole, F.col("n")).otherwise(0.0)).alias("w"), F.sum(F.when(whole, 0.0).otherwise(F.col("n") * F.col("p"))).alias("m")).collect()
        mass = lambda c, v: sum(r["w"] + r["m"] for r in sums if r[c] == v)
        gap = max(abs(mass(c, v) - x) for c, want in ((L, want_l), (T, want_t)) for v, x in want.items()) / amount if amount else 0.0
        gaps.append(gap)
        if ended(gaps):
            break
        step = {v: step_of(x, sum(r["w"] for r in sums if r[L] == v), sum(r["m"] for r in sums if r[L] == v)) for v, x in want_l.items()}
        g = {v: x * step[v] for v, x in g.items()}
        h = {v: x * step_of(want_t[v], sum(r["w"] for r in sums if r[T] == v), sum(r["m"] * step[r[L]] for r in sums if r[T] == v)) for v, x in h.items()}
    weights = stage.written(spark, fitted().select(S, L, T, "p"), "weights")
    # a cell with tokens that is in no fit is wanted by no side; documents of cells without tokens go by the budget alone
    known = cells.join(weights, [S, L, T], "left").withColumn("__mix_cell", F.lit(True))
    known = stage.written(spark, known.select(F.struct(S, L, T).alias(K), "p", "n", "__mix_cell"), "cell-weights")
    count, tokens = known.agg(F.count("*"), F.sum("n")).first()
    often, rest = known.drop("n"), None
    if count > CELLS:  # then only large cells are broadcast, and their documents stay where they are
        often, rest = (known.where(F.col("n") * CELLS > tokens).drop("n"), known.where(F.col("n") * CELLS <= tokens).drop("n"))
    rows = rows.withColumn(K, F.struct(S, L, T)).join(F.broadcast(often), K, "left")
    if rest is not None:
        cell = F.col("__mix_cell")
        rows = rows.where(cell).unionByName(rows.where(cell.isNull()).drop("p", "__mix_cell").join(rest, K, "left"))
    return result(rows, F.coalesce("p", F.when(F.col("__mix_cell"), 0.0).otherwise(float(budget))), gap)

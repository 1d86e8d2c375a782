"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source s has a token constraint: its documents' rates r must satisfy sum(r * size) = target. Among rates between 0
and the repeat limit R, those nearest the prior rate R/2 in entropy are r = R * sigmoid(lambda_s * size / scale_s); lambda is the
maximum of a concave dual, found by Newton steps whose gradient and curvature are sums over all documents. Documents of
one source and size have one rate, so the sums run over a table of (source, size) counts. The rates are then rounded to
whole copies: the whole part is taken, and the fraction by order sampling, where documents with the smallest
hash / fraction get one more copy until the source's words reach its target. The cut is found by counting words in
bins of that score, refined once, so no source is sorted or gathered. What is then left of the target is filled
by further draws among documents of at most a part of the rest.

All that a document's copies depend on is its size, its uniform number and one row of state for its source (multiplier and cuts).
So each pass is a scan of the sizes joined to the state, and the texts themselves meet the state once, in mixed().

Defined cases: a null text has size 0 and gets no copy; a very long text is one document like any other; a null source is a source of
its own, last in order; rows that repeat an id and a text share one fate; documents of equal score fall on the same side of a cut; a source
without words has target 0; an empty table gives no rows; further columns are ignored, and columns whose names begin with `_mix` are not
allowed in mixed(). A target whose multiplier isn't found in NEWTON_STEPS steps raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

NEWTON_STEPS = 100
BINS = 1024
TOLERANCE = 1e-4
#: Draws after the first: each goes over documents of at most the n-th part of what is left.
FILLS = (4, 4, 2, 1)


def _size() -> Column:
    """The words of a text."""
    return F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")


def _uniform() -> Column:
    """A uniform number in (0, 1) that depends on id and text alone."""
    return (F.xxhash64(F.lit("mix"), "doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def sizes(docs: DataFrame) -> DataFrame:
    """source, size, u of each document."""
    return docs.select("source", _size().alias("size"), _uniform().alias("u"))


def targets(per_source: DataFrame, weights: tuple[float, ...], budget: float, limit: float) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last, weigh weights in turn and share budget times
    all sizes; a target stops at limit times its source's size and the excess is shared anew by weight until none is above.

    Filling up in order of size / weight gives the same result in one pass: with the sources sorted by it, the k
    first are full where each one's share of what the earlier ones leave is above its limit; the first that isn't sets
    the level of the rest. One row a source is read.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.select("source", "source_size", w.alias("w"), (F.sum("source_size").over(Window.partitionBy()) * budget).alias("all_budget"))
    s = s.withColumn("cap", F.col("source_size") * limit).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all_budget") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level).withColumn("full", F.col("level") >= F.col("ratio"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return s.withColumn("final", final).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def rate(lam: Column, size: Column, scale: Column, limit: float) -> Column:
    return F.lit(limit) / (1 + F.exp(-F.greatest(F.least(lam * size / scale, F.lit(700.0)), F.lit(-700.0))))


def _dual(known: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """s, source_size, target, scale, lam: the per-source state after guarded Newton steps; each step is one distributed sum."""
    hist = common.settle(known.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)))
    state = state.select("s", "source_size", "target", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("err"))
    state = common.settle(state, "mix-state")
    for _ in range(NEWTON_STEPS):
        # null-safe: the null source is balanced like any other.
        at = hist.join(common.small(state), F.col("source").eqNullSafe(F.col("s")))
        r = rate(F.col("lam"), F.col("size"), F.col("scale"), limit)
        sums = at.groupBy(F.col("s").alias("h")).agg(F.sum(F.col("n") * F.col("size") * r).alias("have"), F.sum(F.col("n") * F.col("size") * F.col("size") * r * (1 - r / limit) / F.col("scale")).alias("bend"))
        j = state.join(sums, F.col("h").eqNullSafe(F.col("s")), "left").drop("h").fillna(0.0, ["have", "bend"])
        gap = F.col("target") - F.col("have")
        j = j.withColumns({"lo": F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap <= 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") + gap / F.greatest(F.col("bend"), F.lit(1e-12))
        inside = (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("lam")) <= 4 + 4 * F.abs(F.col("lam")))
        bounded = F.greatest(F.least(step, F.col("lam") + 4 + 4 * F.abs(F.col("lam"))), F.col("lam") - 4 - 4 * F.abs(F.col("lam")))
        halved = F.when((bounded > F.col("lo")) & (bounded < F.col("hi")), bounded).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = F.when(inside, step).otherwise(halved)
        err = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        # A target at the limit has no finite multiplier: its rates are the limit itself.
        full = F.col("target") >= F.col("source_size") * limit
        last, state = state, common.settle(j.select("s", "source_size", "target", "scale", F.when(err < TOLERANCE, F.col("lam")).otherwise(new).alias("lam"), "lo", "hi", F.when(full, F.lit(0.0)).otherwise(err).alias("err")), "mix-state", worst=F.max("err"))
        common.release(last)
        worst = state._watched["worst"]
        if worst is None or worst < TOLERANCE:
            common.release(hist)
            return state
    raise RuntimeError(f"no multipliers within {TOLERANCE} of the targets after {NEWTON_STEPS} steps; the worst is off by {worst}")


def _copies(rows: DataFrame, limit: int, draws: int, mark: str = "") -> DataFrame:
    """rows with copies_, the copies after so many draws, and v_, the score by which the next draw takes documents (null: never), from a
    document's size and u beside its source's state; all names begin with mark. Each step is a projection of its own: written into each
    other, the expressions would double with every draw."""
    c = lambda name: F.col(mark + name)
    full = c("target") >= c("source_size") * limit
    rows = rows.withColumn(f"{mark}r_", F.when(c("size") == 0, F.lit(0.0)).when(full, F.lit(float(limit))).otherwise(rate(c("lam"), c("size"), c("scale"), limit)))
    rows = rows.withColumn(f"{mark}copies_", F.floor(c("r_")))
    # In [0, 1], rising with u / fraction; a document without a fraction is never drawn.
    rows = rows.withColumn(f"{mark}v_", F.when(c("r_") > c("copies_"), c("u") / (c("u") + (c("r_") - c("copies_")))))
    for i in range(draws):
        rows = rows.withColumn(f"{mark}copies_", c("copies_") + F.coalesce((c("v_") < c(f"cut{i}")).cast("int"), F.lit(0)))
        # Another order of the same documents, for those that may have one more copy.
        may = (c("copies_") < limit) & (c("size") > 0) & (c("size") * (*FILLS, 1)[i] <= c(f"rest{i + 1}"))
        rows = rows.withColumn(f"{mark}v_", F.when(may, F.pmod(c("u") * (i + 3) + 0.5, F.lit(1.0))))
    return rows.withColumn(f"{mark}copies_", c("copies_").cast("int"))


def state(known: DataFrame, weights: tuple[float, ...], budget: float, limit: int) -> DataFrame:
    """One settled row for each source of known(source, size, u): its target, multiplier, and the cuts of all draws."""
    per = known.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = common.settle(per, "mix-sources")
    goal = targets(per, weights, budget, limit).select(F.col("source").alias("s"), "target")
    at = common.settle(per.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("source"), "mix-targets")
    at = common.as_settled(dual := _dual(known, at, limit), dual.drop("lo", "hi", "err"))
    whole = _copies(known.join(common.small(at), F.col("source").eqNullSafe(F.col("s"))), limit, 0)
    used = whole.groupBy(F.col("s").alias("z")).agg(F.sum(F.col("copies_") * F.col("size")).alias("used"))
    at = common.settle(at.join(used, F.col("s").eqNullSafe(F.col("z"))).withColumn("rest0", F.col("target") - F.col("used")).drop("z", "used"), "mix-state")
    for i in range(1 + len(FILLS)):
        at = _draw(known, at, limit, i, 2 if i == 0 else 1)
    return at


def _draw(known: DataFrame, at: DataFrame, limit: int, i: int, rounds: int) -> DataFrame:
    """The state with cut{i} and rest{i + 1}: one more copy goes to the documents whose score is below the cut, as long as
    their source has words left. Each round narrows the cut by BINS bins; a window sees BINS rows a source."""
    cut, width = common.as_settled(at, at.withColumns({"cut": F.lit(0.0), "left": F.col(f"rest{i}")})), 1.0
    for _ in range(rounds):
        width /= BINS
        part = _copies(known.join(common.small(cut), F.col("source").eqNullSafe(F.col("s"))), limit, i)
        # Those beyond the bins are counted as bin -1 of no words; a filter would be pushed down, through all projections.
        within = F.coalesce((F.col("v_") >= F.col("cut")) & (F.col("v_") < F.col("cut") + width * BINS), F.lit(False))
        part = part.select("s", "size", "v_", "cut", within.alias("in_"))
        bins = part.groupBy("s", F.when(F.col("in_"), F.least(F.floor((F.col("v_") - F.col("cut")) / width), F.lit(BINS - 1))).otherwise(F.lit(-1)).alias("bin")).agg(F.sum(F.when(F.col("in_"), F.col("size")).otherwise(F.lit(0))).alias("words"))
        run = Window.partitionBy("s").orderBy("bin")
        upto = bins.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("s", "b").join(common.small(cut.select("s", "left"), of=cut), F.col("b").eqNullSafe(F.col("s")))
        within = upto.filter(F.col("upto") <= F.col("left")).groupBy(F.col("b").alias("z")).agg(F.max("upto").alias("took"), (F.max("bin") + 1).alias("bins"))
        moved = {"left": F.col("left") - F.coalesce("took", F.lit(0)), "cut": F.col("cut") + width * F.coalesce("bins", F.lit(0))}
        last, cut = cut, common.settle(cut.join(within, F.col("s").eqNullSafe(F.col("z")), "left").withColumns(moved).drop("z", "took", "bins"), "mix-cut")
        common.release(last)
    return common.renamed(cut, {"cut": f"cut{i}", "left": f"rest{i + 1}"})


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, limit: int = 2) -> DataFrame:
    """docs(doc_id, text, source, ...) with _mix_size, _mix_source_size, _mix_target and _mix_copies, the times the mix takes the row."""
    known = common.settle(sizes(docs), "mix-sizes")
    at = state(known, weights, budget, limit)
    common.release(known)
    at = common.renamed(at, {c: f"_mix_{c}" for c in at.columns})
    rows = docs.withColumns({"_mix_size": _size(), "_mix_u": _uniform()}).join(common.small(at), F.col("source").eqNullSafe(F.col("_mix_s")))
    return _copies(rows, limit, 1 + len(FILLS), "_mix_").select(*docs.columns, "_mix_size", "_mix_source_size", "_mix_target", F.col("_mix_copies_").alias("_mix_copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))

"""Weighted fair queueing over sources (DataFrame functions only).

Each source is a flow whose documents arrive in a keyed shuffle. A document's
virtual finish time is its source's cumulative size up to and including it,
divided by the source's target. Serving all flows in order of finish time
interleaves them in proportion to their targets; the order is a global range
sort, cut at the total budget. A source whose target exceeds its size is
served twice round (``max_copies``), so its second round's finish times
simply go on. At the cut every flow is in the middle of one document: it
is served in part, up to the cut's virtual time, so that each source ends
within a word of its target.

Prefix sums are two-level: rows fall into 1024 slices by the top bits of the
shuffle key (for the order inside a source) or by virtual time (for the global
order), slice totals are summed by a window over at most 1024 rows per source,
and only rows of one slice meet in a sort. A source with a third of all rows
is so shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import WORD, stage

SLICES = 1024


def word_count(col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget_share: float = 1.5, max_copies: int = 2,
                   weights: tuple = (3, 1, 2)) -> DataFrame:
    """``source, weight, source_size, target`` from ``source, source_size``.

    Sources by code point (null last) take ``weights`` in turn. Targets share
    the budget by weight; none exceeds ``max_copies`` times its source's size,
    and what it leaves is shared by weight among the others until none is
    above. That fixed point is ``min(cap, level * weight)``: with sources in
    ascending ``cap / weight`` the level is the first ``(budget - caps before)
    / (weights from here on)`` not above the source's own ratio. One row per
    source passes through one task here, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(budget_share))) \
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(onward)) \
        .withColumn("level", F.min(F.when(
            F.col("level") <= F.col("cap") / F.col("weight"),
            F.struct(F.row_number().over(rising).alias("place"), "level"))).over(whole)["level"])
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "weight", "source_size", share.cast("double").alias("target"),
                    F.floor("budget").cast("long").alias("budget"))


def fair_mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", budget_share: float = 1.5, max_copies: int = 2,
             weights: tuple = (3, 1, 2)) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, finish, mix_start``.

    One row per input row. ``size`` counts words (null text: 0). ``taken`` is
    how many of its words the mix takes, copies counted, at most ``max_copies``
    times its size; ``finish`` is the virtual finish time of its first copy in
    the mix and ``mix_start`` how many words of the mix come before that copy
    (both null where nothing is taken). Empty texts and sources without words
    take nothing. Null sources form one source. Repeated rows are separate
    documents. Reruns agree: the shuffle key is a hash of id, size and seed.
    """
    return _queue(docs, seed, id_col, text_col, source_col, budget_share, max_copies, weights)


def draw_mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", **kw) -> DataFrame:
    """The mixed documents: every row of ``docs``, all columns kept, as often as
    the mix takes it. A copy that the mix cuts off counts if at least half of
    its words are in. Texts without words take no part and are left out.

    Mixing is decided per row on ids and sizes; the copies are then joined to
    the rows on the id and the size, numbered among rows that share both.
    """
    plan = fair_mix(docs, seed, id_col, text_col, source_col, **kw)

    def keys(id_, size, source):  # null-safe as plain equalities: one exchange serves join and window
        return {"__id": F.coalesce(id_, F.lit(0)), "__noid": id_.isNull(), "__size": size,
                "__source": F.coalesce(source, F.lit("")), "__nosource": source.isNull()}
    mine = keys(F.col(id_col).cast("long"), word_count(text_col), F.col(source_col).cast("string"))
    names = list(mine)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    plan = plan.where("size > 0").select(
        *[c.alias(n) for n, c in keys(F.col("doc_id"), F.col("size"), F.col("source")).items()],
        times.alias("__times")).where("__times > 0").groupBy(*names).agg(
        F.sort_array(F.collect_list("__times"), False).alias("__times"))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(text_col)))
    return docs.withColumns(mine).join(plan, names) \
        .withColumn("__n", F.coalesce(F.get("__times", nth - 1), F.lit(0))) \
        .where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))) \
        .select(*docs.columns)


def _queue(docs, seed, id_col, text_col, source_col, budget_share, max_copies, weights) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("size"),
                    F.col(source_col).cast("string").alias("source"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", "size").cast("binary"))
    d = d.withColumn("h", F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long"))  # 60 bits
    d = stage(d, "mix-sizes")
    targets = stage(source_targets(
        d.groupBy("source").agg(F.sum("size").alias("source_size")),
        budget_share, max_copies, weights), "mix-targets")

    # Place in the source's shuffled order: slice offset + running sum in the slice.
    d = d.withColumn("slice", F.shiftright("h", 60 - SLICES.bit_length() + 1).cast("int"))
    totals = d.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"),
                            F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("slice_start")) \
        .join(targets.withColumnRenamed("source", "t_source"),
              F.col("o_source").eqNullSafe(F.col("t_source")))
    run = Window.partitionBy("source", "slice").orderBy("h", "doc_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = d.withColumn("end_in", F.sum("size").over(run)) \
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source"))
              & (F.col("slice") == F.col("o_slice"))) \
        .select("doc_id", "size", "source", "h", "source_size", "target", "budget",
                (F.col("slice_start") + F.col("end_in") - F.col("size")).alias("start"))

    # The part served in each round (copy), and its virtual finish time.
    def served(c):
        begin = F.col("start") + F.lit(c) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"),
                           F.least(F.col("size"), F.round("target").cast("long") - begin))
        at = F.when(words > 0, (begin + words) / F.col("target")).otherwise(F.lit(2.0))  # not served
        return F.struct(F.lit(c).alias("copy"), words.alias("words"), at.alias("at"))

    placed = stage(placed.withColumn("parts", F.array(*[served(c) for c in range(max_copies)])),
                   "mix-placed").withColumn("row", F.monotonically_increasing_id())

    # Global order of all copies by finish time, cut at the total budget.
    first = F.col("part.copy") == 0
    queue = placed.select("*", F.explode("parts").alias("part")) \
        .where(first | (F.col("part.words") > 0)) \
        .withColumn("tick", F.floor(F.col("part.at") * SLICES).cast("int")) \
        .withColumn("fine", F.when(F.col("part.words") == 0, F.pmod("h", F.lit(SLICES))).otherwise(
            F.floor((F.col("part.at") * SLICES - F.col("tick")) * SLICES)).cast("int"))
    fine = queue.groupBy("tick", "fine").agg(F.sum("part.words").alias("n"))
    ticks = fine.groupBy("tick").agg(F.sum("n").alias("n"))
    past = (Window.unboundedPreceding, -1)
    tick_start = ticks.select("tick", F.coalesce(F.sum("n").over(  # at most SLICES + 2 rows
        Window.orderBy("tick").rowsBetween(*past)), F.lit(0)).alias("tick_start"))
    starts = fine.join(tick_start, "tick").select(
        "tick", "fine", (F.col("tick_start") + F.coalesce(F.sum("n").over(
            Window.partitionBy("tick").orderBy("fine").rowsBetween(*past)), F.lit(0)))
        .alias("fine_start"))
    order = Window.partitionBy("tick", "fine").orderBy("part.at", "h", "doc_id", "part.copy", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("end_in", F.sum("part.words").over(order)).join(starts, ["tick", "fine"]) \
        .withColumn("mix_start", F.col("fine_start") + F.col("end_in") - F.col("part.words")) \
        .withColumn("words", F.greatest(F.lit(0).cast("long"),
                                        F.least("part.words", F.col("budget") - F.col("mix_start"))))
    one = [F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")]
    out = queue.groupBy("row").agg(
        *one, F.sum("words").alias("taken"),
        F.min(F.when(F.col("words") > 0, F.col("part.at"))).alias("finish"),
        F.min(F.when(F.col("words") > 0, F.col("mix_start"))).alias("mix_start"))
    return out.drop("row")

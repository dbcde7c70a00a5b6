"""Segmentation of token streams into units: W1-W11, J1, J2, S9, D1, D2, D8.

A token stream is ``file, pos, token, line`` (``pos`` = row number in the
file, kept when rows are dropped). Markers are picked by two predicates
(default: token ``BEGIN_METHOD`` / ``END_METHOD``).

Unit membership (J2) is computed without a range join: the k-th begin and
the k-th end are both in position order, so the units holding position ``p``
are exactly ``k`` in ``[#ends before p + 1, #begins up to p]``. Two running
counts per file give that interval, and the row is repeated once per holding
unit (the nesting depth), so the work is linear in the stream.

Joins of two sides that grow with the stream carry a ``merge`` hint: sorted (file, pos)
columns are a few bits a row in Parquet, so the size of a stored table says too little,
and Spark would broadcast millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T

BEGIN = "BEGIN_METHOD"
END = "END_METHOD"

# Fixed values of the reference's parse errors and marker ids
REASON_EMPTY = "no functions found!"
REASON_MISMATCH = "has different number of start and end in parsed!!!"
REASON_NO_LINE = "no tokenized found!"
REASON_NO_START = "no start line"
MARKER_KIND = {"BEGIN_METHOD": 8001, "END_METHOD": 8002, "BEGIN_BLOCK": 8003, "END_BLOCK": 8004}


def _pred(p, default: str) -> Column:
    if p is None:
        return F.col("token") == default
    return p if isinstance(p, Column) else F.col("token") == p


def drop_missing(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """Drop rows whose token is missing; ``pos`` is kept."""
    return tokens.where(~T.is_missing_token(token_col))


def marker_check(tokens: DataFrame, begin=None, end=None, file_col: str = "file",
                 files: DataFrame | None = None) -> DataFrame:
    """W1 + S9: per file begin/end counts, lines present, and the parse error.

    Order of the checks is the reference's: no rows, unequal counts, no
    markers, no line anywhere. A file without rows is known only from
    ``files`` (one row per file that was read); without it none is reported.
    """
    b, e = _pred(begin, BEGIN), _pred(end, END)
    counts = ["n_rows", "n_begin", "n_end", "n_line"]
    agg = tokens.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(b).alias("n_begin"),
        F.count_if(e).alias("n_end"),
        F.count("line").alias("n_line"))
    if files is not None:
        agg = files.select(file_col).join(agg, file_col, "left").na.fill(0, counts)
    reason = (F.when(F.col("n_rows") == 0, F.lit(REASON_EMPTY))
              .when(F.col("n_begin") != F.col("n_end"), F.lit(REASON_MISMATCH))
              .when(F.col("n_begin") == 0, F.lit(REASON_EMPTY))
              .when(F.col("n_line") == 0, F.lit(REASON_NO_LINE)))
    return agg.withColumn("reason", reason)


def parse_errors(tokens: DataFrame, begin=None, end=None, file_col: str = "file",
                 files: DataFrame | None = None, read_errors: DataFrame | None = None) -> DataFrame:
    """``file, reason`` for files that yield no units.

    ``read_errors`` (``file, reason``) are the files that could not be read; each file
    has one row, the reader's reason first. ``files`` is the list of all files.
    """
    if files is not None and read_errors is not None:
        files = files.join(read_errors, file_col, "left_anti")
    found = marker_check(tokens, begin, end, file_col, files).where(F.col("reason").isNotNull()) \
        .select(file_col, "reason")
    if read_errors is None:
        return found
    return read_errors.select(file_col, "reason").unionByName(
        found.join(read_errors, file_col, "left_anti"))


def pair_markers(tokens: DataFrame, begin=None, end=None, file_col: str = "file") -> DataFrame:
    """W2 + J1: k-th begin with k-th end of each sound file.

    ``file, k, begin_pos, end_pos`` (``k`` from 1). Not a nesting match:
    nested units overlap, as in the reference. ``k`` is a distributed running
    count over the marker rows (no one-task window per file).
    """
    from kindred.functions.rank import running_sums
    b, e = _pred(begin, BEGIN), _pred(end, END)
    ok = marker_check(tokens, begin, end, file_col).where(F.col("reason").isNull()).select(file_col)
    marks = tokens.where(b | e).select(file_col, "pos", b.cast("int").alias("__isb"))
    marks = running_sums(marks, file_col, "pos", {"__kb": F.col("__isb"), "__ke": 1 - F.col("__isb")})
    bs = marks.where(F.col("__isb") == 1).select(file_col, F.col("__kb").cast("int").alias("k"),
                                                 F.col("pos").alias("begin_pos"))
    es = marks.where(F.col("__isb") == 0).select(file_col, F.col("__ke").cast("int").alias("k"),
                                                 F.col("pos").alias("end_pos"))
    return bs.join(es.hint("merge"), [file_col, "k"]).join(ok, file_col, "left_semi")


def unit_rows(tokens: DataFrame, begin=None, end=None, file_col: str = "file",
              scan: str = "distributed") -> DataFrame:
    """Every token row of every unit (``file, k, pos, token, line``), in
    linear time from running marker counts (see module note).

    ``scan='distributed'`` computes the running counts with a range sort and
    per-partition offsets (one huge file is spread over many tasks);
    ``scan='window'`` uses one window per file (fewer jobs for small files).
    """
    from kindred.functions.rank import running_sums
    b, e = _pred(begin, BEGIN), _pred(end, END)
    ok = marker_check(tokens, begin, end, file_col).where(F.col("reason").isNull()).select(file_col)
    x = tokens.join(ok, file_col, "left_semi")
    if scan == "distributed":
        x = running_sums(x.withColumn("__isb", b.cast("int")).withColumn("__ise", e.cast("int")),
                         file_col, "pos", {"__b": F.col("__isb"), "__ecum": F.col("__ise")})
        x = x.withColumn("__e", F.col("__ecum") - F.col("__ise")).drop("__isb", "__ise", "__ecum")
    else:
        w = Window.partitionBy(file_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("__b", F.sum(b.cast("int")).over(w)) \
            .withColumn("__e", F.sum(e.cast("int")).over(w) - e.cast("int"))
    x = x.where(F.col("__b") >= F.col("__e") + 1)
    x = x.withColumn("k", F.explode(F.sequence(F.col("__e") + 1, F.col("__b"))))
    return x.drop("__b", "__e")


def unit_text(tokens: DataFrame, begin=None, end=None, file_col: str = "file",
              normalize: bool = True, units: DataFrame | None = None) -> DataFrame:
    """W8 (+ P3): tokens of each unit joined by spaces in position order.

    Units whose end precedes their begin get empty text (an empty slice). ``units`` are
    those of ``pair_markers``, if they are known.
    """
    rows = unit_rows(tokens, begin, end, file_col)
    units = pair_markers(tokens, begin, end, file_col) if units is None else units
    agg = rows.groupBy(file_col, "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                 lambda s: s["token"]), " ").alias("raw_text"))
    out = units.join(agg.hint("merge"), [file_col, "k"], "left").withColumn(
        "raw_text", F.coalesce("raw_text", F.lit("")))
    if normalize:
        out = out.withColumn("text", T.normalize("raw_text"))
    return out


def last_line(tokens: DataFrame, file_col: str = "file") -> DataFrame:
    """Last non-null line of each file."""
    return tokens.groupBy(file_col).agg(
        F.max_by("line", F.when(F.col("line").isNotNull(), F.col("pos"))).alias("last_line"))


def unit_lines(tokens: DataFrame, begin=None, end=None, file_col: str = "file",
               units: DataFrame | None = None) -> DataFrame:
    """W3 + W4: ``start_line`` = line of the row at position begin+1 (by row
    label, as the reference reads it); ``end_line`` = line at position end+2 if
    that row exists with a line, else the file's last line (D2). A unit with no
    start line gets ``reason = 'no start line'`` (D8) instead of failing. ``units`` as in
    ``unit_text``.
    """
    units = pair_markers(tokens, begin, end, file_col) if units is None else units
    starts = tokens.select(file_col, (F.col("pos") - 1).alias("begin_pos"),
                           F.col("line").alias("start_line"))
    ends = tokens.select(file_col, (F.col("pos") - 2).alias("end_pos"), F.col("line").alias("l2"))
    out = units.join(starts.hint("merge"), [file_col, "begin_pos"], "left") \
        .join(ends.hint("merge"), [file_col, "end_pos"], "left") \
        .join(last_line(tokens, file_col), file_col, "left")
    return out.select(
        file_col, "k", "begin_pos", "end_pos", "start_line",
        F.coalesce("l2", "last_line").alias("end_line"),
        F.when(F.col("start_line").isNull(), F.lit(REASON_NO_START)).alias("reason"))


def fill_marker_lines(tokens: DataFrame, file_col: str = "file", reach: int = 7,
                      begins=("BEGIN_METHOD", "BEGIN_BLOCK"),
                      ends=("END_METHOD", "END_BLOCK")) -> DataFrame:
    """W6 + W7: end markers take the nearest earlier line within ``reach`` rows,
    then begin markers the nearest later line within ``reach`` rows (of the
    updated column); markers get kind ids 8001-8004 and column 0.

    Rows get their place in the file from a distributed running count; each
    marker with no line looks its ``reach`` neighbours up with an equi-join on
    (file, place), so a huge file is never one task.
    """
    from kindred.functions.rank import running_sums
    x = running_sums(tokens, file_col, "pos", {"__rk": F.lit(1)})

    def fill(df: DataFrame, which, sign: int) -> DataFrame:
        need = df.where(F.col("token").isin(list(which)) & F.col("line").isNull()) \
            .select(file_col, "__rk", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("__d"))
        src = df.where(F.col("line").isNotNull()).select(
            file_col, F.col("__rk").alias("__src"), F.col("line").alias("__l"))
        hit = need.join(src, (need[file_col] == src[file_col]) &
                        (src["__src"] == need["__rk"] + sign * need["__d"])) \
            .groupBy(need[file_col].alias(file_col), "__rk").agg(F.min_by("__l", "__d").alias("__fill"))
        return df.join(hit, [file_col, "__rk"], "left").withColumn(
            "line", F.coalesce("line", "__fill")).drop("__fill")

    x = fill(x, ends, -1)
    x = fill(x, begins, +1)
    kind = F.col("kind")
    for name, code in MARKER_KIND.items():
        kind = F.when(F.col("token") == name, F.lit(code)).otherwise(kind)
    is_marker = F.col("token").isin(list(MARKER_KIND))
    return x.withColumn("kind", kind).withColumn(
        "col", F.when(is_marker, F.lit(0)).otherwise(F.col("col"))).drop("__rk")


def islands(df: DataFrame, part_col: str, order_cols, value_col: str,
            min_length: int = 0) -> DataFrame:
    """Runs of equal consecutive values; keep runs longer than ``min_length``.

    ``part, run, value, start, end, length`` (start/end = first/last order
    key). A row's place comes from a distributed running count, its
    predecessor from an equi-join on (part, place - 1), the run id from a
    running sum of change flags; runs are then grouped with a map-side combine.
    """
    from kindred.functions.rank import running_sums
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    first = order_cols[0]
    x = df.select(part_col, F.struct(*order_cols).alias("__at"), F.col(first).alias("__first"), value_col)
    x = running_sums(x, part_col, "__at", {"__rk": F.lit(1)})
    prev = x.select(F.col(part_col), (F.col("__rk") + 1).alias("__rk"), F.col(value_col).alias("__prev"))
    x = x.join(prev, [part_col, "__rk"], "left").withColumn(
        "__chg", F.when(F.col("__prev").eqNullSafe(F.col(value_col)) & (F.col("__rk") > 1), 0).otherwise(1))
    x = running_sums(x, part_col, "__at", {"run": F.col("__chg")})
    out = x.groupBy(part_col, "run").agg(
        F.first(value_col).alias("value"),
        F.min("__first").alias("start"), F.max("__first").alias("end"),
        F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") > min_length)


def position_in_cluster(df: DataFrame, cluster_col: str = "cluster_id",
                        order_col: str = "leaf_rank") -> DataFrame:
    """0-based place of each unit in its cluster's order.

    A global rank over (cluster, order) from a range-partitioned sort, minus
    the rank of the cluster's first member: a cluster holding a third of all
    rows is still spread over many tasks.
    """
    from kindred.functions.rank import global_row_number
    ranked = global_row_number(df, F.asc(cluster_col), F.asc(order_col), name="__r")
    first = ranked.groupBy(cluster_col).agg(F.min("__r").alias("__f"))
    return ranked.join(first, cluster_col).withColumn(
        "position", (F.col("__r") - F.col("__f")).cast("long")).drop("__r", "__f")

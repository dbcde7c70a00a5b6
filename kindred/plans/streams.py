"""Token streams built from the driver tables for the segmentation operators.

* conversations: one stream per ``conv_id``; a turn is a row (``pos`` = turn,
  ``line`` = turn, token = its text); ``user`` turns open a unit, ``assistant``
  turns close it.
* pages: the html is cut into tags and text runs; ``<p ...>`` opens and
  ``</p>`` closes; ``line`` counts the newlines before the piece.
* events: one stream per ``user_id`` in ``event_id`` order; event types play
  the marker names (signup/purchase = method begin/end, view/click = block
  begin/end), markers carry no line, ``value`` is the line of other rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.rank import running_sums
from kindred.operators.segment import drop_missing
from kindred.session import scratch_path
from kindred.sources import files as FS
from kindred.sources import records as R
from kindred.sources.tables import load

def CONV_BEGIN():
    return F.col("role") == "user"


def CONV_END():
    return F.col("role") == "assistant"


def PAGE_BEGIN():
    return F.col("token").rlike(r"^<p[\s>]")


def PAGE_END():
    return F.col("token") == "</p>"


NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # file name of rows without a conversation
SOURCE_BYTES = 1 << 26  # of a source file of ``unit_slices``
TAG_PATTERN = r"<[^>]*>|[^<]+"

# Fixed mapping of event types to the reference's marker names
EVENT_MARKERS = {"signup": "BEGIN_METHOD", "purchase": "END_METHOD",
                 "view": "BEGIN_BLOCK", "click": "END_BLOCK"}


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    t = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"),
                 F.col("text").alias("token"), F.col("turn").alias("line"), "role")
    return drop_missing(t)


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages", "page_id", "html").repartition("page_id")
    x = p.select(F.col("page_id").alias("file"),
                 F.posexplode(F.regexp_extract_all("html", F.lit(TAG_PATTERN), 0)).alias("pos", "token"))
    nl = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    x = running_sums(x.withColumn("__nl", nl), "file", "pos", {"__cum": F.col("__nl")})
    return x.withColumn("line", (F.col("__cum") - F.col("__nl")).cast("long")) \
        .select("file", F.col("pos").cast("long"), "token", "line")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    token = F.col("event_type")
    for k, v in EVENT_MARKERS.items():
        token = F.when(F.col("event_type") == k, F.lit(v)).otherwise(token)
    is_marker = F.col("event_type").isin(list(EVENT_MARKERS))
    return e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("pos"), token.alias("token"),
        F.when(is_marker, F.lit(None).cast("double")).otherwise(F.col("value")).alias("line"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("kind"),
        F.minute("ts").cast("int").alias("col"))


def token_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV token files of ``conversations``: a file per bucket of 8, a turn a row.

    Cells as a CSV writer writes them (token quoted, quotes doubled); some rows end
    with CR LF and some are followed by a blank line.
    """
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", quoted, F.coalesce(F.length("role").cast("string"), F.lit("")),
                      F.coalesce(F.col("turn").cast("string"), F.lit("")), (F.col("conv_id") % 5).cast("string"))
    end = F.when(F.col("turn") % 3 == 1, F.lit("\r")).when(F.col("turn") % 3 == 2, F.lit("\n")).otherwise(F.lit(""))
    at = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    c.select((F.col("conv_id") % 8).alias("bucket"), "conv_id", "turn", F.concat(row, end).alias("value")) \
        .repartition(8, "bucket").sortWithinPartitions("bucket", "conv_id", "turn") \
        .select("bucket", "value").write.partitionBy("bucket").text(at)
    return f"{at}/bucket=*"


def turn_files(spark: SparkSession, sf_dir: str):
    """``(lines, files)``: every conversation as a token file of bare, unquoted lines.

    A turn is a marker row (BEGIN_METHOD for the user's, else END_METHOD; the turn
    is its line), then the lines of its text as they are.
    """
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    mark = F.concat(F.when(F.col("role") == "user", F.lit("BEGIN_METHOD,8001,")).otherwise(F.lit("END_METHOD,8002,")),
                    F.col("turn").cast("string"), F.lit(",0"))
    rows = c.select(F.col("conv_id").alias("file"), "turn", F.posexplode(F.concat(
        F.array(mark), F.split(F.coalesce("text", F.lit("")), "\n"))).alias("k", "value"))
    lines = rows.select("file", (F.col("turn") * 1_000_000 + F.col("k")).alias("pos"), "value")
    return lines, c.select(F.col("conv_id").alias("file")).distinct()


def unit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files on disk, their lines stored with a directory, and
    the middle half of each document's lines read back as its unit.

    Documents go to four folders (``file``), in files of about ``SOURCE_BYTES``: a task writes few."""
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    at = scratch_path(spark, f"sources-{uuid.uuid4().hex}")
    # a document per line, its own breaks kept: the file's lines are all documents' lines
    named = d.select((F.col("doc_id") % 4).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    size = named.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    parts = max(1, math.ceil(size / 4 / SOURCE_BYTES))
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    named.repartition(4 * parts, "bucket", "part").sortWithinPartitions("bucket", "part", "doc_id") \
        .select("bucket", "part", "value").write.partitionBy("bucket", "part").text(f"{at}/text")
    R.store_lines(FS.read_source_lines(spark, f"{at}/text/bucket=*/part=*"), f"{at}/lines")
    bucket, part = (F.regexp_extract("file", rf"{name}=(\d+)", 1).cast("long") for name in ("bucket", "part"))
    stored = spark.read.parquet(f"{at}/lines").withColumn("file", bucket * parts + part)
    n = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1
    sizes = named.select((F.col("bucket") * parts + F.col("part")).alias("file"), "bucket", "doc_id", n.cast("long").alias("n"))
    units = running_sums(sizes, "file", "doc_id", {"cum": F.col("n")}).withColumn("first", F.col("cum") - F.col("n"))
    units = units.select("file", "bucket", "doc_id", (F.col("first") + F.expr("n div 4")).alias("start_line"),
                         (F.col("first") + F.expr("n - n div 4")).alias("end_line"))
    return R.slice_stored(stored, units, key=("file", "bucket", "doc_id")) \
        .select(F.col("bucket").alias("file"), "doc_id", "raw")


def code_corpus(spark: SparkSession, sf_dir: str):
    """Conversations as token files, source files and a label report.

    A conversation is a file, stored with all others in two packs; its source is its turns' texts, one below the other. A
    user turn is a BEGIN_METHOD row and its words, an assistant turn its words and an
    END_METHOD row; words carry their source line, markers none. The report
    has a finding for each source line with several commas, and for each that ends
    with a full stop. Returns ``(tokens, sources, report, name)``.
    """
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    lines = c.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")) \
        .withColumn("at", F.struct("turn", "i"))
    lines = running_sums(lines, "conv_id", "at", {"n": F.lit(1)}).withColumn("no", F.col("n") - 1)
    at = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")

    def write(df, order, name):
        file = F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_KEY))
        return R.write_pack(df.select(file.alias("file"), *order, "value"), f"{at}/{name}", *order)

    words = lines.select("conv_id", "turn", "i", F.posexplode(F.split("line", " ")).alias("w", "word"), "no").where("word <> ''")
    cell = F.concat(F.lit('"'), F.replace("word", F.lit('"'), F.lit('""')), F.lit('"'))
    words = words.select("conv_id", "turn", "i", "w", F.concat_ws(",", cell, F.lit("1"), F.col("no").cast("string"),
                                                                F.col("w").cast("string")).alias("value"))
    first = F.col("role") == "user"
    marks = c.select("conv_id", "turn", F.when(first, -1).otherwise(1_000_000_000).alias("i"), F.lit(0).alias("w"),
                     F.when(first, F.lit("BEGIN_METHOD,8001,,")).otherwise(F.lit("END_METHOD,8002,,")).alias("value"))
    tokens = write(words.unionByName(marks), ["turn", "i", "w"], "tokens")
    sources = write(lines.select("conv_id", "no", F.col("line").alias("value")), ["no"], "sources")
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    report = lines.select(F.concat(F.lit("\\"), F.col("conv_id").cast("string")).alias("nFile_Name"),
                          (F.col("no") + 1).cast("int").alias("nMethod_Line"), F.explode(F.array_compact(F.array(
                              F.when(commas >= 2, F.lit("SQL_Commas")), F.when(F.endswith("line", F.lit(".")), F.lit("Stop"))
                          ))).alias("qName"))
    return tokens, sources, report, F.col

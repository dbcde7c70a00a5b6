"""Scalar text expressions. All are Spark built-ins (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
# - word for counting: maximal run of two or more letters, digits or "_"
#   (the default pattern of the reference's count vectoriser, Unicode aware)
# - unit text keeps letters, digits, space, "_" and "-"; everything else is deleted
# - a clean vocabulary name is ASCII letters or "_" followed by digits
# - cells read as missing by the reference's CSV reader
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
DROP_PATTERN = r"[^\p{L}\p{N} _\-]"
CLEAN_NAME_PATTERN = r"^[a-zA-Z_]+\p{Nd}*$"
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
             "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """V1: lower-case, maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_PATTERN), 0)


def normalize(text) -> Column:
    """Lower, delete all but letters/digits/space/_/-, collapse spaces."""
    kept = F.regexp_replace(F.lower(col(text)), DROP_PATTERN, "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def is_clean_name(name) -> Column:
    """ASCII letters/underscore then optional digits."""
    return col(name).rlike(CLEAN_NAME_PATTERN)


def long_enough(text, n: int = 2) -> Column:
    """More than ``n`` characters once newlines are removed."""
    return F.length(F.replace(col(text), F.lit("\n"), F.lit(""))) > n


def is_missing_token(token) -> Column:
    """Null or one of the strings the reference's reader turns into NA."""
    c = col(token)
    return c.isNull() | c.isin(list(NA_VALUES))


def any_keyword(tags, keywords) -> Column:
    """Any keyword is a substring of any tag (tags: array<string>)."""
    if not keywords:
        return F.lit(False)
    conds = [F.exists(col(tags), _contains(k)) for k in keywords]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _contains(k):
    return lambda t: t.contains(k)


def keyword_in_string(s, keywords) -> Column:
    """P9 on a joined tag string: any keyword occurs as a substring."""
    if not keywords:
        return F.lit(False)
    out = col(s).contains(keywords[0])
    for k in keywords[1:]:
        out = out | col(s).contains(k)
    return out


def split_lines(text) -> Column:
    """S3: text -> array of lines (any line break), trailing empty item dropped."""
    parts = F.split(col(text), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def line_slice(lines, start, end) -> Column:
    """Join lines [start, end) with newlines (0-based, end exclusive)."""
    s = col(start).cast("int")
    e = col(end).cast("int")
    n = F.greatest(F.least(e, F.size(col(lines))) - s, F.lit(0))
    return F.when(n > 0, F.array_join(F.slice(col(lines), s + 1, n), "\n")).otherwise(F.lit(""))


TOKEN_FOLDER, SOURCE_FOLDER, TOKEN_SUFFIX = "tokenized1", "c_sharp_code", ".tree-viewer.txt"


def relative_name(path, folder: str, suffix: str = "") -> Column:
    """What follows ``folder`` and a slash of either kind, without ``suffix``."""
    return F.regexp_extract(col(path), rf"\Q{folder}\E[\\/](.*?)(?:\Q{suffix}\E)?$", 1)


def report_name(path, folder: str = TOKEN_FOLDER, suffix: str = TOKEN_SUFFIX) -> Column:
    """Token file path -> label-report file name ("\\" + relative name)."""
    return F.concat(F.lit("\\"), relative_name(path, folder, suffix))


def source_path(path, folder: str = TOKEN_FOLDER, source_folder: str = SOURCE_FOLDER,
                suffix: str = TOKEN_SUFFIX) -> Column:
    """Token file path -> source file path."""
    p = F.replace(col(path), F.lit(folder), F.lit(source_folder))
    return F.regexp_replace(p, rf"\Q{suffix}\E$", "")


def format_share(name, share) -> Column:
    """``name_0.1234``."""
    return F.format_string("%s_%.4f", col(name).cast("string"), col(share))

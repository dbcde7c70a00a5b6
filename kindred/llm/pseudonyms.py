"""Format-preserving pseudonyms (DataFrame functions only).

Numbers and dates that identify people are found by pattern, validated (check
digits, number ranges, calendar) and permuted within their own format by a
keyed Feistel network: a card number becomes another card number with a valid
check digit, a date another date, a letter another letter of its case. The
network is a permutation of each format, so two values never share a
pseudonym, and it depends on the value and the key only, so equal values stay
linked across documents, whatever separators they are written with.

Kinds: payment cards (Luhn), IBANs (mod 97), social security numbers (issued
ranges), phone numbers (10 to 15 digits), IPv4 addresses, dates (ISO, dotted,
slashed), and mail addresses (the part before the @). Where a match fails its
test, what lies between its separators is tried, from the left, the longest
first; what fails there, too, stays as it is.

Each text is split once at its matches and joined again; there is no shuffle
and no row-wise Python, so rows are independent and a hot value costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import whole_text

ROUNDS = 8  # even: after it the halves are back in place

# The formats. A mail domain has at most 128 labels (a name has 253
# characters), which also bounds how deep the pattern's repeated group goes. It begins
# where its run of characters or the search does, so a run is read once.
MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,127}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DAY_DATE = r"(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"
# A run starts like a card and goes on over all digits that follow.
RUN = CARD.replace("(?![0-9A-Za-z]", r"(?:[ -][0-9 -]*[0-9](?![0-9A-Za-z]|[./-][0-9]))?(?![0-9A-Za-z]", 1)
PIECES = 19  # no value has more pieces between separators
ANY = "|".join(f"(?:{p})" for p in
               (MAIL, IBAN, ISO_DATE, DAY_DATE.replace(r"([./])", r"[./]").replace(r"\1", "[./]"),
                SSN, IPV4, RUN, PHONE))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _round_hash(key: str, kind: Column, r: Column, size: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), size.cast("string"), half)
                  .cast("binary"), 256)


def _shift(half: Column, digest: Column) -> Column:
    """Add a keyed amount to every character, within its class."""
    def move(c, i):
        base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
        span = F.when(c.rlike("[0-9]"), 10).otherwise(26)
        by = F.conv(F.substring(digest, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.char(base + F.pmod(F.ascii(c) - base + by, span))
    return F.array_join(F.transform(_chars(half), move), "")


def feistel_text(value: Column, key: str, kind: Column) -> Column:
    """Keyed permutation of strings of ``[0-9A-Za-z]`` that keeps each place's class.

    One character alone is shifted by a keyed amount; the empty string stays.
    """
    size = F.length(value)
    left = F.floor(size / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), left).alias("a"),
                     F.substring(value, left + 1, size).alias("b"))

    def step(s, r):
        return F.struct(s["b"].alias("a"),
                        _shift(s["a"], _round_hash(key, kind, r, size, s["b"])).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    mixed = F.aggregate(rounds, start, step, lambda s: F.concat(s["a"], s["b"]))
    return F.when(size == 1, _shift(value, _round_hash(key, kind, F.lit(0), size, F.lit("")))).otherwise(mixed)


def feistel_pair(a: Column, b: Column, span_a: int, span_b: int, key: str, kind: str) -> Column:
    """Keyed permutation of number pairs below ``span_a`` and ``span_b``."""
    def step(s, r):
        odd = r % 2 == 1
        fixed = F.when(odd, s["b"]).otherwise(s["a"])
        amount = F.conv(F.substring(_round_hash(key, F.lit(kind), r, F.lit(2), fixed.cast("string")), 1, 12),
                        16, 10).cast("long")
        return F.struct(F.when(odd, F.pmod(s["a"] + amount, F.lit(span_a))).otherwise(s["a"]).alias("a"),
                        F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + amount, F.lit(span_b))).alias("b"))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _refill(shape: Column, chars: Column, taken: str = "[0-9]") -> Column:
    """``shape`` with the characters of class ``taken`` replaced, in order, by ``chars``."""
    state = F.aggregate(
        _chars(shape), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.when(c.rlike(taken), F.struct(
            F.concat(s["out"], F.substring(chars, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))))
    return state["out"]


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number (check digit included)."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """An IBAN's remainder: country and check digits moved behind, letters as two digits."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


ERA_DAYS = 146097  # the calendar repeats every 400 years: 189 * 773 days


def _other_day(date: Column, key: str) -> Column:
    """Another day of the same 400-year cycle of the calendar."""
    n = F.date_diff(date, F.lit("0001-01-01").cast("date"))
    era, day = F.floor(n / ERA_DAYS), F.pmod(n, F.lit(ERA_DAYS))
    p = feistel_pair(F.floor(day / 773), day % 773, 189, 773, key, "date")
    return F.date_add(F.lit("0001-01-01").cast("date"), (era * ERA_DAYS + p["a"] * 773 + p["b"]).cast("int"))


def pseudonym(m: Column, key: str) -> Column:
    """``struct<kind, value>`` of one match; kind is null where it fails validation."""
    def full(p):
        return m.rlike(f"^(?:{p})$")

    def out(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    d = _digits(m)
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    mail = F.concat(_refill(local, feistel_text(F.regexp_replace(local, "[^0-9A-Za-z]", ""), key, F.lit("mail")),
                            "[0-9A-Za-z]"), F.lit("@"), host)

    flat = F.regexp_replace(m, " ", "")
    body = feistel_text(F.substring(flat, F.lit(5), F.length(flat)), key, F.lit("iban"))
    check = F.lpad((98 - _mod97(F.concat(F.substring(flat, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    iban = _refill(m, F.concat(F.substring(flat, 1, 2), check, body), "[0-9A-Z]")

    iso = _date(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))
    parts = F.split(m, "[./]")
    first, second, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    sep = F.regexp_extract(m, "([./])", 1)
    month_first = _date(year, second, first).isNull()  # day first unless that is no date
    day_date = F.coalesce(_date(year, second, first), _date(year, first, second))
    moved = _other_day(day_date, key)
    wide = F.length(m) == 10

    def part(fmt):
        text = F.date_format(moved, fmt)
        return F.when(wide, text).otherwise(F.regexp_replace(text, "^0", ""))
    new_day = F.concat(F.when(month_first, part("MM")).otherwise(part("dd")), sep,
                       F.when(month_first, part("dd")).otherwise(part("MM")), sep, F.date_format(moved, "yyyy"))

    area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1  # 898 areas of 99 groups
    p = feistel_pair(index, serial - 1, 898 * 99, 9999, key, "ssn")
    new_area = F.floor(p["a"] / 99) + 1
    ssn = F.concat_ws("-", F.lpad((new_area + F.when(new_area >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
                      F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"),
                      F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    ip_ok = F.forall(o, lambda x: x < 256)
    q = feistel_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)),
                     65536, 65536, key, "ip")
    ip = F.concat_ws(".", F.floor(q["a"] / 256).cast("string"), (q["a"] % 256).cast("string"),
                     F.floor(q["b"] / 256).cast("string"), (q["b"] % 256).cast("string"))

    payload = feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
    card = _refill(m, F.concat(payload, F.pmod(10 - _luhn_sum(F.concat(payload, F.lit("0"))) % 10, F.lit(10))
                               .cast("string")))
    phone_ok = (F.length(d) >= 10) & (F.length(d) <= 15)
    phone = _refill(m, feistel_text(d, key, F.lit("phone")))
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    return (F.when(full(MAIL), out("mail", mail))
            .when(full(IBAN) & (_mod97(flat) == 1), out("iban", iban))
            .when(full(ISO_DATE) & iso.isNotNull(), out("date", F.date_format(_other_day(iso, key), "yyyy-MM-dd")))
            .when(full(DAY_DATE) & day_date.isNotNull(), out("date", new_day))
            .when(full(SSN) & ssn_ok, out("ssn", ssn))
            .when(full(IPV4) & ip_ok, out("ip", ip))
            .when(full(CARD) & (_luhn_sum(d) % 10 == 0), out("card", card))
            .when(full(PHONE) & phone_ok, out("phone", phone))
            .otherwise(same))


def pseudonyms(m: Column, key: str) -> Column:
    """``array<struct<kind, value>>`` of a match: the values found in it and what
    lies between (kind null), in order.

    Pieces ``i`` to ``j`` are tried for each ``i``, the largest ``j`` first: the
    whole match, then what begins and ends at separators. Phone numbers have no
    check digit, so one inside a match gives way to a card that begins in it.
    """
    def named(x, f):
        """``f(x)``, with ``x`` computed once."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def literal(text):
        return F.struct(F.lit(None).cast("string").alias("kind"), text.alias("value"))

    def search(pieces):  # every second one is a separator
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(2))
        spans = F.flatten(F.transform(firsts, lambda i: F.transform(
            F.sequence(F.least(F.size(pieces), i + 2 * (PIECES - 1)), i, F.lit(-2)),
            lambda j: F.struct(i.alias("i"), j.alias("j"),
                               F.array_join(F.slice(pieces, i, j - i + 1), "").alias("text")))))
        return named(spans, lambda spans: walk(pieces, spans))

    def walk(pieces, spans):
        def is_card(t):
            return t.rlike(f"^(?:{CARD})$") & (_luhn_sum(_digits(t)) % 10 == 0)

        def step(s, span):
            i, j = span["i"], span["j"]

            def taken(p):
                whole = (i == 1) & (j == F.size(pieces))
                gives_way = F.when((p["kind"] == "phone") & ~whole, F.exists(F.filter(
                    spans, lambda t: (t["i"] > i) & (t["i"] <= j)), lambda t: is_card(t["text"]))) \
                    .otherwise(F.lit(False))
                after = F.coalesce(F.get(pieces, j), F.lit(""))  # the separator behind piece j
                return F.when((p["kind"].isNotNull() & ~gives_way) | (i == j), F.struct(
                    (j + 2).alias("next"), F.concat(s["out"], F.array(p, literal(after))).alias("out"))).otherwise(s)
            return F.when(i < s["next"], s).otherwise(
                named(span["text"], lambda t: named(pseudonym(t, key), taken)))
        start = F.struct(F.lit(1).alias("next"),
                         F.array().cast("array<struct<kind:string,value:string>>").alias("out"))
        return F.aggregate(spans, start, step, lambda s: s["out"])

    return named(F.regexp_extract_all(m, F.lit("[ -]+|[^ -]+"), F.lit(0)), search)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with identifying values replaced in ``text_col``, and two columns
    ``n_values`` (how many were replaced) and ``kinds`` (which, in order).

    The key is secret to the caller. Null text stays null (0 values), texts
    without matches stay byte for byte. Repeated rows are treated alike; all
    other columns are kept, and ``n_values`` and ``kinds`` replace any of the
    same name.
    """
    text = F.col(text_col).cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))
    d = docs.withColumn("__found", F.transform(found, lambda m: pseudonyms(m, key)))
    gaps = F.split(text, ANY, -1)
    joined = F.when(F.size("__found") <= 0, text).otherwise(F.array_join(F.transform(
        gaps, lambda g, i: F.concat(g, F.coalesce(
            F.array_join(F.get(F.col("__found"), i)["value"], ""), F.lit("")))), ""))
    kinds = F.filter(F.flatten(F.transform("__found", lambda f: f["kind"])), lambda k: k.isNotNull())
    return d.withColumns({text_col: joined, "kinds": F.coalesce(kinds, F.array().cast("array<string>"))}) \
        .withColumn("n_values", F.size("kinds")).drop("__found")

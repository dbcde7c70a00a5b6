"""Near duplicates: an exact metric-space join under the Jaccard distance.

``d(x, y) = 1 - |x & y| / |x | y|`` over sets of word shingles is a metric, so
pivots and the triangle inequality can bound it. Pivots fixed in advance would
bound nothing here: almost every document is at distance 1 from almost every
other, every Voronoi region would get every document, and nothing would be
pruned. So pivots are chosen where documents meet:

1. Sets with the same elements are one node (copies collapse in each task
   before anything is shuffled).
2. With all elements in one global order (widespread shingles last), two sets
   within the radius share at least ``l = n / 8`` of the elements among their
   first ``n - ceil(0.75 n) + l``. A node with too few elements that any other
   node has there is alone: most documents end here. The members of one such
   element form a region of the space; its pivot is its most central member. A
   node is replicated to the regions of its first elements and to no others,
   and each linked pair meets in at least one region.
3. Every member's distance to its region's pivot is computed exactly. Members
   within the radius of a pivot join its component: a group of near copies
   costs one distance a member, never all pairs.
4. Regions whose members are not yet of one component are joined recursively:
   members outside the region's largest component become pivots in turn (4,
   then 64 a region, then the rest), and are compared with those members of
   other components that the triangle window ``|d(x, z) - d(y, z)| <= r`` to
   the first pivot ``z``, the size bound and the parity bound (elements hashed
   to 1024 parity bits: each bit that differs is an element of the symmetric
   difference) admit. A region is finished when
   each member is in its largest component or has been its pivot, so no link
   between two components is lost; pairs inside a component need no test.

Only the order of elements rests on an estimate (which shingles recur within
stretches of the input); a poor order costs time, never a link.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from kindred.llm.common import stage, whole_text
from kindred.operators.components import connected_components

_DRAW = np.random.default_rng(6)
MULTIPLIERS = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64)
BASE = int(MULTIPLIERS[-2])
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
MAX_WIDESPREAD = 400_000  # widespread shingles broadcast (5 MB)
STRETCH = 2_000_000      # shingles in one stretch
PART = 1 << 18           # bytes hashed at once
SALTS = 32
WORDS = 16               # of parity bits
LONG = 64                # bytes of a word
EXTRA = 8                # a prefix has n / EXTRA elements more than it must


def _powers(base: int) -> np.ndarray:
    out = np.full(PART + 1, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIERS[-1]
        return h ^ (h >> np.uint64(29))


class Shingler:
    """Distinct shingle hashes (uint64, ascending) of whole texts.

    Word hashes are differences of one running polynomial over the bytes, so a
    text takes a few array operations; words of more than ``LONG`` bytes, where
    such a polynomial can be made to collide whatever its base, are hashed alone.
    """

    def __init__(self, words: int = 5):
        self.words = words
        self.up, self.down = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))

    def word_hashes(self, text: str) -> np.ndarray:
        """Words are what lies between ASCII white space, A-Z lower-cased."""
        b = np.frombuffer((text or "").encode().lower(), np.uint8)
        if len(b) <= PART:
            return self._hashes(b)
        parts, at = [], 0
        while at < len(b):  # cut long texts at blanks
            end = min(len(b), at + PART)
            if end < len(b):
                blanks = np.flatnonzero(BLANK[b[at:end]])
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                else:  # one very long word: hash it alone
                    rest = np.flatnonzero(BLANK[b[end:]])
                    end = end + int(rest[0]) if len(rest) else len(b)
                    stop = at + int(np.argmin(BLANK[b[at:end]]))
                    parts.append(np.array([xxh3_64_intdigest(b[stop:end].tobytes())], np.uint64))
                    at = end
                    continue
            parts.append(self._hashes(b[at:end]))
            at = end
        return np.concatenate(parts)

    def _hashes(self, b: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate(([True], BLANK[b], [True])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[b] * self.up[:len(b)], dtype=np.uint64)))
            out = _mix((run[ends] - run[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = xxh3_64_intdigest(b[starts[i]:ends[i]].tobytes())
        return out

    def of(self, text: str) -> np.ndarray:
        """Fewer words than a shingle has are one shingle; no words, no shingles."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                s += h[i:len(h) - k + 1 + i] * MULTIPLIERS[i]
        s = _mix(s)
        s.sort()
        return s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]


def _text_batches(batches):
    for batch in batches:
        yield batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()


def _fingerprint(s: np.ndarray):
    import xxhash
    d = xxhash.xxh3_128_digest(s.tobytes())
    return (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))


def _measure(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, f1, f2`` per input row (size and 128-bit fingerprint of its
    set), and rows with ``s, k`` instead: the shingles that recur within a
    stretch of different sets, and how often."""
    def rows(batches):
        import pyarrow as pa
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                            ("s", pa.list_(pa.int64())), ("k", pa.list_(pa.int64()))])
        shingler, held, size, seen = Shingler(words), [], 0, set()

        def recurring():
            v, k = np.unique(np.concatenate(held), return_counts=True)
            v, k = v[k > 1].view(np.int64), k[k > 1]
            return pa.RecordBatch.from_pylist([dict(s=v, k=k)], schema)
        for ids, texts in _text_batches(batches):
            out = []
            for doc_id, text in zip(ids, texts):
                s = shingler.of(text)
                f = _fingerprint(s)
                out.append((doc_id, len(s), *f))
                if f not in seen:
                    seen.add(f)
                    held.append(s)
                    size += len(s)
                if size >= STRETCH:
                    yield recurring()
                    held, size, seen = [], 0, set()
            cols = [pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            none = pa.nulls(len(out), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*cols, none, none], schema=schema)
        if held:
            yield recurring()

    return docs.mapInArrow(rows, "doc_id long, n long, f1 long, f2 long, s array<long>, k array<long>")


def widespread(measured: DataFrame, least: int = 4, most: int = MAX_WIDESPREAD):
    """The shingles to put last: ``(hashes ascending, class)``, class is log2 of the count.

    The floor is the smallest power of two that leaves at most ``most``.
    """
    n = measured.where("s is not null").select(F.explode(F.arrays_zip("s", "k")).alias("e")) \
        .groupBy(F.col("e.s").alias("s")).agg(F.sum("e.k").alias("k")).where(F.col("k") >= least)
    n = stage(n.select("s", F.floor(F.log2("k")).cast("int").alias("class")), "shingles-recurring")
    tally = {r["class"]: r["k"] for r in n.groupBy("class").agg(F.count(F.lit(1)).alias("k")).collect()}
    floor, total = 64, 0
    for c in sorted(tally, reverse=True):
        if total + tally[c] > most:
            break
        floor, total = c, total + tally[c]
    got = n.where(F.col("class") >= floor).toPandas()
    s = got["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], got["class"].to_numpy(np.int64)[order]


def _prefix(s: np.ndarray, common, percent: int):
    """``(first elements as 48-bit keys, how many are not widespread, share of widespread)``."""
    values, classes = common
    at = np.searchsorted(values, s)
    at[at == len(values)] = 0
    hit = values[at] == s if len(values) else np.zeros(len(s), bool)
    cls = np.where(hit, classes[at], 0) if len(values) else np.zeros(len(s), np.int64)
    n = len(s)
    length = min(n, n - -(-percent * n // 100) + n // EXTRA + 1)
    first = np.lexsort((s, cls))[:length]
    return ((s[first] >> np.uint64(16)).view(np.int64), int((cls[first] == 0).sum()),
            float(hit.mean()) if n else 0.0)


def _prefixes(docs: DataFrame, words: int, percent: int, common) -> DataFrame:
    """``f1, f2, n, central, plain, prefix`` of every set, once per stretch it occurs in."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def sets(batches):
        import pyarrow as pa
        shingler, seen = Shingler(words), set()
        for _, texts in _text_batches(batches):
            for at in range(0, len(texts), 1000):
                rows = []
                if len(seen) > STRETCH // 4:
                    seen.clear()
                for text in texts[at:at + 1000]:
                    s = shingler.of(text)
                    f = _fingerprint(s)
                    if len(s) and f not in seen:
                        seen.add(f)
                        p, plain, central = _prefix(s, held.value, percent)
                        rows.append((*f, len(s), central, plain, p))
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(cols, types)],
                        names=["f1", "f2", "n", "central", "plain", "prefix"])

    return docs.mapInArrow(sets, "f1 long, f2 long, n long, central double, plain long, prefix array<long>")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 75, rounds: tuple = (4, 64)) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_group``: one row per input row.

    Two rows link when 100 * intersection >= percent * union of their sets;
    ``component_id`` is the smallest doc_id reachable. Rows without words (null
    and empty texts too) link with nothing and keep their own id. Repeated rows
    share a set. A null id never is a component's id unless all its members'
    are null. An empty table gives an empty result. Other columns are ignored,
    whatever their names. ``text_group`` names the set (equal sets, equal value).
    """
    return _row_components(docs, id_col, text_col, words, percent, rounds) \
        .select("doc_id", "n_shingles", "component_id", "text_group")


def _row_components(docs, id_col, text_col, words, percent, rounds) -> DataFrame:
    """``near_components`` with ``component`` (null without words) and the set's fingerprint ``f1, f2``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    measured = stage(_measure(d, words), "shingles-measured")
    rows = measured.where("s is null").select("doc_id", "n", "f1", "f2")
    common = widespread(measured)

    # Nodes: distinct sets.
    nodes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")

    members = _regions(_prefixes(d, words, percent, common), nodes, percent)
    comp = _connect(d, nodes, members, words, percent, rounds)
    named = nodes.select("node", "f1", "f2", "least").join(comp, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.join(label, "component").select("f1", "f2", "component_id", "component", F.col("node").alias("text_group")),
                  "near-components")
    # A hot group of copies is one hot key here; AQE splits the row side.
    return rows.join(named, ["f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_group", "component", "f1", "f2")


def _regions(prefixes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pivot, node, n, central``: members of every region of two or more.

    The most central member of each shared element is its pivot, and a pivot's
    region is all members of its elements. One pass finds the elements that more than one set has; widespread ones
    are known to be shared and dealt out by salt, so that no region's members
    meet in one task. Only sets with enough shared elements go on.
    """
    p = stage(prefixes, "prefixes").withColumn("row", F.monotonically_increasing_id())
    narrow = p.select("row", "plain", F.posexplode("prefix").alias("pos", "s")).select(
        "s", "row", F.when(F.col("pos") >= F.col("plain"), F.pmod("row", F.lit(SALTS))).otherwise(-1)
        .cast("int").alias("salt"))
    key = Window.partitionBy("s", "salt")
    shared = narrow.withColumn("lo", F.min("row").over(key)).withColumn("hi", F.max("row").over(key)) \
        .where((F.col("lo") != F.col("hi")) | (F.col("salt") >= 0))
    # A linked set has n / EXTRA shared elements in its prefix, or 0.75 of that (the other's size).
    enough = F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA) + 1
    got = shared.groupBy("row").agg(F.collect_list("s").alias("s")) \
        .join(p.select("row", "f1", "f2", "n", "central"), "row").where(F.size("s") >= enough)
    seed = stage(got.join(nodes.select("f1", "f2", "node"), ["f1", "f2"])
                 .select("node", "n", "central", F.explode("s").alias("s")), "regions-seed")
    # Copies from other tasks are the same node; without them fewer elements are shared.
    for turn in range(2):
        seed = seed.dropDuplicates(["s", "node"])
        heads = seed.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.max(
            F.struct("central", F.negate("node").alias("minus"))).alias("top"))
        seed = seed.join(heads.where("size > 1").select("s", F.negate("top.minus").alias("pivot")), "s")
        held = seed.groupBy("node").agg(F.count(F.lit(1)).alias("held"))
        seed = seed.join(held, "node").where(F.col("held") >= enough).drop("held")
        if turn == 0:
            seed = seed.drop("pivot")
        seed = stage(seed, "regions-elements")
    return stage(seed.select("pivot", "node", "n", "central").distinct(), "regions")


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity of how many elements fall on each of ``64 * WORDS`` places."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near_in_size(a, b, percent):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more links; ``comp`` holds linked nodes only.

    Only components that a link touches are joined anew, as nodes of a small graph.
    """
    a, b = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    edges = links.join(a, "a", "left").join(b, "b", "left") \
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    grown = connected_components(edges, None, "a", "b", "node")
    grown = grown.select(F.col("node").alias("was"), F.col("component").alias("now"))
    # Nodes new to comp are their own components in the small graph.
    known = comp.join(grown, comp["component"] == grown["was"], "full") \
        .select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "component").alias("component"))
    return stage(known.dropDuplicates(["node"]), "components")


def _connect(docs, nodes, members, words, percent, rounds) -> DataFrame:
    """``node, component`` of all nodes that any link names."""
    spark = docs.sparkSession
    # One text per node that shares a region with another.
    active = stage(members.select("node").distinct().join(nodes.select("node", "f1", "f2", "least"), "node"),
                   "active")
    n_active = active.count()
    wanted = active.select(F.col("least").alias("doc_id"), "node", "f1", "f2")
    if n_active <= 1_000_000:  # 32 MB; beyond that the join shuffles the texts
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])) \
        .select("node", "f1", "f2", docs["text"])

    def full_sets(batches):
        import pyarrow as pa
        shingler = Shingler(words)
        for batch in batches:
            node, f1, f2, text = (batch.column(c).to_pylist() for c in ("node", "f1", "f2", "text"))
            for at in range(0, len(node), 1000):
                got = [(k, s) for k, a, b, s in zip(node[at:at + 1000], f1[at:at + 1000], f2[at:at + 1000],
                                                    map(shingler.of, text[at:at + 1000]))
                       if _fingerprint(s) == (a, b)]  # an id may have other texts, too
                bits = np.array([_parity(s) for _, s in got], np.int64).reshape(len(got), WORDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.int64()),
                     pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64())),
                     *[pa.array(bits[:, i]) for i in range(WORDS)]], names=["node", "elements", *parity])

    parity = [f"b{i}" for i in range(WORDS)]
    sets = stage(texts.mapInArrow(full_sets, "node long, elements array<long>, "
                                  + ", ".join(f"{b} long" for b in parity)), "active-sets")

    def measured(pairs):
        """``a, b, d`` of distinct pairs; d is the exact distance."""
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b") \
            .join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a") \
            .withColumn("shared", F.size(F.array_intersect("ea", "eb"))) \
            .withColumn("union", F.size("ea") + F.size("eb") - F.col("shared"))
        return both.select("a", "b", (1 - F.col("shared") / F.col("union")).alias("d"),
                           (F.col("shared") * 100 >= F.col("union") * percent).alias("linked")) \
            .dropDuplicates(["a", "b"])  # repeated ids give a set twice

    pn = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"))
    star = members.select("node", "n", "pivot").where(F.col("node") != F.col("pivot")).distinct() \
        .join(pn, "pivot").where(_near_in_size(F.col("n"), F.col("pivot_n"), percent)) \
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    tested = stage(measured(star), "tested")
    comp = stage(connected_components(tested.where("linked"), None, "a", "b", "node"), "components")

    # Distance of each member to its region's pivot, where it was computed.
    to_pivot = tested.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("d").alias("dz"))
    members = members.join(to_pivot, ["node", "pivot"], "left") \
        .withColumn("dz", F.when(F.col("node") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("dz")))
    members = stage(members.join(sets.select("node", *parity).dropDuplicates(["node"]), "node"), "regions-measured")
    radius = 1 - percent / 100
    been = members.where("node = pivot").select("pivot", "node")
    for limit in (*rounds, None):
        # Nodes that no link names are components of their own.
        m = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        m = stage(m, "regions-components")
        main = m.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("pivot").agg(
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("k", "component"))["component"].alias("main")).where("parts > 1")
        out = m.join(main, "pivot").where(F.col("component") != F.col("main")) \
            .join(been, ["pivot", "node"], "left_anti")
        if limit is not None:
            out = out.withColumn("place", F.row_number().over(
                Window.partitionBy("pivot").orderBy(F.desc("central"), "node"))).where(F.col("place") <= limit)
        out = stage(out.select("pivot", F.col("node").alias("p"), F.col("n").alias("pn"),
                               F.col("component").alias("pc"), F.col("dz").alias("pz"),
                               *[F.col(b).alias(f"p{b}") for b in parity]), "next-pivots")
        if out.isEmpty():
            break
        window = F.coalesce(F.abs(F.col("dz") - F.col("pz")) <= radius + 1e-9, F.lit(True))
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"p{b}"))) for b in parity), F.lit(0))
        near = apart * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent)
        pairs = m.join(out, "pivot").where((F.col("component") != F.col("pc")) & window & near
                                           & _near_in_size(F.col("n"), F.col("pn"), percent)) \
            .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = stage(measured(pairs.join(done, ["a", "b"], "left_anti")), "tested")
        tested = tested.unionByName(more)
        comp = _joined(comp, more.where("linked").select("a", "b"))
        been = been.unionByName(out.select("pivot", F.col("p").alias("node")))
    return comp


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       percent: int = 75, rounds: tuple = (4, 64)) -> DataFrame:
    """One row of each component of near copies, all columns kept: one with the
    smallest id, a null id only if all are null. Decided per set, not per id:
    rows that share an id but are not linked all stay. Rows without words stay,
    and of those with the same id and text one stays.
    """
    c = _row_components(docs, id_col, text_col, words, percent, rounds)
    stay = c.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "f1", "f2")).alias("s")) \
        .select(F.col("s.doc_id").alias("__id"), F.col("s.f1").alias("__f1"), F.col("s.f2").alias("__f2"))
    stay = stage(stay, "near-kept")

    @F.pandas_udf("n long, f1 long, f2 long")
    def fingerprint(texts):
        import pandas as pd
        shingler = Shingler(words)
        sets = (shingler.of(t) for t in texts)
        return pd.DataFrame([(len(x), *_fingerprint(x)) for x in sets], columns=["n", "f1", "f2"], dtype="int64")

    d = docs.withColumn("__set", fingerprint(whole_text(text_col))) \
        .withColumn("__blank", F.when(F.col("__set.n") == 0, F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__set.f1") == F.col("__f1")) \
        & (F.col("__set.f2") == F.col("__f2"))
    return d.join(stay, same, "left").where((F.col("__set.n") == 0) | F.col("__f1").isNotNull()) \
        .dropDuplicates([id_col, "__set", "__blank"]).select(docs.columns)

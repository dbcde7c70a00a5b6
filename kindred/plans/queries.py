"""Registered queries: one per operator of the survey, over the driver tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the DuckDB oracle of the same key (``oracles.py``). Floats are rounded
to 6 places on both sides; counts are ``long``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.rank import global_row_number
from kindred.operators import components as C
from kindred.operators import pairs as N
from kindred.operators import vectorize as V
from kindred.operators import vocab as VO
from kindred.plans import docs as D
from kindred.session import cut_lineage, ship_package, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark, sf):
            ship_package(spark)
            return fn(spark, sf)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------ vocabulary

@query("token_freq")
def token_freq(spark, sf):
    return D.frequency(spark, sf)


@query("vocab_sorted")
def vocab_sorted(spark, sf):
    return global_row_number(D.frequency(spark, sf), *VO.vocabulary_order(), name="rank")


@query("vocab_clean")
def vocab_clean(spark, sf):
    return VO.clean_vocabulary(D.frequency(spark, sf))


@query("vocab_cut")
def vocab_cut(spark, sf):
    return D.vocabulary(spark, sf)


@query("topn_vocab")
def topn_vocab(spark, sf):
    return VO.top_n_vocabulary(D.tokens(spark, sf), D.DEFAULT.top_n)


# ------------------------------------------------------------ text

@query("normalize_text")
def normalize_text(spark, sf):
    return D.units(spark, sf).select("unit_id", T.normalize("text").alias("norm"))


@query("short_units")
def short_units(spark, sf):
    kept = V.min_size(D.units(spark, sf), 5)
    return kept.select("unit_id", F.greatest(F.size(F.split("text", "\n")), F.lit(1))
                       .cast("long").alias("n_lines"))


@query("vocab_semi")
def vocab_semi(spark, sf):
    return V.has_vocabulary_word(D.units(spark, sf), D.vocabulary(spark, sf)).select("unit_id")


# ------------------------------------------------------------ vectors

@query("term_counts")
def term_counts(spark, sf):
    return D.counts(spark, sf)


@query("binary_terms")
def binary_terms(spark, sf):
    return D.counts(spark, sf, binary=True)


@query("term_totals")
def term_totals(spark, sf):
    return V.term_totals(D.counts(spark, sf))


@query("doc_freq")
def doc_freq(spark, sf):
    return V.document_frequency(D.counts(spark, sf))


@query("unit_count")
def unit_count(spark, sf):
    c = D.counts(spark, sf)
    return c.agg(F.countDistinct("unit_id").cast("long").alias("n_units"))


@query("ngram_counts")
def ngram_counts(spark, sf):
    return V.ngram_counts(D.units(spark, sf), 2)


@query("tfidf_weights")
def tfidf_weights(spark, sf):
    return D.weights(spark, sf).select("unit_id", "idx", r6(F.col("w")).alias("w"))


@query("row_norms")
def row_norms(spark, sf):
    n = V.row_norms(D.weights(spark, sf))
    return n.select("unit_id", r6(F.col("l1")).alias("l1"), r6(F.col("l2")).alias("l2"))


# ------------------------------------------------------------ pairs

@query("pair_distance_cosine")
def pair_distance_cosine(spark, sf):
    return D.cosine_pairs(spark, sf).select("i", "j", r6(F.col("dist")).alias("dist"))


def _jaccard_pairs(spark, sf):
    return N.jaccard_within(D.counts(spark, sf), D.DEFAULT.t_jaccard, dim=D.DEFAULT.vocab_take + 1)


@query("pair_distance_jaccard")
def pair_distance_jaccard(spark, sf):
    return _jaccard_pairs(spark, sf).select("i", "j", r6(F.col("dist")).alias("dist"))


@query("pair_distance_jaccard_real")
def pair_distance_jaccard_real(spark, sf):
    """N3 ``jaccard`` on count vectors: cells equal in value, not only present."""
    p = N.jaccard_cells_within(D.counts(spark, sf), D.DEFAULT.t_jaccard, dim=D.DEFAULT.vocab_take + 1)
    return p.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("pair_distance_jaccard_binary")
def pair_distance_jaccard_binary(spark, sf):
    """N3 ``jaccard_binary``: the same rule on 0-1 vectors."""
    p = N.jaccard_cells_within(D.counts(spark, sf, binary=True), D.DEFAULT.t_jaccard, dim=D.DEFAULT.vocab_take + 1)
    return p.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("pair_distance_jaccard_approx")
def pair_distance_jaccard_approx(spark, sf):
    """N3(c): set Jaccard pairs that share a bucket of minimum hashes."""
    p = N.jaccard_within_approx(D.counts(spark, sf), D.DEFAULT.t_jaccard)
    return p.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("binary_cells")
def binary_cells(spark, sf):
    n_terms = D.vocabulary(spark, sf).count()
    return N.binary_cells(D.counts(spark, sf), _jaccard_pairs(spark, sf), n_terms)


@query("square_form")
def square_form(spark, sf):
    w = D.weights(spark, sf)
    sq = N.square_form(N.cosine_within(w, D.DEFAULT.t_cosine), w.select("unit_id").distinct())
    return sq.select("i", "j", r6(F.col("dist")).alias("dist"))


# ------------------------------------------------------------ clusters

@query("clusters_single")
def clusters_single(spark, sf):
    return D.components(spark, sf)


@query("cluster_sizes")
def cluster_sizes(spark, sf):
    return C.component_sizes(D.components(spark, sf)).select(
        F.col("component").alias("cluster_id"), F.col("size").cast("long"))


@query("cluster_report")
def cluster_report(spark, sf):
    return D.cluster_report(spark, sf)


# ------------------------------------------------------------ segmentation

from kindred.operators import segment as S  # noqa: E402
from kindred.operators import label as L  # noqa: E402
from kindred.plans import streams as ST  # noqa: E402
from kindred.sources import files as FS  # noqa: E402


@query("marker_check")
def marker_check(spark, sf):
    t = ST.conversation_tokens(spark, sf)
    return S.marker_check(t, ST.CONV_BEGIN(), ST.CONV_END())


@query("marker_errors")
def marker_errors(spark, sf):
    return S.parse_errors(ST.page_tokens(spark, sf), ST.PAGE_BEGIN(), ST.PAGE_END())


@query("pair_units")
def pair_units(spark, sf):
    return S.pair_markers(ST.conversation_tokens(spark, sf), ST.CONV_BEGIN(), ST.CONV_END())


@query("page_units")
def page_units(spark, sf):
    return S.pair_markers(ST.page_tokens(spark, sf), ST.PAGE_BEGIN(), ST.PAGE_END())


@query("unit_text")
def unit_text(spark, sf):
    t = ST.conversation_tokens(spark, sf)
    return S.unit_text(t, ST.CONV_BEGIN(), ST.CONV_END()).select(
        "file", "k", "begin_pos", "end_pos", "text")


@query("unit_lines")
def unit_lines(spark, sf):
    t = ST.conversation_tokens(spark, sf)
    return S.unit_lines(t, ST.CONV_BEGIN(), ST.CONV_END()).select(
        "file", "k", "start_line", "end_line", "reason")


@query("unit_raw")
def unit_raw(spark, sf):
    """W10 + S3: source lines [start, end) of each unit (a turn is a line; a
    line's number is its place among the kept rows), by a bucketed range join
    (no array of a whole conversation)."""
    from kindred.functions.rank import running_sums
    from kindred.sources.files import slice_lines
    t = ST.conversation_tokens(spark, sf)
    lines = running_sums(t, "file", "pos", {"__rk": F.lit(1)}).select(
        "file", (F.col("__rk") - 1).alias("line_no"), F.col("token").alias("text"))
    u = S.unit_lines(t, ST.CONV_BEGIN(), ST.CONV_END())
    return slice_lines(lines, u.select("file", "k", "start_line", "end_line"), bucket=64)


@query("line_slice")
def line_slice(spark, sf):
    """Source lines of each unit's document, out of a stored line directory."""
    return ST.unit_slices(spark, sf)


@query("parse_tokens")
def parse_tokens(spark, sf):
    """Token rows of CSV files in which quoted cells hold commas, quotes and line breaks."""
    tokens, _ = FS.read_tokens(spark, ST.token_files(spark, sf))
    return tokens.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"),
                         "pos", "token", "kind", "line", "col")


@query("parse_error_rows")
def parse_error_rows(spark, sf):
    """One row per token file that gives no units, with the first reason."""
    lines, files = ST.turn_files(spark, sf)
    tokens, errors = FS.parse_tokens(lines, files=files)
    return S.parse_errors(S.drop_missing(tokens), files=files, read_errors=errors)


@query("last_line")
def last_line(spark, sf):
    return S.last_line(ST.page_tokens(spark, sf))


@query("fill_marker_lines")
def fill_marker_lines(spark, sf):
    f = S.fill_marker_lines(ST.event_tokens(spark, sf))
    return f.select(F.col("pos").alias("event_id"), F.col("file").alias("user_id"),
                    "token", "line", "kind", "col")


@query("islands")
def islands(spark, sf):
    e = ST.load(spark, sf, "events", "event_id", "user_id", "event_type")
    return S.islands(e, "user_id", "event_id", "event_type", min_length=1)


# ------------------------------------------------------------ labels

@query("tag_units")
def tag_units(spark, sf):
    units = ST.load(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "unit_id")
    return L.tag_units(units, L.report_from_labels(D.labels(spark, sf)), keywords=["toxic"])


@query("tag_units_any")
def tag_units_any(spark, sf):
    units = ST.load(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "unit_id")
    return L.tag_units(units, L.report_from_labels(D.labels(spark, sf)), keywords=None)


@query("findings_by_type")
def findings_by_type(spark, sf):
    e = ST.load(spark, sf, "events", "event_type")
    return L.findings_by_type(e, "event_type", ["XSS", "SQL"])


# ------------------------------------------------------------ dense vectors

from kindred.operators import evaluate as EV  # noqa: E402
from kindred.operators import stats as SS  # noqa: E402
from kindred.plans import vectors as VE  # noqa: E402


@query("pair_distance_dense")
def pair_distance_dense(spark, sf):
    p = N.dense_pairs(VE.vectors(spark, sf), "cosine", VE.T_COS)
    return p.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("pair_distance_euclidean")
def pair_distance_euclidean(spark, sf):
    p = N.dense_pairs(VE.vectors(spark, sf), "euclidean", VE.T_EUC)
    return p.select("i", "j", r6(F.col("dist")).alias("dist"))


def _manhattan(X, Y):
    import numpy as np
    return np.abs(X - Y).sum(axis=1)


@query("user_metric")
def user_metric(spark, sf):
    d = N.user_metric_pairs(None, VE.vectors(spark, sf), _manhattan, within=("cosine", VE.T_COS))
    return d.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("nearest_unit")
def nearest_unit(spark, sf):
    nn = N.nearest(VE.vectors(spark, sf), "cosine")
    return nn.select("i", "j", r6(F.col("dist")).alias("dist"))


@query("knn_vote")
def knn_vote(spark, sf):
    return VE.knn_predictions(spark, sf)


@query("confusion")
def confusion(spark, sf):
    return EV.confusion(VE.knn_predictions(spark, sf))


@query("accuracy")
def accuracy(spark, sf):
    return EV.accuracy(EV.confusion(VE.knn_predictions(spark, sf))).select(
        r6(F.col("accuracy")).alias("accuracy"))


@query("class_report")
def class_report(spark, sf):
    r = EV.class_report(EV.confusion(VE.knn_predictions(spark, sf)))
    return r.select("class", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"), r6(F.col("f1")).alias("f1"), "support")


@query("most_confused")
def most_confused(spark, sf):
    return EV.most_confused(EV.confusion(VE.knn_predictions(spark, sf)))


@query("log_confusion")
def log_confusion(spark, sf):
    c = EV.log_confusion(EV.confusion(VE.knn_predictions(spark, sf)))
    return c.select("label", "prediction", "n", r6(F.col("log_n")).alias("log_n"))


@query("misclassified")
def misclassified(spark, sf):
    return EV.misclassified(VE.knn_predictions(spark, sf))


@query("row_mean_std")
def row_mean_std(spark, sf):
    s = SS.row_mean_std(VE.vectors(spark, sf))
    return s.select("vec_id", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("centroids")
def centroids(spark, sf):
    c = SS.centroids(VE.vectors(spark, sf), "label")
    return c.select("label", F.col("dim").cast("int"), r6(F.col("mean")).alias("mean"),
                    r6(F.col("std")).alias("std"))


@query("percentile_label")
def percentile_label(spark, sf):
    li = ST.load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return SS.percentile_classes(li, "l_extendedprice", 0.8).select(
        "l_orderkey", "l_linenumber", "class")


@query("group_classes")
def group_classes(spark, sf):
    return VE.with_classes(spark, sf).select("vec_id", "label", "class")


@query("class_distance")
def class_distance(spark, sf):
    d = SS.class_distance_cosine(VE.with_classes(spark, sf), "label", "class")
    return d.select("label", "class", r6(F.col("dist")).alias("dist"))


@query("class_distance_euclidean")
def class_distance_euclidean(spark, sf):
    d = SS.class_distance_blocked(VE.with_classes(spark, sf), "label", "class")
    return d.select("label", "class", r6(F.col("dist")).alias("dist"))


@query("class_separation")
def class_separation(spark, sf):
    d = SS.class_distance_blocked(VE.with_classes(spark, sf), "label", "class")
    s = SS.class_separation(d, "label", "class")
    return s.select("label", r6(F.col("ratio")).alias("ratio"), r6(F.col("diff")).alias("diff"),
                    "no_lt_yes")


@query("separation_summary")
def separation_summary(spark, sf):
    d = SS.class_distance_blocked(VE.with_classes(spark, sf), "label", "class")
    s = SS.separation_summary(SS.class_separation(d, "label", "class"))
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


# ------------------------------------------------------------ linkage

from kindred.operators import linkage as LK  # noqa: E402


def _link(spark, sf, method, metric="cosine", t=None):
    v = VE.vectors(spark, sf).select(F.col("vec_id").alias("unit_id"),
                                     F.col("embedding").cast("array<double>").alias("v"))
    t = t if t is not None else (VE.T_WARD if method == "ward" else VE.T_LINK)
    pairs = N.dense_pairs(v, metric, t, id_col="unit_id", vec_col="v", forest=True)
    return LK.linkage_clusters(v, pairs, t, method, metric, "dense", "unit_id", "v")


@query("clusters_average")
def clusters_average(spark, sf):
    return _link(spark, sf, "average")


@query("clusters_complete")
def clusters_complete(spark, sf):
    return _link(spark, sf, "complete")


@query("clusters_weighted")
def clusters_weighted(spark, sf):
    return _link(spark, sf, "weighted")


@query("clusters_ward")
def clusters_ward(spark, sf):
    return _link(spark, sf, "ward", "euclidean")


@query("clusters_single_dense")
def clusters_single_dense(spark, sf):
    return _link(spark, sf, "single")


@query("kept_clusters")
def kept_clusters(spark, sf):
    """C3 + W11: single-link document clusters above 15 members, each unit's place."""
    comp = D.components(spark, sf).withColumnRenamed("component", "cluster_id")
    sizes = comp.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    kept = LK.keep_clusters(comp.join(sizes, "cluster_id"), min_size=D.DEFAULT.min_cluster)
    return S.position_in_cluster(kept, "cluster_id", "unit_id").select(
        "unit_id", "cluster_id", "cluster_size", "position")


@query("recluster")
def recluster(spark, sf):
    """C4: each kept document cluster clustered again (average linkage, cut 0.10)."""
    w = D.weights(spark, sf)
    comp = D.components(spark, sf).withColumnRenamed("component", "cluster_id")
    sizes = comp.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    kept = LK.keep_clusters(comp.join(sizes, "cluster_id"), min_size=D.DEFAULT.min_cluster)
    return recluster_units(kept.select("unit_id", F.col("cluster_id").alias("parent_cluster")), w, 0.10,
                           D.DEFAULT.vocab_take + 1)


def recluster_units(kept: DataFrame, w: DataFrame, t: float, dim: int, limit: int = 5000) -> DataFrame:
    """Average linkage below ``t`` inside each ``parent_cluster`` of ``kept``, the single-link
    clusters of a wider cut. A parent of up to ``limit`` units is one matrix. In a larger one,
    units nearer than ``t`` share their parent, and no merge below ``t`` leaves a component of
    such pairs, so it is clustered by its components (of equal heights there, rounding decides)."""
    vec, how = V.sparse_vectors(w).withColumnRenamed("vec", "v"), (t, "average", "cosine", "sparse", "unit_id", "v")
    large = store(kept.groupBy("parent_cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("parent_cluster"))
    small = LK.cluster_groups(kept.join(large, "parent_cluster", "left_anti").join(vec, "unit_id"), "parent_cluster", *how)
    if large.isEmpty():
        return small
    units = store(kept.join(large, "parent_cluster", "left_semi").select(
        F.col("unit_id").cast("long"), F.col("parent_cluster").cast("long")))
    near = N.cosine_within(w.join(units.select("unit_id"), "unit_id", "left_semi"), t, dim=dim, forest=True)
    members = C.connected_components(near, units.select("unit_id"), node_col="unit_id").join(vec, "unit_id")
    LK.check_group_sizes(members, "component", limit)
    found = LK.cluster_groups(members, "component", *how).join(units, "unit_id")
    return small.unionByName(found.select(*small.columns))


@query("cluster_merges")
def cluster_merges(spark, sf):
    """C1 merge table inside each component (average linkage)."""
    v = VE.vectors(spark, sf).select(F.col("vec_id").alias("unit_id"),
                                     F.col("embedding").cast("array<double>").alias("v"))
    pairs = N.dense_pairs(v, "cosine", VE.T_LINK, id_col="unit_id", vec_col="v", forest=True)
    comp = C.connected_components(pairs, v.select("unit_id"), node_col="unit_id")
    m = LK.component_merges(v, comp, VE.T_LINK, "average", "cosine", "dense", "unit_id", "v")
    return m.select(
        "component", "step", "left", "right", r6(F.col("height")).alias("height"), "size")


# ------------------------------------------------------------ classifiers

from kindred.operators import classify as CL  # noqa: E402
from kindred.operators import embed as EM  # noqa: E402
from kindred.operators import sampling as SA  # noqa: E402


def _emb_split(spark, sf):
    train, test = VE.train_test(spark, sf)
    return CL.features(train), CL.features(test)


def _clf(name):
    def run(spark, sf):
        train, test = _emb_split(spark, sf)
        return CL.fit_predict(name, train, test)
    return run


for _n in ["logistic", "tree", "gaussian_nb", "svm", "forest", "mlp", "lda", "adaboost"]:
    query(f"clf_{_n}")(_clf(_n))


def _doc_label_split(spark, sf):
    """Labelled documents as count vectors with ``toxic`` as the label."""
    c = D.counts(spark, sf)
    dim = D.vocabulary(spark, sf).count()
    lab = D.labels(spark, sf).select("unit_id", F.col("toxic").alias("label"))
    f = CL.dense_from_sparse(c.join(lab, "unit_id", "left_semi"), dim, value="cnt").join(lab, "unit_id")
    return SA.split(f, "unit_id", 0.25, VE.SEED)


@query("clf_naive_bayes")
def clf_naive_bayes(spark, sf):
    train, test = _doc_label_split(spark, sf)
    return CL.fit_predict("naive_bayes", train, test, id_col="unit_id")


@query("clf_all")
def clf_all(spark, sf):
    train, test = _emb_split(spark, sf)
    return CL.run_all(train, test)


@query("minmax")
def minmax(spark, sf):
    train, test = _emb_split(spark, sf)
    s = CL.minmax(train, test)
    from pyspark.ml.functions import vector_to_array
    return s.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("int"), r6(F.col("x")).alias("x"))


@query("pca")
def pca(spark, sf):
    from pyspark.ml.functions import vector_to_array
    p = CL.pca(CL.features(VE.vectors(spark, sf)), 50)
    return p.select("vec_id", vector_to_array("pca").alias("pca"))


@query("label_index")
def label_index(spark, sf):
    p = ST.load(spark, sf, "part", "p_partkey", "p_type")
    return CL.label_index(p, "p_type", "type_idx")


@query("split")
def split(spark, sf):
    train, test = VE.train_test(spark, sf)
    return train.select("vec_id", F.lit(0).alias("is_test")).unionByName(
        test.select("vec_id", F.lit(1).alias("is_test")))


@query("sample_k")
def sample_k(spark, sf):
    u = ST.load(spark, sf, "documents", "doc_id")
    return SA.sample_k(u, "doc_id", 100, seed=0).withColumnRenamed("doc_id", "unit_id")


@query("sample_replace")
def sample_replace(spark, sf):
    """2 % of the documents drawn with replacement (index = rank by id)."""
    u = ST.load(spark, sf, "documents", "doc_id")
    files = global_row_number(u, F.asc("doc_id"), name="file_idx", start=0)
    return VO.sample_files_with_replacement(files, 0.02, seed=3).select("draw", "file_idx", "doc_id")


@query("nb_per_cluster")
def nb_per_cluster(spark, sf):
    """One multinomial naive Bayes per kept cluster vs one pooled model."""
    from kindred.operators import nbgroups as NB
    comp = D.components(spark, sf).withColumnRenamed("component", "cluster_id")
    sizes = comp.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    kept = LK.keep_clusters(comp.join(sizes, "cluster_id"), min_size=D.DEFAULT.min_cluster)
    lab = D.labels(spark, sf).select("unit_id", F.col("toxic").alias("label"))
    units = kept.select("unit_id", "cluster_id").join(lab, "unit_id")
    return NB.per_group_vs_pooled(D.counts(spark, sf), units, D.vocabulary(spark, sf).count(),
                                  test_fraction=0.25, seed=VE.SEED)


# ------------------------------------------------------------ embeddings and topics

def _w2v(spark, sf):
    lists = EM.word_lists(D.units(spark, sf))
    return lists, EM.train_word_vectors(lists, size=50, min_count=20, window=10, seed=1)


@query("subsample_words")
def subsample_words(spark, sf):
    """E1's subsampling of frequent words before training."""
    lists = EM.subsample_words(EM.word_lists(D.units(spark, sf)), 1e-3, seed=1)
    return lists.select("unit_id", F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("words"))


@query("word_vectors")
def word_vectors(spark, sf):
    _, m = _w2v(spark, sf)
    return EM.word_vectors(m)


@query("unit_embedding")
def unit_embedding(spark, sf):
    lists, m = _w2v(spark, sf)
    return EM.unit_embedding(lists, EM.word_vectors(m))


def _top_words(spark, sf, n):
    return [r["name"] for r in D.vocabulary(spark, sf).orderBy("idx").limit(n).collect()]


@query("similar_words")
def similar_words(spark, sf):
    _, m = _w2v(spark, sf)
    w = _top_words(spark, sf, 2)
    return EM.most_similar(m, positive=w[:1], negative=w[1:2], n=10)


@query("word_similarity")
def word_similarity(spark, sf):
    _, m = _w2v(spark, sf)
    w = _top_words(spark, sf, 4)
    pairs = spark.createDataFrame([(a, b) for a in w for b in w if a < b], "w1 string, w2 string")
    return EM.similarity(EM.word_vectors(m), pairs)


@query("odd_one_out")
def odd_one_out(spark, sf):
    _, m = _w2v(spark, sf)
    return EM.odd_one_out(EM.word_vectors(m), _top_words(spark, sf, 4))


@query("embedding_classifier")
def embedding_classifier(spark, sf):
    """E5: unit embeddings as features of a random forest on ``toxic``."""
    lists, m = _w2v(spark, sf)
    emb = EM.unit_embedding(lists, EM.word_vectors(m))
    f = cut_lineage(CL.features(emb).join(  # the forest's fit reads its rows several times
        D.labels(spark, sf).select("unit_id", F.col("toxic").alias("label")), "unit_id"))
    train, test = SA.split(f, "unit_id", 0.25, VE.SEED)
    return CL.fit_predict("forest", train, test, id_col="unit_id")


@query("topics")
def topics(spark, sf):
    return EM.topics(D.units(spark, sf), k=5, max_iter=5, top=10)


# ------------------------------------------------------------ sets

def _lang_words(spark, sf, lang):
    d = ST.load(spark, sf, "documents", "doc_id", "text", "lang").where(F.col("lang") == lang)
    return VO.token_stream(d.withColumnRenamed("doc_id", "unit_id")).select(
        F.col("token").alias("word"))


@query("word_difference")
def word_difference(spark, sf):
    """Words of English documents that no French document has."""
    return _lang_words(spark, sf, "en").distinct().join(
        _lang_words(spark, sf, "fr").distinct(), "word", "left_anti")


@query("distinct_words")
def distinct_words(spark, sf):
    """U3."""
    return D.tokens(spark, sf).select(F.col("token").alias("word")).distinct()


@query("union_sources")
def union_sources(spark, sf):
    """One word stream from documents and benchmark items; count per word."""
    b = ST.load(spark, sf, "benchmark", "item_id", "text").withColumnRenamed("item_id", "unit_id")
    allw = D.tokens(spark, sf).unionByName(VO.token_stream(b))
    return allw.groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ streaming (S10, J8 incremental)

@query("stream_term_counts")
def stream_term_counts(spark, sf):
    """The documents table read as a file stream, vectorised batch by batch into
    a stage table in the shared folder; the stored table equals ``term_counts``."""
    import os
    import uuid
    from kindred.session import checkpoint_dir
    from kindred.streaming.shards import vectorize_stream
    base = os.path.join(checkpoint_dir(spark), "stream-" + uuid.uuid4().hex)
    docs = ST.load(spark, sf, "documents")
    vectorize_stream(spark, os.path.join(sf, "documents*.parquet"), docs.schema,
                     D.vocabulary(spark, sf), os.path.join(base, "out"), name=os.path.basename(base),
                     id_col="doc_id")
    return spark.read.parquet(os.path.join(base, "out")).select("unit_id", "idx", "cnt")


# ------------------------------------------------------------ small operators (P7, T4, T5, R2 means)

@query("long_units")
def long_units(spark, sf):
    """Units with more than 2 characters once newlines are removed."""
    u = ST.load(spark, sf, "conversations", "conv_id", "turn", "text")
    return u.where(T.long_enough("text", 2)).select("conv_id", "turn")


@query("top_words_per_lang")
def top_words_per_lang(spark, sf):
    """T5: the 5 most frequent words of each language (ties: word ascending)."""
    d = ST.load(spark, sf, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "unit_id")
    w = d.select("lang", F.explode(T.words("text")).alias("word"))
    f = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return SA.top_n_per_group(f, "lang", [F.desc("n"), F.asc("word")], 5)


@query("first_clusters")
def first_clusters(spark, sf):
    """T4 + C3: members of the first 2 kept clusters (by smallest id)."""
    comp = D.components(spark, sf).withColumnRenamed("component", "cluster_id")
    sizes = comp.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return LK.keep_clusters(comp.join(sizes, "cluster_id"), min_size=D.DEFAULT.min_cluster,
                            first_n=2).select("unit_id", "cluster_id", "cluster_size")


@query("class_means")
def class_means(spark, sf):
    """R2 averages: macro and support-weighted precision, recall and F1."""
    m = EV.class_means(EV.class_report(EV.confusion(VE.knn_predictions(spark, sf))))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


# ------------------------------------------------------------ token files to clusters

from kindred.plans import runs as RU  # noqa: E402
from kindred.plans import stages as SG  # noqa: E402

RUN_SETTINGS = D.Settings(vocab_min=5)


def _units_run(spark, sf):
    """Units of the conversation corpus, read from files once per folder and application."""
    from uuid import uuid4

    from kindred.session import scratch_path

    def build():
        tokens, sources, report, name = ST.code_corpus(spark, sf)
        at = scratch_path(spark, f"run-{uuid4().hex}")
        return at, *RU.read_units(spark, tokens, sources, report, at, name, name, keywords=["sql"])
    return D._stage(spark, ("units_run", sf), build)


@query("label_join")
def label_join(spark, sf):
    """Units of token files with the findings on their first line."""
    return _units_run(spark, sf)[1].select("file", "k", "begin_pos", "end_pos", "start_line", "end_line", "tags", "gt")


@query("run_errors")
def run_errors(spark, sf):
    """Files of the run that gave no units, with the reason."""
    return _units_run(spark, sf)[2].select("file", "reason")


def _clusters_run(spark, sf, **how):
    at, units, _ = _units_run(spark, sf)
    return SG.run(spark, units, at, s=RUN_SETTINGS, **how), units


@query("staged_run")
def staged_run(spark, sf):
    """Cluster of every unit: token files to vectors, TF-IDF, distances below 0.4 and single-link clusters."""
    return _clusters_run(spark, sf)[0]["clustering"].select("unit_id", "cluster_id")


@query("cluster_listing")
def cluster_listing(spark, sf):
    """Clusters of more than two units, with place, labels, file and source lines of each unit."""
    tables, units = _clusters_run(spark, sf, metric="euclidean", t=1.15)
    big = tables["clustering"].join(SG.cluster_sizes(tables).where("size > 2"), "cluster_id", "left_semi")
    return RU.cluster_listing(big, units).withColumn("gt_rate", r6(F.col("gt_rate")))


def _sample_run(spark, sf, rest):
    s = D.Settings()
    from uuid import uuid4

    from kindred.session import scratch_path
    at = scratch_path(spark, f"sample-{uuid4().hex}")
    return SG.run(spark, D.units(spark, sf), at, s=s, sample=300, seed=3, rest=rest)["distances"] \
        .select("i", "j", r6(F.col("dist")).alias("dist"))


@query("pairs_on_sample")
def pairs_on_sample(spark, sf):
    """Close pairs among 300 drawn documents; document frequencies of all documents."""
    return _sample_run(spark, sf, False)


@query("sample_rest")
def sample_rest(spark, sf):
    """Close pairs among the documents that are not drawn."""
    return _sample_run(spark, sf, True)

"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions import encoding, scalars, text
from pagesift.operators import (
    dedupe,
    digest,
    features,
    hashing,
    metrics,
    models,
    presence,
    selection,
    selftrain,
    split,
    tfidf,
    topics,
    triage,
    vectors,
    vocabulary,
)
from pagesift.plans import inputs
from pagesift.session import new_output, stored
from pagesift.sources import keywords, libsvm, sinks
from pagesift.sources import samples as sample_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_FITTED: dict[tuple, object] = {}

DECIMALS = 6
VECTOR_SIZE, VECTOR_EPOCHS, SWEEP_EPOCHS = 300, 55, 200


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _once(spark: SparkSession, folder: str, name: str, fit: Callable[[], object]):
    """Small fitted objects are shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, DECIMALS))
    return df


def _long(df: DataFrame, *keep: str) -> DataFrame:
    return _rounded(libsvm.to_long(df, list(keep) or ["sample_id"]), "value")


# ---- sources and sinks


@query
def scan_samples(spark, folder):
    rows = sample_sources.as_samples(inputs.page_texts(spark, folder), "sample_id", "path", "content")
    return rows.select("sample_id", "path", "name", F.sha1("content").alias("sha1"))


@query
def scan_sample_files(spark, folder):
    """The documents as files named by their ids, an empty one for an empty text, scanned again."""
    documents = inputs.table(spark, folder, "documents").filter("doc_id is not null")
    path = new_output(spark, "samples")
    sinks.write_sample_files(
        documents.select(
            F.format_string("%012d", "doc_id").alias("name"), F.col("text").alias("content")
        ),
        path,
    )
    found = sample_sources.scan_samples(spark, path)
    return found.select(
        "name", F.sha1("content").alias("sha1"), F.length("content").cast("long").alias("n_bytes")
    )


@query
def labelled_corpus(spark, folder):
    shape = ["sample_id", "content"]
    documents = inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("content")
    )
    joined = sample_sources.labelled_corpus(inputs.page_texts(spark, folder).select(*shape), documents)
    return joined.select("sample_id", "label", F.length("content").alias("chars"))


@query
def list_sample_names(spark, folder):
    path = new_output(spark, "names")
    sinks.write_lines(
        sample_sources.list_sample_names(inputs.page_texts(spark, folder)), "name", path
    )
    return spark.read.text(path).select(F.col("value").alias("name"))


@query
def corpus_manifest(spark, folder):
    path = new_output(spark, "manifest")
    sinks.write_lines(sample_sources.corpus_manifest(inputs.corpus(spark, folder)), "path", path)
    return spark.read.text(path).select(F.col("value").alias("path"))


@query
def scan_type_table(spark, folder):
    path = new_output(spark, "types")
    sample_sources.write_type_table(inputs.type_table(spark, folder), path)
    return sample_sources.scan_type_table(spark, path)


@query
def load_keywords(spark, folder):
    words = inputs.table(spark, folder, "documents").select(
        "doc_id", F.posexplode(text.whitespace_tokens(F.col("text"))).alias("place", "word")
    )
    lines = words.select(
        (F.col("doc_id") * 1_000_000_000 + F.col("place")).alias("position"),
        F.concat(F.lit(" "), F.col("word"), F.lit("\t ")).alias("line"),
    )
    trimmed = lines.withColumn("line", F.regexp_replace("line", r"\t", ""))
    return keywords.first_occurrences(trimmed)


def _frequent(spark, folder, low, high, count):
    """The most frequent terms of the corpus, numbered from zero."""
    rows = tfidf.corpus_top_terms(inputs.corpus(spark, folder), count, low, high).collect()
    numbered = [
        (i, row["term"])
        for i, row in enumerate(sorted(rows, key=lambda r: (-r["ctf"], r["term"])))
    ]
    return spark.createDataFrame(numbered, "idx int, keyword string")


@query
def load_keyword_rules(spark, folder):
    path = new_output(spark, "rules")
    keywords.as_rules(_frequent(spark, folder, 1, 1, 100)).write.parquet(path)
    return keywords.load_keyword_rules(spark, path)


@query
def merge_rule_sets(spark, folder):
    return keywords.merge_rule_sets(
        keywords.as_rules(_frequent(spark, folder, 1, 1, 100)),
        keywords.as_rules(_frequent(spark, folder, 2, 3, 100)),
    )


@query
def read_libsvm(spark, folder):
    path = new_output(spark, "features")
    sinks.write_lines(inputs.feature_lines(spark, folder), "line", path)
    return libsvm.to_long(libsvm.read_libsvm(spark, path), ["label", "comment"])


@query
def write_libsvm(spark, folder):
    path = new_output(spark, "libsvm")
    found = _keyword_rows(spark, folder).withColumn("label", F.lit(1))
    libsvm.write_libsvm(found, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def dump_matrix_libsvm(spark, folder):
    path = new_output(spark, "matrix")
    matrix = _weights23(spark, folder).withColumn("features", tfidf.vector_features("tfidf"))
    libsvm.dump_matrix_libsvm(matrix, path, decimals=DECIMALS)
    return spark.read.text(path).select(
        F.col("label").cast("int").alias("label"), F.col("value").alias("line")
    )


@query
def dump_matrix_dense(spark, folder):
    path = new_output(spark, "dense")
    rows = sinks.dense_rows(_weights23(spark, folder), "tfidf", ["sample_id"])
    rows.write.parquet(path)
    numbers = F.transform("row", lambda v: F.format_string("%.6f", F.round(v, DECIMALS)))
    return spark.read.parquet(path).select("sample_id", F.array_join(numbers, " ").alias("line"))


@query
def dump_vocabulary(spark, folder):
    path = new_output(spark, "vocabulary")
    vocabulary = _model23(spark, folder).vocabulary(spark).orderBy("idx")
    sinks.write_lines(vocabulary, "term", path)
    return spark.read.text(path).select(F.col("value").alias("term"))


@query
def route_samples(spark, folder):
    path = new_output(spark, "routes")
    routed = triage.triage_routes(
        inputs.hashed_samples(spark, folder),
        inputs.type_table(spark, folder),
        ["sample_id", "path", "content"],
    )
    sinks.route_samples(routed, path)
    return spark.read.parquet(path).select("sample_id", F.length("content").alias("chars"), "route")


@query
def route_by_score(spark, folder):
    path = new_output(spark, "buckets")
    sinks.route_by_score(selftrain.bucketed(inputs.scored(spark, folder)), path)
    return (
        spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"))
    )


@query
def misclassified_rows(spark, folder):
    path = new_output(spark, "misclassified")
    scored = metrics.union_models({"hashed": inputs.scored(spark, folder)})
    sinks.write_misclassified(metrics.misclassified_rows(scored), path)
    return spark.read.parquet(path).select("sample_id", "label", "score", "model", "outcome")


@query
def validation_sets(spark, folder):
    return sample_sources.validation_sets(inputs.labelled_paths(spark, folder)).select(
        "sample_id", "set_name", "label"
    )


# ---- scalar operators


@query
def strip_leading(spark, folder):
    return inputs.encoded(spark, folder).select(
        "sample_id", F.sha1(encoding.strip_leading(F.col("content"))).alias("sha1")
    )


@query
def detect_encoding(spark, folder):
    return inputs.encoded(spark, folder).select(
        "sample_id", encoding.detect_encoding(F.col("content")).alias("encoding")
    )


@query
def narrow_encoding(spark, folder):
    content = F.col("content")
    detected = encoding.detect_encoding(content)
    return (
        inputs.encoded(spark, folder)
        .withColumn("encoding", detected)
        .select(
            "sample_id",
            F.sha1(encoding.narrow_encoding(content, F.col("encoding"))).alias("sha1"),
        )
    )


@query
def triage_code(spark, folder):
    return triage.with_triage_code(inputs.samples(spark, folder)).select("sample_id", "code")


@query
def triage_route(spark, folder):
    coded = triage.with_triage_code(inputs.samples(spark, folder))
    return coded.select("sample_id", triage.route_of_code(F.col("code")).alias("route"))


@query
def label_from_path(spark, folder):
    return inputs.labelled_paths(spark, folder).select(
        "sample_id", scalars.label_from_path(F.col("path")).alias("label")
    )


@query
def path_from_line(spark, folder):
    return inputs.feature_lines(spark, folder).select(
        scalars.path_from_line(F.col("line")).alias("path")
    )


@query
def positive_only(spark, folder):
    hashed = hashing.with_hashed_features(inputs.corpus(spark, folder))
    return hashed.select(
        "sample_id",
        F.size("features").alias("entries"),
        F.size(libsvm.positive_only(F.col("features"))).alias("positive"),
    )


@query
def stop_number_tokens(spark, folder):
    words = inputs.corpus(spark, folder).select(
        F.filter(text.ascii_words(F.col("content")), text.is_number_token).alias("words")
    )
    return (
        text.explode_values(words, "words", "word", [])
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _weight_features(spark, folder):
    return _weights23(spark, folder).withColumn("features", tfidf.vector_features("tfidf"))


@query
def binarise(spark, folder):
    rows = _weight_features(spark, folder)
    return _long(rows.withColumn("features", tfidf.binarised(F.col("features"))))


@query
def select_columns(spark, folder):
    model = _model23(spark, folder)
    frequent = sorted(
        range(len(model.terms)), key=lambda i: (-model.document_frequencies[i], model.terms[i])
    )[:100]
    rows = _weight_features(spark, folder)
    return _long(
        rows.withColumn("features", tfidf.selected_columns(F.col("features"), frequent))
    )


@query
def rebase_index(spark, folder):
    rows = _weight_features(spark, folder)
    return _long(
        rows.withColumn("features", tfidf.rebased(F.col("features"), keywords.NGRAM_BASE))
    )


@query
def decide(spark, folder):
    return inputs.scored(spark, folder).select(
        "sample_id", scalars.decide(F.col("score"), 0.5).alias("decision")
    )


@query
def score_bucket(spark, folder):
    return inputs.scored(spark, folder).select(
        "sample_id", scalars.score_bucket(F.col("score")).alias("bucket")
    )


@query
def digest_nibbles(spark, folder):
    hashed = inputs.page_texts(spark, folder).withColumn("sha1", F.sha1("content"))
    return _long(hashed.withColumn("features", digest.digest_nibbles(F.col("sha1"))))


@query
def unlabelled_features(spark, folder):
    routed = triage.triage_routes(
        inputs.hashed_samples(spark, folder),
        inputs.type_table(spark, folder),
        ["sample_id", "path", "content"],
    ).filter(F.startswith("route", F.lit("uncertain/")))
    rows = presence.with_rule_presence(routed.withColumn("label", F.lit(0)), inputs.RULES)
    return rows.select(
        "sample_id",
        libsvm.format_line(F.col("label"), F.col("features"), F.col("path")).alias("line"),
    )


# ---- joins


@query
def type_lookup(spark, folder):
    return triage.triage_routes(
        inputs.hashed_samples(spark, folder), inputs.type_table(spark, folder), ["sample_id"]
    ).select("sample_id", "route")


def _keyword_rows(spark, folder):
    return presence.with_keyword_presence(inputs.page_texts(spark, folder), inputs.KEYWORDS)


@query
def keyword_presence(spark, folder):
    return _long(_keyword_rows(spark, folder))


@query
def rule_presence(spark, folder):
    return _long(presence.with_rule_presence(inputs.page_texts(spark, folder), inputs.SINGLE_RULES))


@query
def ngram_rule_presence(spark, folder):
    return _long(presence.with_rule_presence(inputs.page_texts(spark, folder), inputs.RULES))


@query
def rule_table_presence(spark, folder):
    """The words of all documents as rules, more than a literal set holds, in the pages."""
    words = inputs.table(spark, folder, "documents").select(
        F.array_distinct(
            F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
        ).alias("words")
    )
    index = F.conv(F.substring(F.md5(F.col("keyword").cast("binary")), 1, 7), 16, 10).cast("int")
    rules = (
        text.explode_values(words, "words", "keyword", [])
        .distinct()
        .select(index.alias("idx"), "keyword", F.lit(True).alias("fullword"), F.lit(True).alias("nocase"))
    )
    found = presence.rule_presence(inputs.page_texts(spark, folder), stored(rules, "rules"))
    return libsvm.to_long(found, ["sample_id"])


@query
def features_for_samples(spark, folder):
    coded = triage.with_triage_code(inputs.samples(spark, folder))
    log = coded.filter(F.col("code").isin(0, 2)).select(
        F.concat(F.lit("# /data/s/"), F.col("sample_id").cast("string"), F.lit(" @ open")).alias("line")
    )
    return dedupe.features_for_samples(inputs.feature_lines(spark, folder), log)


def _known(spark, folder):
    coded = triage.with_triage_code(inputs.samples(spark, folder))
    return coded.filter(F.col("code").isin(12, 22)).select("path")


@query
def dedupe_against(spark, folder):
    target = inputs.samples(spark, folder).select("sample_id", "path")
    kept, removed = dedupe.dedupe_against(target, _known(spark, folder))
    return kept.withColumn("state", F.lit("kept")).unionByName(
        removed.withColumn("state", F.lit("removed"))
    )


@query
def merge_features(spark, folder):
    left = libsvm.to_long(_keyword_rows(spark, folder), ["sample_id"])
    right = libsvm.to_long(
        presence.with_rule_presence(inputs.page_texts(spark, folder), inputs.RULES), ["sample_id"]
    ).withColumn("value", F.lit(2.0))
    return features.merge_features(left, right)


@query
def attach_scores(spark, folder):
    documents = inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), "lang"
    )
    return features.attach_scores(documents, inputs.scored(spark, folder))


@query
def restrict_to_vocabulary(spark, folder):
    frequencies = tfidf.corpus_term_frequency(inputs.corpus(spark, folder), ["sample_id"], 2, 3)
    return features.restrict_to_vocabulary(frequencies, _model23(spark, folder).vocabulary(spark))


# ---- aggregates


@query
def class_counts(spark, folder):
    return metrics.class_counts(inputs.corpus(spark, folder))


@query
def prior_threshold(spark, folder):
    return _rounded(metrics.prior_threshold(inputs.corpus(spark, folder)), "threshold")


@query
def distinct_names(spark, folder):
    return dedupe.distinct_names(inputs.samples(spark, folder))


@query
def term_frequency(spark, folder):
    termed = tfidf.with_terms(inputs.corpus(spark, folder), 1, 1)
    return tfidf.term_frequency(termed, ["sample_id"])


@query
def document_frequency(spark, folder):
    termed = tfidf.with_terms(inputs.corpus(spark, folder), 1, 2)
    return tfidf.document_frequency(tfidf.term_frequency(termed, ["sample_id"]))


def _model23(spark, folder) -> tfidf.TfidfModel:
    return _once(
        spark, folder, "tfidf23", lambda: tfidf.fit_tfidf(inputs.corpus(spark, folder), 300, 2, 3)
    )


def _weights23(spark, folder):
    return _model23(spark, folder).transform(inputs.corpus(spark, folder))


def _stored_weights(spark, folder):
    """(sample_id, label, path, tfidf) as a written table."""
    return _once(
        spark,
        folder,
        "weights23",
        lambda: stored(_weights23(spark, folder).drop("content"), "weights"),
    )


def _ranking23(spark, folder) -> selection.Ranking:
    return _once(
        spark,
        folder,
        "ranking23",
        lambda: selection.select_features(_stored_weights(spark, folder)),
    )


@query
def tfidf_weights(spark, folder):
    terms = _model23(spark, folder).vocabulary(spark)
    long = libsvm.to_long(_weight_features(spark, folder), ["sample_id"])
    named = long.join(F.broadcast(terms), "idx").select("sample_id", "term", "value")
    return _rounded(named, "value")


QUERIES["tfidf"] = QUERIES.pop("tfidf_weights")


@query
def tfidf_table(spark, folder):
    """Weights of more terms than the driver would hold."""
    corpus = inputs.corpus(spark, folder)
    model = vocabulary.fit_tfidf_table(corpus, tfidf.MAX_TERMS + 50_000, 2, 3)
    return _long(model.transform(corpus).drop("content"))


@query
def confusion(spark, folder):
    return metrics.confusion(inputs.scored(spark, folder), ["set_name"])


_RATES = ["accuracy", "precision", "recall", "fpr", "fdr", "f1", "f2", "auc"]


def _all_metrics(spark, folder):
    return metrics.metrics(inputs.scored(spark, folder), [])


QUERIES["metrics"] = lambda spark, folder: _rounded(_all_metrics(spark, folder), *_RATES)


@query
def auc(spark, folder):
    return _rounded(metrics.auc(inputs.scored(spark, folder), ["set_name"]), "auc")


@query
def validation_metrics(spark, folder):
    return _rounded(metrics.metrics(inputs.scored(spark, folder), ["set_name"]), *_RATES)


def _dictionary(spark, folder):
    return topics.build_dictionary(inputs.corpus(spark, folder))


@query
def build_dictionary(spark, folder):
    return _dictionary(spark, folder)


@query
def doc_bow(spark, folder):
    documents = inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("content")
    )
    return topics.doc_bow(documents, _dictionary(spark, folder))


@query
def script_count(spark, folder):
    return triage.script_count(triage.with_triage_code(inputs.samples(spark, folder)))


@query
def triage_summary(spark, folder):
    routed = triage.triage_routes(
        inputs.hashed_samples(spark, folder), inputs.type_table(spark, folder), ["sample_id"]
    )
    return triage.triage_summary(routed)


# ---- rankings


@query
def top_terms(spark, folder):
    return tfidf.corpus_top_terms(inputs.corpus(spark, folder), 300, 2, 3)


@query
def vocabulary_index(spark, folder):
    return _model23(spark, folder).vocabulary(spark).select("idx", "term")


def _ranked(spark, folder):
    return selection.importance_rank(spark, _ranking23(spark, folder), _model23(spark, folder))


# A forest's importances have no SQL form. These queries give what holds for each of them and can
# be recomputed: completeness, ranks, order and form of the full output.


@query
def importance_rank(spark, folder):
    """Every term once, with falling importance along the ranks."""
    following = W.orderBy("rank")
    before = F.lag("importance").over(following)
    return _ranked(spark, folder).select(
        "idx",
        "term",
        (
            (F.col("rank") == F.row_number().over(following))
            & F.coalesce(before >= F.col("importance"), F.lit(True))
        ).alias("in_order"),
    )


@query
def select_features(spark, folder):
    """Every column has an importance, and they sum up to one."""
    ranked = _ranked(spark, folder)
    total = ranked.agg(F.sum("importance").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select(
        "idx",
        (F.col("importance").between(0, 1) & (F.abs(F.col("total") - 1) < 1e-6)).alias("weighed"),
    )


@query
def top_features(spark, folder):
    best = selection.top_features(_ranked(spark, folder), 100)
    return best.agg(F.count(F.lit(1)).alias("features"), F.max("rank").alias("last_rank"))


@query
def importance_report(spark, folder):
    """Rank, index and term read back from the report lines."""
    form = r"^(\d+)\.feature (\d+) (.*) \(([^()]+)\)$"
    part = lambda n: F.regexp_extract("line", form, n)
    lines = selection.importance_report(_ranked(spark, folder))
    return lines.select(
        part(2).cast("int").alias("idx"),
        part(3).alias("term"),
        ((part(1).cast("int") == F.col("rank")) & (part(4).cast("double") >= 0)).alias("ranked"),
    )


@query
def generate_rules(spark, folder):
    """Numbers of rules, of their terms in the vocabulary, and their last index."""
    rules = selection.generate_rules(_ranked(spark, folder))
    terms = _model23(spark, folder).vocabulary(spark)
    known = rules.join(
        terms, (rules["vocab_id"] == terms["idx"]) & (rules["keyword"] == terms["term"]), "left"
    )
    return known.agg(
        F.count(F.lit(1)).alias("rules"),
        F.count("term").alias("in_vocabulary"),
        F.max(rules["idx"]).alias("last_idx"),
        F.bool_and(F.col("fullword") & F.col("nocase")).alias("bounded"),
    )


@query
def ordered_features(spark, folder):
    rows = _keyword_rows(spark, folder)
    pairs = F.transform(
        libsvm.ordered(F.reverse("features")),
        lambda f: F.concat_ws(":", f["idx"].cast("string"), f["value"].cast("int").cast("string")),
    )
    return rows.select("sample_id", F.array_join(pairs, " ").alias("pairs"))


# ---- splits


@query
def split_by_rate(spark, folder):
    parts = split.split_by_rate(inputs.corpus(spark, folder).select("sample_id", "label"))
    return parts


@query
def train_test_sets(spark, folder):
    parts = split.split_by_rate(inputs.corpus(spark, folder).select("sample_id", "label"))
    train, test = split.train_test_sets(parts)
    return train.withColumn("set_name", F.lit("train")).unionByName(
        test.withColumn("set_name", F.lit("test"))
    )


@query
def full_refit_set(spark, folder):
    parts = split.split_by_rate(inputs.corpus(spark, folder).select("sample_id", "label"))
    return split.full_refit_set(*split.train_test_sets(parts))


# ---- feature jobs


def _lines(df):
    return df.select(
        "sample_id",
        libsvm.format_line(F.col("label"), F.col("features"), F.col("path"), DECIMALS).alias("line"),
    )


@query
def keyword_features(spark, folder):
    return _lines(presence.with_keyword_presence(inputs.corpus(spark, folder), inputs.KEYWORDS))


@query
def rule_features(spark, folder):
    rows = inputs.encoded(spark, folder).withColumn("label", F.lit(1)).withColumn(
        "path", F.col("sample_id").cast("string")
    )
    return _lines(features.rule_features(rows, inputs.RULES))


@query
def trigram_features(spark, folder):
    single = [(i, k) for i, k in inputs.SINGLE_RULES]
    ngram = [(i - keywords.NGRAM_BASE, k) for i, k in inputs.NGRAM_RULES]
    shape = "idx int, keyword string"
    merged = keywords.merge_rule_sets(
        keywords.as_rules(spark.createDataFrame(single, shape)),
        keywords.as_rules(spark.createDataFrame(ngram, shape)),
    )
    rules = presence.read_dictionary(merged)
    return _lines(presence.with_rule_presence(inputs.corpus(spark, folder), rules))


def _keyword_tfidf(spark, folder):
    return features.keyword_tfidf_features(
        inputs.corpus(spark, folder),
        inputs.SINGLE_RULES,
        _model23(spark, folder),
        _ranking23(spark, folder),
    )


@query
def keyword_tfidf_features(spark, folder):
    return _lines(_keyword_tfidf(spark, folder))


def _model13(spark, folder, terms, strip):
    return _once(
        spark,
        folder,
        f"tfidf13-{terms}",
        lambda: tfidf.fit_tfidf(inputs.corpus(spark, folder), terms, 1, 3, strip_accents=strip),
    )


@query
def tfidf_features(spark, folder):
    model = _model13(spark, folder, 1000, True)
    corpus = inputs.corpus(spark, folder)
    ranking = selection.select_features(model.transform(corpus))
    return _lines(features.tfidf_features(corpus, model, ranking))


@query
def tfidf_rank_features(spark, folder):
    model = _model13(spark, folder, 300, False)
    corpus = inputs.corpus(spark, folder)
    ranking = selection.select_features(model.transform(corpus))
    rows = features.tfidf_rank_features(corpus, model, ranking)
    return rows.select(
        "sample_id", libsvm.format_line(F.col("label"), F.col("features"), None).alias("line")
    )


# The same jobs with a ranking by document frequency, which SQL can recompute to the last value.


def _by_documents(model) -> selection.Ranking:
    found = model.document_frequencies
    order = sorted(range(len(found)), key=lambda i: (-found[i], model.terms[i]))
    return selection.Ranking(tuple(order), tuple(map(float, found)))


@query
def keyword_tfidf_features_by_documents(spark, folder):
    model = _model23(spark, folder)
    corpus = inputs.corpus(spark, folder)
    return _lines(
        features.keyword_tfidf_features(corpus, inputs.SINGLE_RULES, model, _by_documents(model))
    )


@query
def tfidf_features_by_documents(spark, folder):
    model = _model13(spark, folder, 1000, True)
    rows = features.tfidf_features(inputs.corpus(spark, folder), model, _by_documents(model))
    return _long(rows)


@query
def tfidf_rank_features_by_documents(spark, folder):
    model = _model13(spark, folder, 300, False)
    rows = features.tfidf_rank_features(inputs.corpus(spark, folder), model, _by_documents(model))
    return rows.select(
        "sample_id", libsvm.format_line(F.col("label"), F.col("features"), None).alias("line")
    )


@query
def hashing_features(spark, folder):
    hashed = hashing.with_hashed_features(inputs.corpus(spark, folder))
    return _long(hashed.withColumn("features", libsvm.positive_only(F.col("features"))))


@query
def digest_features(spark, folder):
    rows = digest.with_digest(inputs.corpus(spark, folder)).withColumn(
        "features", libsvm.positive_only(digest.digest_nibbles(F.col("digest")))
    )
    return _long(rows)


# ---- models


def _vectors(spark, folder):
    """(sample_id, label, path, features vector): rule and n-gram features."""
    width = keywords.NGRAM_BASE + len(_model23(spark, folder).terms)
    rows = features.with_indicator_vector(_keyword_tfidf(spark, folder), width)
    return rows.select("sample_id", "label", "path", F.col("vector").alias("features"))


def _parts(spark, folder):
    return split.train_test_sets(split.split_by_rate(_stored_weights(spark, folder)))


def _trained(spark, folder, name="xgboost"):
    train, _ = _parts(spark, folder)
    return _once(spark, folder, f"model-{name}", lambda: models.train(train, name, "tfidf"))


def _scored(spark, folder, name="xgboost"):
    train, test = _parts(spark, folder)
    both = train.withColumn("set_name", F.lit("train")).unionByName(
        test.withColumn("set_name", F.lit("test"))
    )
    return models.score_samples(
        _trained(spark, folder, name), both, ["sample_id", "label", "set_name"], "tfidf"
    )


@query
def train_and_score(spark, folder):
    """Keyword and n-gram features, threshold at the class prior."""
    threshold = metrics.prior_threshold(inputs.corpus(spark, folder)).first()["threshold"]
    rows = stored(_vectors(spark, folder), "vectors")
    train, test = split.train_test_sets(split.split_by_rate(rows))
    model = models.train(train)
    both = train.withColumn("set_name", F.lit("train")).unionByName(
        test.withColumn("set_name", F.lit("test"))
    )
    scored = models.score_samples(model, both, ["sample_id", "label", "set_name"])
    return _totals(metrics.metrics(scored, ["set_name"], threshold), "set_name")


def _variant_rows(spark, folder, name):
    """(sample_id, label, features vector) of one kind of features, as a written table."""
    corpus = inputs.corpus(spark, folder)
    if name == "keyword":
        rows = presence.with_keyword_presence(corpus, inputs.KEYWORDS)
        rows = features.with_indicator_vector(rows, len(inputs.KEYWORDS))
    elif name == "rules":
        rows = presence.with_rule_presence(corpus, inputs.RULES)
        rows = features.with_indicator_vector(rows, max(i for i, _ in inputs.RULES) + 1)
    elif name == "digest":
        rows = digest.with_digest(corpus).withColumn(
            "features", digest.digest_nibbles(F.col("digest"))
        )
        rows = features.with_feature_vector(rows, digest.WIDTH)
    elif name == "hashing":
        rows = features.with_feature_vector(hashing.with_hashed_features(corpus), 100)
    else:
        rows = _document_vectors(spark, folder)
    return _once(
        spark,
        folder,
        f"variant-{name}",
        lambda: stored(rows.select("sample_id", "label", F.col("vector").alias("features")), name),
    )


def _variant_metrics(spark, folder, name, prior=False):
    """Metrics of a model of one kind of features on its training and test sets."""
    threshold = 0.5
    if prior:
        threshold = metrics.prior_threshold(inputs.corpus(spark, folder)).first()["threshold"]
    rows = _variant_rows(spark, folder, name)
    _, scored = models.train_and_score(*split.train_test_sets(split.split_by_rate(rows)))
    return metrics.metrics(scored, ["set_name"], threshold)


@query
def train_keyword(spark, folder):
    return _totals(_variant_metrics(spark, folder, "keyword"), "set_name")


@query
def train_rules(spark, folder):
    """Rules, threshold at the class prior."""
    return _totals(_variant_metrics(spark, folder, "rules", prior=True), "set_name")


@query
def train_digest(spark, folder):
    """Digests, which texts under fifty ASCII characters do not have."""
    return _totals(_variant_metrics(spark, folder, "digest"), "set_name")


@query
def train_hashing(spark, folder):
    return _totals(_variant_metrics(spark, folder, "hashing"), "set_name")


@query
def train_vectors(spark, folder):
    return _totals(_variant_metrics(spark, folder, "vectors"), "set_name")


@query
def refit_model(spark, folder):
    """The final model: fitted on training and test sets together, saved, read back, applied to all."""
    rows = _variant_rows(spark, folder, "hashing")
    train, test = split.train_test_sets(split.split_by_rate(rows))
    path = new_output(spark, "refit")
    models.save_model(models.train(split.full_refit_set(train, test)), path)
    return _probability(models.score_samples(models.load_model(path), rows, ["sample_id"]), "sample_id")


def _totals(table, by):
    """Rows of each class behind the metrics, and whether the rates are in range and better than
    chance, as models of these features are."""
    rates = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in _RATES]
    sound = F.col("auc") > 0.5
    for rate in rates:
        sound = sound & rate
    return table.select(
        by,
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("tn") + F.col("fp")).alias("negatives"),
        sound.alias("sound"),
    )


def _probability(scored, *keep):
    return scored.select(*keep, F.col("score").between(0, 1).alias("probability"))


@query
def make_classifier(spark, folder):
    """Every sample scored by a model of each kind."""
    scored = {n: _scored(spark, folder, n) for n in models.model_names("svm|xgboost|keras")}
    return _probability(metrics.union_models(scored), "model", "sample_id")


@query
def model_metrics(spark, folder):
    scored = {n: _scored(spark, folder, n) for n in models.model_names("svm|xgboost|keras")}
    test = metrics.union_models(scored).filter(F.col("set_name") == "test")
    return _totals(metrics.metrics(test, ["model"]), "model")


@query
def scoring_time(spark, folder):
    times = metrics.scoring_time(
        spark, {n: _scored(spark, folder, n) for n in models.model_names("svm|xgboost")}
    )
    return times.select("model", (F.col("seconds") > 0).alias("timed"))


@query
def score_samples(spark, folder):
    return _probability(_scored(spark, folder), "sample_id")


@query
def save_model(spark, folder):
    """Whether the saved model, read back, scores each sample as the one in memory."""
    path = new_output(spark, "model")
    models.save_model(_trained(spark, folder), path)
    rows = _stored_weights(spark, folder)
    saved = models.score_samples(models.load_model(path), rows, ["sample_id"], "tfidf")
    kept = models.score_samples(_trained(spark, folder), rows, ["sample_id"], "tfidf")
    both = saved.join(kept.withColumnRenamed("score", "own"), "sample_id")
    return both.select("sample_id", (F.col("score") == F.col("own")).alias("same"))


@query
def load_model(spark, folder):
    """Scores of a model found by its configuration."""
    path = new_output(spark, "model")
    models.save_model(_trained(spark, folder), path)
    parent, name = path.rsplit("/", 1)
    loaded = models.load_model(
        config={"filesystem": {"mid_folder": parent}, "model": {"xgboost": {"model_name": name}}}
    )
    rows = _stored_weights(spark, folder)
    return _probability(models.score_samples(loaded, rows, ["sample_id"], "tfidf"), "sample_id")


@query
def route_feature_file(spark, folder):
    """From feature files of unlabelled samples to folders: read, score by a saved model, route.

    Labelled samples train and save the model; the feature lines of the others are written, read
    back, scored and written below their score bucket.
    """
    rows = _keyword_tfidf(spark, folder)
    width = keywords.NGRAM_BASE + len(_model23(spark, folder).terms)
    known = inputs.training_state() == "labelled"
    model_path, line_path = new_output(spark, "model"), new_output(spark, "unlabelled")
    shaped = features.with_indicator_vector(rows.filter(known), width)
    models.save_model(
        models.train(shaped.select("sample_id", "label", F.col("vector").alias("features"))), model_path
    )
    unlabelled = rows.filter(~known).withColumn("label", F.lit(0))
    libsvm.write_libsvm(
        unlabelled.withColumn("path", F.col("sample_id").cast("string")), line_path
    )
    read = features.with_indicator_vector(libsvm.read_libsvm(spark, line_path), width)
    scored = models.score_samples(models.load_model(model_path), read, ["comment"], "vector")
    bucket_path = new_output(spark, "scored")
    sinks.route_by_score(selftrain.bucketed(scored), bucket_path)
    routed = spark.read.parquet(bucket_path)
    low = F.substring_index("bucket", "_", 1).cast("int") / 10
    return routed.select(
        F.col("comment").cast("bigint").alias("sample_id"),
        F.col("score").between(low, low + 0.1 + 1e-9).alias("in_bucket"),
    )


@query
def self_train_round(spark, folder):
    rows = _stored_weights(spark, folder).withColumnRenamed("tfidf", "features")
    rows = rows.withColumn("state", inputs.training_state())
    labelled, uncertain, report = selftrain.self_train_round(
        rows.filter(F.col("state") == "labelled"),
        rows.filter(F.col("state") == "uncertain"),
    )
    # each sample is in one of the sets once, and the report accounts for those that moved
    moved = report.agg(F.sum(F.col("added_1") + F.col("added_0"))).first()[0]
    both = labelled.select("sample_id", F.lit(1).alias("known")).unionByName(
        uncertain.select("sample_id", F.lit(0).alias("known"))
    )
    return both.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("sample_id").alias("distinct_samples"),
        (F.sum("known") - F.lit(moved)).alias("labelled_before"),
    )


# ---- vectors and topics


def _document_vectors(spark, folder):
    corpus = inputs.corpus(spark, folder)
    model = _once(spark, folder, "words", lambda: vectors.fit_vectors(corpus, VECTOR_SIZE, epochs=VECTOR_EPOCHS))
    return model.transform(corpus).withColumn("features", vectors.vector_features())


@query
def doc_vectors(spark, folder):
    """Every sample has a vector of the model's size without missing numbers."""
    values = vector_to_array("vector")
    return _document_vectors(spark, folder).select(
        "sample_id",
        F.size(values).alias("size"),
        F.forall(values, lambda v: ~F.isnan(v)).alias("complete"),
    )


@query
def doc_vector_features(spark, folder):
    """Label and path read back from the feature lines, whose features are positive and in range."""
    parsed = libsvm.parse_line(_lines(_document_vectors(spark, folder)), "line")
    return parsed.select(
        "label",
        F.col("comment").alias("path"),
        F.forall("features", lambda f: f["idx"].between(0, VECTOR_SIZE - 1) & (f["value"] > 0)).alias(
            "in_range"
        ),
    )


def _validation(spark, folder):
    """(sample_id, label, path, content, set_name): the labelled documents, a set per source."""
    documents = inputs.table(spark, folder, "documents")
    return documents.join(inputs.table(spark, folder, "labels"), "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.col("toxic").alias("label"),
        F.concat(F.lit("/data/d/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
        F.col("source").alias("set_name"),
    )


def _sweep(spark, folder):
    """Metrics of the sweep, and the folder of its feature files."""

    def run():
        files = new_output(spark, "feature-sets")
        table = vectors.sweep_vector_size(
            inputs.corpus(spark, folder),
            _validation(spark, folder),
            [10, 20],
            epochs=SWEEP_EPOCHS,
            feature_path=files,
        )
        return table, files

    return _once(spark, folder, "sweep", run)


@query
def sweep_vector_size(spark, folder):
    """Samples behind the metrics of each size and set."""
    table, _ = _sweep(spark, folder)
    counts = table.filter(F.col("metric").isin("tp", "tn", "fp", "fn"))
    return counts.groupBy("size", "set_name").agg(F.sum("value").cast("bigint").alias("samples"))


@query
def sweep_metrics(spark, folder):
    """The metrics themselves, which depend on the fitted models."""
    return _sweep(spark, folder)[0]


@query
def feature_sets(spark, folder):
    """Label, path and value range read back from the feature files of every size and set."""
    read = spark.read.text(_sweep(spark, folder)[1])
    # partition columns beside the line
    parsed = libsvm.parse_line(
        read.withColumn("value", F.concat_ws("", "value", F.lit(" @"), "size", F.lit(" "), "set_name"))
    )
    tail = F.split(F.substring_index("comment", " @", -1), " ", 2)
    size = tail[0].cast("int")
    return parsed.select(
        size.alias("size"),
        tail[1].alias("set_name"),
        "label",
        F.regexp_extract("comment", r"^(.*) @", 1).alias("path"),
        F.forall("features", lambda f: f["idx"].between(0, size - 1) & (f["value"] > 0)).alias("in_range"),
    )


def _topic_form(ranked):
    """Ranks of each topic from one without gaps, terms once, weights positive and falling."""
    by_topic = W.partitionBy("topic").orderBy("rank")
    before = F.lag("weight").over(by_topic)
    ordered = ranked.withColumn(
        "fine",
        (F.col("rank") == F.row_number().over(by_topic))
        & (F.col("weight") >= 0)
        & F.coalesce(before >= F.col("weight"), F.lit(True)),
    )
    return ordered.groupBy("topic").agg(
        F.countDistinct("term").alias("terms"), F.bool_and("fine").alias("in_order")
    )


@query
def lda_topics(spark, folder):
    model = topics.fit_lda(_stored_weights(spark, folder))
    return _topic_form(topics.lda_topics(spark, model, _model23(spark, folder).terms))


def _nmf(spark, folder):
    rows = _stored_weights(spark, folder).select(
        "sample_id", tfidf.vector_features("tfidf").alias("features")
    )
    return topics.fit_nmf(rows, len(_model23(spark, folder).terms))


@query
def nmf_topics(spark, folder):
    found = topics.nmf_topics(spark, _nmf(spark, folder), _model23(spark, folder).terms)
    return _topic_form(found)


@query
def topic_top_words(spark, folder):
    model = topics.fit_lda(_stored_weights(spark, folder))
    ranked = topics.lda_topics(spark, model, _model23(spark, folder).terms)
    listed = ranked.groupBy("topic").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]),
            " ",
        ).alias("words")
    )
    # n-grams of two and three words
    return listed.select("topic", (F.size(F.split("words", " ")) >= 200).alias("complete"))

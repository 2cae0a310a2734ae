"""Text cleaning, text features and term statistics."""

from __future__ import annotations

import json
import math
import sys
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import lexicon as L
from veriloom.functions.columns import col
from veriloom.functions.skew import lookup_join, written_lookup
from veriloom.operators.wordvec import WordVectors, fit_word2vec
from veriloom.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

# Limits of words and of the vocabulary.
MIN_WORD, MAX_WORD = 2, 20
VOCABULARY, MIN_DF, MAX_DF = 5000, 2, 0.95
#: Forms of a lemma table that goes to the tasks, if its files are small as well.
MAX_LEMMAS = 200_000


def expand_contractions(text: str | Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), L.CONTRACTIONS, col(text))


def normalized(text: str | Column, min_chars: int | None = None, max_chars: int | None = None) -> Column:
    """Trimmed, expanded, lower-cased, single-spaced; blank if shorter or longer than the limits given."""
    trimmed = F.btrim(col(text), F.lit(" " + L.OTHER_SPACE))
    flat = F.regexp_replace(F.lower(expand_contractions(trimmed)), L.UNTIDY_SPACE, " ")
    if min_chars is None and max_chars is None:
        return flat
    return once(flat, lambda t: F.when((F.length(t) >= (min_chars or 0)) & (F.length(t) <= (max_chars or 2**31 - 1)), t).otherwise(""))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.transform(F.array(value), use)[0]


def tokens(text: str | Column, drop_digits: bool = False, stopwords: Sequence[str] = tuple(L.STOPWORDS),
           min_chars: int | None = None, max_chars: int | None = None) -> Column:
    """Cleaned tokens in order, of whole texts unless limits are given."""
    # empty words are dropped below, so only lengths need runs of white space as one
    bare = min_chars is None and max_chars is None
    flat = F.lower(expand_contractions(text)) if bare else normalized(text, min_chars, max_chars)
    if drop_digits:
        flat = F.regexp_replace(flat, r"\d+", "")
    words = F.split(F.translate(flat, L.OTHER_SPACE + L.PUNCTUATION, " " * len(L.OTHER_SPACE)), " ")
    return F.filter(words, lambda w: F.length(w).between(MIN_WORD, MAX_WORD) & ~w.isin(list(stopwords)))


def clean(text: str | Column, **options) -> Column:
    return F.coalesce(F.array_join(tokens(text, **options), " "), F.lit(""))


def _replaced(lists, forms: pa.Array, lemmas: pa.Array) -> pa.ListArray:
    """Lists of tokens with the lemma in place of each form of a table; a null list becomes empty."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words, lengths = column.flatten().cast(pa.string()), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = lemmas.take(pc.index_in(words, value_set=forms)) if len(forms) else pa.nulls(len(words), pa.string())
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pc.coalesce(found, words))


def lemmatize(df: DataFrame, key: str, token_column: str, lemmas: DataFrame) -> DataFrame:
    """Replaces tokens by their lemma from a (form, lemma) table with one row per form; the order of tokens stays, null becomes no token.

    A table whose written size and rows are below their bounds goes to the tasks
    and tokens are replaced inside the row. Beyond them tokens are joined to
    the table one by one and put together again by ``key``, which then has to be unique.
    """
    table, small = written_lookup(lemmas.select("form", "lemma").where(F.col("form").isNotNull() & F.col("lemma").isNotNull()))
    rows = table.limit(MAX_LEMMAS + 1).toArrow() if small else None
    if small and len(rows) <= MAX_LEMMAS:
        known = df.sparkSession.sparkContext.broadcast(tuple(rows[c].combine_chunks().cast(pa.string()) for c in ("form", "lemma")))

        @F.arrow_udf("array<string>")
        def replaced(toks: pa.Array) -> pa.Array:
            return _replaced(toks, *known.value)

        return df.withColumn(token_column, replaced(token_column))
    words = df.select(key, F.posexplode(token_column).alias("_pos", "form"))
    found = lookup_join(words, table, ["form"], F.struct(key, "_pos"))
    # one document's tokens
    done = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form").alias("w")))).alias("_w"))
    out = df.drop(token_column).join(done, key, "left")
    return out.withColumn(token_column, F.coalesce(F.transform("_w", lambda x: x["w"]), F.array().cast("array<string>"))).drop("_w")


def plural_lemmas(words: DataFrame, word: str) -> DataFrame:
    """(form, lemma) for words ending in s whose stem is itself a word of the table."""
    vocabulary = words.select(F.col(word).alias("form")).distinct()
    forms = vocabulary.where(F.col("form").endswith("s") & (F.length("form") > 3)).select(
        "form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))
    return forms.join(vocabulary.withColumnRenamed("form", "lemma"), "lemma", "left_semi").select("form", "lemma")


def _mentions(lower: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(lower, F.lit(w)).cast("int") for w in words])


def word_count(text: str | Column) -> Column:
    """Runs of anything but white space; split at single spaces, which takes less time than a pattern."""
    parts = F.split(F.translate(col(text), L.OTHER_SPACE, " " * len(L.OTHER_SPACE)), " ")
    return F.when(col(text).isNotNull(), F.size(F.filter(parts, lambda w: w != "")))


def basic_stats(df: DataFrame, text: str, toks: str | None = None) -> DataFrame:
    """Counts of a text; ``toks`` names its cleaned tokens if a column has them."""
    t = F.col(text)
    words = F.size("_tok")
    letters = F.aggregate("_tok", F.lit(0), lambda a, w: a + F.length(w))
    return df.withColumn("_tok", tokens(text) if toks is None else F.col(toks)).withColumns({
        "text_length": F.length(t), "word_count": word_count(t),
        "sentence_count": F.regexp_count(t, F.lit(L.SENTENCE)),
        "avg_word_length": F.when(words > 0, letters / words).otherwise(0.0),
        "punctuation_count": F.length(t) - F.length(F.translate(t, L.PUNCTUATION, "")),
        "capital_letters_count": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "digit_count": F.regexp_count(t, F.lit(r"\p{Nd}")),
    }).drop("_tok")


def keyword_mentions(df: DataFrame, text: str, keywords: dict[str, Sequence[str]] | None = None) -> DataFrame:
    lower = df.withColumn("_lower", F.lower(text))
    return lower.withColumns({f"{c}_mentions": _mentions(F.col("_lower"), w)
                              for c, w in (keywords or L.KEYWORDS).items()}).drop("_lower")


def entity_counts(df: DataFrame, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    return df.withColumns({n: F.regexp_count(F.col(text), F.lit(L.as_re2(p))) for n, p in (patterns or L.ENTITIES).items()})


def sentiment(df: DataFrame, text: str, words: str | None = None) -> DataFrame:
    """Shares of positive and negative words; ``words`` names the number of words of a text if a column has it."""
    number = word_count(text) if words is None else F.col(words)
    lower = df.withColumn("_lower", F.lower(text)).withColumns({
        "_p": _mentions(F.col("_lower"), L.POSITIVE), "_n": _mentions(F.col("_lower"), L.NEGATIVE)})
    hits = F.greatest(F.col("_p") + F.col("_n"), F.lit(1))
    return lower.withColumns({
        "sentiment_compound": (F.col("_p") - F.col("_n")) / hits, "sentiment_positive": F.col("_p") / hits,
        "sentiment_negative": F.col("_n") / hits,
        "sentiment_neutral": 1 - (F.col("_p") + F.col("_n")) / F.greatest(number, F.lit(1)),
    }).drop("_lower", "_p", "_n")


def features(df: DataFrame, text: str, toks: str | None = None) -> DataFrame:
    """All scalar text features; null text counts as empty."""
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    return entity_counts(sentiment(keyword_mentions(basic_stats(df, text, toks), text), text, "word_count"), text)


# ------------------------------------------------------------------ terms

def _ngrams(toks: Column, sizes: Sequence[int]) -> Column:
    parts = []
    for n in sizes:
        if n == 1:
            parts.append(toks)
        else:
            starts = F.sequence(F.lit(1), F.size(toks) - (n - 1))
            grams = F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))
            parts.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def term_counts(df: DataFrame, key: str, text: str, ngrams: Sequence[int] = (1, 2), min_chars: int = 0) -> DataFrame:
    """(key, term, tf) of the cleaned texts that have ``min_chars`` characters."""
    toks = df.select(key, tokens(text).alias("_tok"))
    if min_chars:
        toks = toks.where(F.length(F.array_join("_tok", " ")) >= min_chars)
    grams = toks.select(key, F.explode(_ngrams(F.col("_tok"), ngrams)).alias("term"))
    return grams.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(counts: DataFrame, key: str, size: int = VOCABULARY, min_df: int = MIN_DF, max_df: float = MAX_DF,
                   documents: DataFrame | None = None) -> DataFrame:
    """term, df, total, idf of at most ``size`` terms: the most used ones, ties by term.

    Shares and idf are of all rows of ``documents``, or else of the documents that have a term.
    """
    n = counts.agg(F.count_distinct(key)).scalar() if documents is None else documents.agg(F.count(F.lit(1))).scalar()
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = terms.where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df).cast("double")))
    idf = F.log((n + 1) / (F.col("df") + 1).cast("double")) + 1
    return kept.orderBy(F.desc("total"), "term").limit(size).withColumn("idf", idf)


#: Distinct terms a task holds before it passes their counts on.
HELD_TERMS = 1 << 18
#: Words that go to the tasks to number the n-grams made of them.
MAX_NUMBERED = 1 << 18


def _grams(toks, sizes: Sequence[int]) -> list[str]:
    return [g for n in sizes for g in (toks if n == 1 else map(" ".join, zip(*(toks[i:] for i in range(n)))))]


def _words(df: DataFrame, text: str) -> Column:
    """The tokens of a text column; a column of arrays holds tokens already."""
    return F.col(text) if isinstance(df.schema[text].dataType, T.ArrayType) else tokens(text)


def _flat(column) -> tuple[pa.Array, np.ndarray]:
    """The words of an Arrow array of lists one after another, and the row of each; null is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().cast(pa.string()), np.repeat(np.arange(len(column), dtype=np.int64), lengths)


def _token_lists(column) -> list:
    """An Arrow array of lists as Python lists, null as empty."""
    words, rows = _flat(column)
    flat, ends = words.to_pylist(), np.searchsorted(rows, np.arange(len(column) + 1))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(ids: np.ndarray, rows: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code, the word numbers as digits to a base, of all n-grams of known words."""
    m = max(len(ids) - n + 1, 0)
    code, whole = np.zeros(m, dtype=np.int64), rows[:m] == rows[len(rows) - m:]
    for i in range(n):
        code = code * base + ids[i:i + m]
        whole = whole & (ids[i:i + m] >= 0)
    return rows[:m][whole], code[whole]


def _counted(terms: pa.Array, rows: np.ndarray) -> pa.Table:
    """term, df, total of the distinct terms of a batch."""
    coded = terms.dictionary_encode()
    at, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    once_a_row = pc.unique(pa.array(rows * n + at)).to_numpy() % max(n, 1)
    return pa.table({"term": coded.dictionary, "df": np.bincount(once_a_row, minlength=n).astype(np.int64), "total": np.bincount(at, minlength=n).astype(np.int64)})


def _added_up(tables):
    """Counts of many batches, summed as long as a task may hold their terms."""
    held, size = [], 0
    for table in tables:
        held, size = [*held, table], size + len(table)
        if size >= 4 * HELD_TERMS:
            table = _sums(held)
            held, size = [table], len(table)
            if size >= HELD_TERMS:
                yield from table.to_batches()
                held, size = [], 0
    if held:
        yield from _sums(held).to_batches()


def _sums(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
    return added.select(["term", "df_sum", "total_sum"]).rename_columns(["term", "df", "total"])


def _all_terms(toks: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """term, df, total of every n-gram; the null term has the number of rows."""
    def count(batches):
        def tables():
            for batch in batches:
                yield pa.table({"term": pa.nulls(1, pa.string()), "df": [batch.num_rows], "total": [0]})
                if list(sizes) == [1]:
                    yield _counted(*_flat(batch.column(0)))
                    continue
                lists = [_grams(words, sizes) for words in _token_lists(batch.column(0))]
                rows = np.repeat(np.arange(len(lists), dtype=np.int64), [len(g) for g in lists])
                yield _counted(pa.array([g for grams in lists for g in grams], pa.string()), rows)
        yield from _added_up(tables())

    counted = toks.mapInArrow(count, "term string, df long, total long")
    return stored(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "terms")


def _grams_of(toks: DataFrame, words: list[str], n: int) -> DataFrame:
    """term, df, total of the n-grams made of these words; no other one leaves its task, and they travel as numbers."""
    spark, base = toks.sparkSession, len(words)
    known = spark.sparkContext.broadcast(words)  # at most MAX_NUMBERED

    def count(batches):
        listed = pa.array(known.value, pa.string())

        def tables():
            for batch in batches:
                flat, rows = _flat(batch.column(0))
                rows, codes = _coded(_numbered(flat, listed), rows, n, base)
                yield _counted(pa.array(codes), rows)
        yield from _added_up(tables())

    counted = toks.mapInArrow(count, "term long, df long, total long")
    sums = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    names = F.broadcast(spark.createDataFrame(pa.table({"_at": pa.array(range(base), pa.int64()), "_word": pa.array(words, pa.string())})))
    for i in range(n):
        sums = sums.withColumn("_at", F.expr(f"(term div {base ** (n - 1 - i)}L) % {base}L")).join(names.withColumnRenamed("_word", f"_w{i}"), "_at").drop("_at")
    return sums.select(F.concat_ws(" ", *[f"_w{i}" for i in range(n)]).alias("term"), "df", "total")


def learn_vocabulary(df: DataFrame, text: str, size: int = VOCABULARY, min_df: int = MIN_DF, max_df: float = MAX_DF,
                     ngrams: Sequence[int] = (1, 2)) -> DataFrame:
    """The vocabulary of ``fit_vocabulary``: terms are counted in the task, only sums are shuffled.

    Words are counted first. If ``size`` of them are used ``least`` times or
    more, then so is every longer term of the vocabulary, and each of its words
    at least as often; only terms of such words are counted. Without single
    words, or if too many are that frequent, all terms are counted.
    ``text`` names a text column or one of token arrays.
    """
    sizes, toks = list(ngrams), df.select(_words(df, text).alias("tok"))
    if sizes != [1] and not isinstance(df.schema[text].dataType, T.ArrayType):
        toks = stored(toks, "tokens")
    terms = _all_terms(toks, [1] if 1 in sizes else sizes)
    n = terms.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()

    def allowed(counts):
        return counts.where(F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df).cast("double")))

    if 1 in sizes and len(sizes) > 1:
        last = allowed(terms).orderBy(F.desc("total")).limit(size).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
        least = last["total"] if last["n"] == size else 0
        frequent = terms.where(F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("total") >= least)).select("term").limit(MAX_NUMBERED + 1)
        words = sorted(r["term"] for r in frequent.collect())
        apart = terms.where(F.contains("term", F.lit(" "))).isEmpty()  # else a word may look like a longer term
        if apart and len(words) <= MAX_NUMBERED and len(words) ** max(sizes) < 2 ** 63:
            for length in sizes:
                if length > 1 and words:
                    terms = terms.unionByName(_grams_of(toks, words, length).where(F.col("total") >= least))
        else:
            terms = _all_terms(toks, sizes)
    idf = F.log((n + 1) / (F.col("df") + 1).cast("double")) + 1
    return allowed(terms).orderBy(F.desc("total"), "term").limit(size).withColumn("idf", idf)


def term_vectors(df: DataFrame, text: str, vocabulary: DataFrame, name: str = "terms", ngrams: Sequence[int] = (1, 2)) -> DataFrame:
    """``df`` with the sparse vector of each text: an array of (term, tf, weight), weights scaled to length one.

    The vocabulary, at most its fitted size, goes to the tasks; rows stay where they are.
    """
    sizes = list(ngrams)
    idf = df.sparkSession.sparkContext.broadcast({r["term"]: r["idf"] for r in vocabulary.collect()})  # at most the size asked for

    def numbers(toks: pa.Array, known: dict, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row and term number of all terms of the vocabulary, repeats included."""
        flat, rows = _flat(toks)
        words = sorted({w for t in terms for w in t.split(" ")})
        if len(words) ** max(sizes) >= 2 ** 63 or pc.any(pc.match_substring(flat, " ")).as_py():
            place = {t: i for i, t in enumerate(terms)}
            found = [[place[g] for g in _grams(words, sizes) if g in known] for words in _token_lists(toks)]
            return np.repeat(np.arange(len(found), dtype=np.int64), [len(f) for f in found]), np.array([i for f in found for i in f], dtype=np.int64)
        place, base = {w: i for i, w in enumerate(words)}, len(words)
        ids, parts = _numbered(flat, pa.array(words, pa.string())), []
        for n in sizes:
            mine = sorted((reduce(lambda code, w: code * base + place[w], split, 0), i) for i, split in enumerate(t.split(" ") for t in terms) if len(split) == n)
            if mine:
                codes, at = (np.array(c, dtype=np.int64) for c in zip(*mine))
                where, code = _coded(ids, rows, n, base)
                near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[near] == code
                parts.append((where[hit], at[near[hit]]))
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *p]) for p in (zip(*parts) if parts else ((), ())))

    @F.arrow_udf("array<struct<term:string,tf:long,weight:double>>")
    def vectors(toks: pa.Array) -> pa.Array:
        known = idf.value
        terms = list(known)
        rows, at = numbers(toks, known, terms)
        both, counts = np.unique(rows * max(len(terms), 1) + at, return_counts=True)
        rows, at = np.divmod(both, max(len(terms), 1))
        w = counts * np.array([known[t] for t in terms], dtype=float)[at]
        norm = np.sqrt(np.bincount(rows, w * w, minlength=len(toks)))
        flat = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(at)), pa.array(counts.astype(np.int64)), pa.array(w / np.where(norm > 0, norm, 1.0)[rows])],
                                          names=["term", "tf", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(toks) + 1)).astype(np.int32)), flat)

    return df.withColumn(name, vectors(_words(df, text)))


def count_vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of vocabulary terms; the vocabulary has at most its fitted size."""
    return counts.join(F.broadcast(vocabulary), "term")


def tfidf(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight), each document scaled to length one."""
    weighted = count_vectors(counts, vocabulary).withColumn("_w", F.col("tf") * F.col("idf"))
    # a document has at most as many terms as the vocabulary
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))


def idf_importance(vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    out = vocabulary.select(F.concat(F.lit("tfidf_"), "term").alias("feature"), F.col("idf").alias("importance")).orderBy(F.desc("importance"), "feature")
    return out if limit is None else out.limit(limit)


def word_frequencies(df: DataFrame, text: str, top: int | None = None) -> DataFrame:
    """How often each lower-cased word occurs, or the ``top`` most frequent ones, ties by word."""
    words = df.select(F.explode(F.split(F.lower(text), f"[{L.SPACE}]+")).alias("word")).where(F.col("word") != "")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "word").limit(top)


def language_filter(df: DataFrame, language: str, keep: Sequence[str] = ("en",)) -> DataFrame:
    return df.where(F.col(language).isin(list(keep)))


# ------------------------------------------------------------------ fitted vector models

def fit_topics(df: DataFrame, token_column: str, topics: int = 10, terms: int = 1000, max_iter: int = 20, seed: int = 42) -> PipelineModel:
    """Counts of the ``terms`` most used words are written once; every pass of the fit reads only them."""
    vocabulary = learn_vocabulary(df, token_column, terms, ngrams=(1,))
    words = [r["term"] for r in vocabulary.orderBy(F.desc("total"), "term").collect()]  # at most ``terms``
    counts = CountVectorizerModel.from_vocabulary(words, inputCol=token_column, outputCol="_counts")
    counted = stored(counts.transform(df.select(F.coalesce(token_column, F.array().cast("array<string>")).alias(token_column))).select("_counts"), "counts")
    lda = LDA(k=topics, seed=seed, maxIter=max_iter, featuresCol="_counts", topicDistributionCol="topics")
    return PipelineModel([counts, lda.fit(counted)])


def spread(df: DataFrame, vector: str, size: int, prefix: str) -> DataFrame:
    """Vector column to scalar columns prefix_0.."""
    arr = vector_to_array(vector)
    return df.withColumn("_arr", arr).withColumns({f"{prefix}_{i}": F.col("_arr")[i] for i in range(size)}).drop("_arr", vector)


def cluster(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """k-means on an array column; adds ``cluster``."""
    vec = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vec)
    return model.transform(vec).drop("_v")


class TextPreprocessor:
    """Scalar features, tf-idf, word vectors and topics, keyed by document."""

    def __init__(self, key: str, text: str, w2v_size: int = 100, topics: int = 10, vocabulary: int = VOCABULARY, lda_iter: int = 20):
        self.config = {"key": key, "text": text, "w2v_size": w2v_size, "topics": topics, "vocabulary": vocabulary, "lda_iter": lda_iter}

    def fit(self, df: DataFrame) -> "FittedTextPreprocessor":
        c = self.config
        # the vocabulary and both models pass over the tokens many times
        toks = stored(df.select(F.coalesce(tokens(c["text"]), F.array().cast("array<string>")).alias("tok")), "tokens")
        vocabulary = stored(learn_vocabulary(toks, "tok", c["vocabulary"]), "vocabulary")
        return FittedTextPreprocessor(c, vocabulary, fit_word2vec(toks, "tok", c["w2v_size"]),
                                      fit_topics(toks, "tok", c["topics"], max_iter=c["lda_iter"]))


class FittedTextPreprocessor:
    def __init__(self, config: dict, vocabulary: DataFrame, word2vec: WordVectors, topics: PipelineModel):
        self.config, self.vocabulary, self.word2vec, self.topics = config, vocabulary, word2vec, topics

    def transform(self, df: DataFrame) -> DataFrame:
        """Scalar features, w2v_dim_i, topic_i and the sparse tf-idf weights as a map."""
        c = self.config
        weights = F.map_from_entries(F.transform("_terms", lambda t: F.struct(t["term"], t["weight"])))
        base = df.withColumn("tok", F.coalesce(tokens(c["text"]), F.array().cast("array<string>")))
        # word vectors move rows, so they come before there are features to move
        base = self.word2vec.transform(base, "tok", "_w2v")
        base = term_vectors(base, "tok", self.vocabulary, "_terms").withColumn("tfidf", F.when(F.size("_terms") > 0, weights)).drop("_terms")
        base = features(base, c["text"], "tok")
        base = spread(base, "_w2v", c["w2v_size"], "w2v_dim")
        return spread(self.topics.transform(base), "topics", c["topics"], "topic").drop("tok", "_counts", c["text"])

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.word2vec.save(f"{path}/word2vec")
        self.topics.write().overwrite().save(f"{path}/topics")
        spark.createDataFrame([(json.dumps(self.config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedTextPreprocessor":
        config = json.loads(spark.read.text(f"{path}/config").first()[0])
        return cls(config, spark.read.parquet(f"{path}/vocabulary"), WordVectors.load(spark, f"{path}/word2vec", config["w2v_size"]),
                   PipelineModel.load(f"{path}/topics"))

"""Queries over text processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriloom.functions import lexicon as L
from veriloom.operators import text as X
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.session import materialize, scratch_path, spread_rows, stored


def _docs(spark, sf):
    return spread_rows(P.documents(spark, sf).select("doc_id", "text"), "doc_id")


def _r(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXPANDED = "{t}"
for _a, _b in L.CONTRACTIONS:
    EXPANDED = f"replace({EXPANDED}, {_q(_a)}, {_q(_b)})"
WORDS = "(" + ", ".join(_q(w) for w in L.STOPWORDS) + ")"
_TRIMMED = f"regexp_replace(text, '^[{L.SPACE}]+|[{L.SPACE}]+$', '', 'g')"
_FLAT = f"regexp_replace(lower({EXPANDED.format(t=_TRIMMED)}), '[{L.SPACE}]+', ' ', 'g')"
# doc_id, tok: cleaned tokens per document
TOKENS = f"""(select doc_id, text, list_filter(string_split(regexp_replace(flat,
    '[!-/:-@\\[-`{{-~]', '', 'g'), ' '), lambda w: length(w) between 2 and 20 and w not in {WORDS}) as tok
    from (select doc_id, text, {_FLAT} as flat from documents) t0)"""


@query("txt_expand_contractions", f"select doc_id, {EXPANDED.format(t='text')} as text from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", X.expand_contractions("text").alias("text"))


@query("txt_clean", f"select doc_id, array_to_string(tok, ' ') as cleaned from {TOKENS} t")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean("text").alias("cleaned"))


@query("txt_lemma", f"""
    with t as {TOKENS}, w as (select doc_id, unnest(tok) as form, generate_subscripts(tok, 1) as pos from t),
    v as (select distinct form from w), d as (select form, form[:-2] as lemma from v where form like '%s' and length(form) > 3 and form[:-2] in (select form from v)),
    j as (select doc_id, string_agg(coalesce(lemma, w.form), ' ' order by pos) as lemmas from w left join d on w.form = d.form group by doc_id)
    select doc_id, coalesce(lemmas, '') as lemmas from t left join j using (doc_id)""")
def _(spark, sf):
    docs = stored(_docs(spark, sf).select("doc_id", X.tokens("text").alias("tok")), "tokens")
    words = stored(docs.select(F.explode("tok").alias("word")).distinct(), "words")
    lemmas = X.plural_lemmas(words, "word")
    return X.lemmatize(docs, "doc_id", "tok", lemmas).select("doc_id", F.array_join("tok", " ").alias("lemmas"))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {_q(pattern)}))::int"


@query("txt_stats", f"""
    select doc_id, length(text)::int as text_length, {_count(f'[^{L.SPACE}]+')} as word_count, {_count(L.SENTENCE)} as sentence_count,
      round(case when len(tok) > 0 then list_sum(list_transform(tok, lambda w: length(w)))::double / len(tok) else 0 end, 6) as avg_word_length,
      {_count(r'[!-/:-@\[-`{-~]')} as punctuation_count, {_count(r'\p{Lu}')} as capital_letters_count, {_count(r'\p{Nd}')} as digit_count from {TOKENS} t""")
def _(spark, sf):
    return _r(X.basic_stats(_docs(spark, sf), "text").drop("text"), avg_word_length=6)


@query("txt_keyword_mentions", "select doc_id, " + ", ".join(
    "(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + f")::int as {c}_mentions" for c, words in L.KEYWORDS.items()) + " from documents")
def _(spark, sf):
    return X.keyword_mentions(_docs(spark, sf), "text").drop("text")


@query("txt_entity_counts", "select doc_id, " + ", ".join(f"{_count('(?i)' + p)} as {n}" for n, p in L.ENTITIES.items()) + " from documents")
def _(spark, sf):
    return X.entity_counts(_docs(spark, sf), "text").drop("text")


def _hits(words):
    return "(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + ")"


@query("txt_sentiment", f"""
    with s as (select doc_id, {_hits(L.POSITIVE)} as p, {_hits(L.NEGATIVE)} as n, {_count(f'[^{L.SPACE}]+')} as w from documents)
    select doc_id, round((p - n) / greatest(p + n, 1), 6) as sentiment_compound, round(p / greatest(p + n, 1), 6) as sentiment_positive,
      round(n / greatest(p + n, 1), 6) as sentiment_negative, round(1 - (p + n) / greatest(w, 1), 6) as sentiment_neutral from s""")
def _(spark, sf):
    out = X.sentiment(_docs(spark, sf), "text").drop("text")
    return _r(out, **{c: 6 for c in out.columns if c != "doc_id"})


TERMS = f"""t as (select doc_id, tok from {TOKENS} t1),
    g as (select doc_id, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) as term from t),
    c as (select doc_id, term, count(*) as tf from g group by 1, 2),
    n as (select count(*) as n from documents),
    v as (select term, count(*) as df, sum(tf)::bigint as total from c group by 1 having count(*) >= 2 and count(*) <= 0.95 * (select n from n)
          order by total desc, term limit 5000),
    i as (select v.*, ln((n + 1.0::double) / (df + 1)) + 1 as idf from v, n)"""


def _vectors(spark, sf):
    """Documents with their terms, and no row moved: (doc_id, term, tf, weight)."""
    docs = stored(_docs(spark, sf).select("doc_id", X.tokens("text").alias("tok")), "tokens")
    return X.term_vectors(docs, "tok", X.learn_vocabulary(docs, "tok")).select("doc_id", F.inline("terms"))


@query("txt_tfidf", f"""
    with {TERMS}, w as (select doc_id, term, tf * idf as w from c join i using (term)),
    s as (select *, sqrt(sum(w * w) over (partition by doc_id)) as norm from w)
    select doc_id, term, round(w / norm, 6) as weight from s""")
def _(spark, sf):
    return _r(_vectors(spark, sf).drop("tf"), weight=6)


@query("txt_count_vector", f"with {TERMS} select doc_id, term, tf from c join i using (term)")
def _(spark, sf):
    return _vectors(spark, sf).drop("weight")


@query("txt_idf_importance", f"with {TERMS} select 'tfidf_' || term as feature, round(idf, 6) as importance from i")
def _(spark, sf):
    return _r(X.idf_importance(X.learn_vocabulary(_docs(spark, sf), "text")), importance=6)


def _all(columns, test):
    """Whether a test holds of all the columns."""
    return reduce(lambda a, b: a & b, [test(F.col(c)) for c in columns])


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


@query("txt_word2vec", "select doc_id, true as vector_ok from documents")
def _(spark, sf):
    docs = stored(_docs(spark, sf).select("doc_id", X.tokens("text").alias("tok")), "tokens")
    model = X.fit_word2vec(docs, "tok", size=100)
    out = X.spread(model.transform(docs, "tok").drop("tok"), "w2v", 100, "w2v_dim")
    return out.select("doc_id", _all([c for c in out.columns if c != "doc_id"], _finite).alias("vector_ok"))


def _shares(columns):
    """Topic shares: none below zero, one in sum, or all zero for a text without a known term."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return _all(columns, lambda c: c >= 0) & ((F.abs(total - 1) < 1e-6) | (total == 0))


@query("txt_lda", "select doc_id, true as topics_ok from documents")
def _(spark, sf):
    docs = stored(_docs(spark, sf).select("doc_id", X.tokens("text").alias("tok")), "tokens")
    model = X.fit_topics(docs, "tok")
    out = X.spread(model.transform(docs).drop("tok", "_counts"), "topics", 10, "topic")
    return out.select("doc_id", _shares([f"topic_{i}" for i in range(10)]).alias("topics_ok"))


@query("txt_kmeans", "select vec_id, label, true as nearest_ok, 10::bigint as clusters from embeddings")
def _(spark, sf):
    """No other cluster's mean is nearer to a vector than that of its own (but for the last step of the fit, so within a part of its distance)."""
    out = materialize(X.cluster(P.table(spark, sf, "embeddings"), "embedding", 10))
    at = F.posexplode("embedding").alias("place", "x")
    parts = out.select("cluster", at).groupBy("cluster", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("m")).select("cluster", F.col("m.x").alias("m"))  # a number per dimension
    table = means.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m")))).scalar()  # ten means

    def apart(mean):
        return F.aggregate(F.zip_with("embedding", mean, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0).cast("double"), lambda s, d: s + d)

    apart_of = F.transform_values("means", lambda _, mean: apart(mean))
    checked = out.withColumn("means", table).withColumn("d", apart_of)
    nearest = F.col("d")[F.col("cluster")] <= F.array_min(F.map_values("d")) * 1.15
    return checked.select("vec_id", "label", nearest.alias("nearest_ok"), F.size("means").cast("long").alias("clusters"))


@query("txt_word_freq", f"""
    select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[{L.SPACE}]+')) as word from documents) w
    where word <> '' group by 1 order by n desc, word limit 100""")
def _(spark, sf):
    return X.word_frequencies(_docs(spark, sf), "text", 100)


@query("txt_language_filter", "select doc_id, lang, n_chars from documents where lang in ('en')")
def _(spark, sf):
    return X.language_filter(P.documents(spark, sf), "lang").select("doc_id", "lang", "n_chars")


@query("txt_preprocessor", f"""with {TERMS}, w as (select doc_id, term, tf * idf as w from c join i using (term)),
    s as (select doc_id, count(*) as terms, sum(w) / sqrt(sum(w * w)) as weight from w group by 1)
    select d.doc_id, length(text)::int as text_length, {_count(f'[^{L.SPACE}]+')} as word_count, coalesce(terms, 0)::int as terms,
      round(coalesce(weight, 0), 6) as weight_sum, true as vector_ok, true as topics_ok from documents d left join s on s.doc_id = d.doc_id""")
def _(spark, sf):
    docs = _docs(spark, sf)
    fitted = X.TextPreprocessor("doc_id", "text").fit(docs)
    path = scratch_path(spark, "text_preprocessor")
    fitted.save(spark, path)
    out = stored(X.FittedTextPreprocessor.load(spark, path).transform(docs), "features")  # all of them, not those checked below only
    total = F.aggregate(F.map_values("tfidf"), F.lit(0.0).cast("double"), lambda a, w: a + w)
    return out.select("doc_id", "text_length", "word_count", F.coalesce(F.size("tfidf"), F.lit(0)).alias("terms"),
                      F.round(F.coalesce(total, F.lit(0.0)), 6).alias("weight_sum"), _all([f"w2v_dim_{i}" for i in range(100)], _finite).alias("vector_ok"),
                      _shares([f"topic_{i}" for i in range(10)]).alias("topics_ok"))

"""The registered queries of the operators in this subpackage, with SQL where SQL can state them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import bestfit, chat, decontaminate, html, language, near_dedup, negatives, neighbours, packing, pii, quality, substrings, variants
from veriloom.llm.common import map_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op5_cost_balanced_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), F.crc32("ids").alias("ids_crc32"))


@query("op9_substring_dedup", r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    w as (select doc_id, unnest(range(1, len(words) - 18)) as start, words from d where len(words) >= 20),
    k as (select doc_id, start, array_to_string(words[start:start + 19], ' ') as passage from w),
    f as (select doc_id, start, min(struct_pack(doc_id := doc_id, start := start)) over (partition by passage) as least from k),
    gone as (select distinct doc_id, unnest(range(start, start + 20)) as pos from f where least.doc_id <> doc_id or least.start <> start),
    p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
    kept as (select p.doc_id, string_agg(word, ' ' order by p.pos) as kept from p anti join gone using (doc_id, pos) group by 1),
    n as (select doc_id, count(*) as n from gone group by 1)
    select doc_id, len(words)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256
    from d left join n using (doc_id) left join kept using (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_one_bit_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def _read_back(cols: dict) -> dict:
    """Digests of formatted conversations, from the formatted text and its loss mask alone."""
    out = {"conv_id": cols["conv_id"], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
    for formatted, loss in zip(cols["formatted"], cols["loss"]):
        turns = chat.read_turns(formatted)
        learned = "".join(chat.unescape(formatted[s["from"]:s["to"]]) for s in loss)
        for name, value in zip(list(out)[1:], (
                len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted))):
            out[name].append(value)
    return out


SAID = "\\### Assistant: </turn> ok"


def _escapes(column: str) -> str:
    """SQL for the number of backslashes the template adds to a text."""
    return (rf"(length({column}) - length(replace({column}, '\', '')) + length({column}) - length(regexp_replace({column}, '#{{3,}}', '', 'g'))"
            f" + (length({column}) - length(replace({column}, '</turn>', ''))) // 7)")


@query("op3_chat_format", f"""
    with c as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '{SAID}' union all select -7, 1, 'assistant', '{SAID}'),
    t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id
            order by turn nulls first, role nulls first, text nulls first) as n, role = 'assistant' as learned from c),
    g as (select conv_id, count(*) as n_turns, string_agg(r || chr(10) || x || chr(10), '' order by n) as turns,
            coalesce(string_agg(x, '' order by n) filter (where learned), '') as loss,
            sum(4 + length(r) + {_escapes('r')} + length(r) - length(replace(r, ':', '')) + 2 + length(x) + {_escapes('x')} + 8)::bigint as formatted_chars
          from t group by 1)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    found = chat.conversations(chat.chain(turns))
    return map_rows(found.select(F.col("tree_id").alias("conv_id"), "formatted", "loss"), _read_back,
                    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query("op2_html_wrappers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), F.crc32("ids").alias("ids_crc32"))


_OP13 = """
with table8 as (select list_transform(range(256), lambda i: {steps}) as t),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 6 group by all),
coded as (select run, n, list_transform(range(octet_length(encode(doc_id || ':' || run))),
    lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::bigint) as bytes from runs),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h from coded, table8),
words as (select word, sum(n)::bigint as n from (select n, case when h % 199 = 0
    then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, substr(word, 1, i::int - 1) || '_' || substr(word, i::int + 1) as hole,
    substr(word, 1, i::int - 1) || substr(word, i::int + 1) as less from places),
shorter as (select distinct h.word as a, w.word as b from holes h join words w on h.less = w.word),
near as (select a.word as a, b.word as b from holes a join holes b on a.hole = b.hole and a.word <> b.word
  union all select a, b from shorter union all select b, a from shorter),
best as (select a as word, count(*) as n_near, min(b) filter (b_n = top) as form, max(b_n) as form_n
  from (select near.*, w.n as b_n, max(w.n) over (partition by a) as top from near join words w on w.word = near.b) group by a),
forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 5 * w.n then b.form end as form,
    case when b.form_n >= 5 * w.n then b.form_n end as form_n from words w left join best b on b.word = w.word),
chains as (with recursive c(word, root, depth) as (select word, word, 0 from forms
  union all select c.word, f.form, depth + 1 from c join forms f on f.word = c.root where f.form is not null) select * from c)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f
join (select word, arg_max(root, depth) as root from chains group by word) r on r.word = f.word
"""


def _crc_steps() -> str:
    """SQL for entry i of the table that takes crc32 one byte further: eight shifts."""
    step = "i::bigint"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: xor(x >> 1, 3988292384::bigint * (x & 1)))[1]"
    return step


@query("op13_permuterm_variants", _OP13.replace("{steps}", _crc_steps()))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.vocabulary(table(spark, sf_dir, "documents")))


@query("op12_hyperplane_negatives", """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
liked as (select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select l.anchor_id, positive_id, row_number() over (partition by l.anchor_id, positive_id order by s.score desc, s.id)::int as rank,
  s.id as negative_id, positive_score, s.score as negative_score
from liked l join scored s on s.anchor_id = l.anchor_id and not s.same
  and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify rank <= 3""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))

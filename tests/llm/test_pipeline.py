"""The stages of the corpus pipeline against what they must keep, and the guard around the subpackage."""

import os
import subprocess
import sys

import numpy as np

import corpus_pipeline as P
from veriloom.llm import decontaminate, pii, quality, tokens
from veriloom.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {d for d, r in rows.items() if model.score(np.array([quality.statistics(r["text"])]))[0] >= quality.THRESHOLD}
    state = {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        state[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    kept = {n: {r["doc_id"]: r["text"] for r in state[n].collect()} for n, _ in P.STAGES[:-1]}
    assert set(kept["quality"]) == want
    # one document of each group: no two kept ones are similar, each dropped one has a kept one that is
    grams = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.lower().split()) for d, t in kept["quality"].items())}

    def similarity(a, b):
        return len(grams[a] & grams[b]) / len(grams[a] | grams[b])

    # of each component of documents with chained similarities of 0.8 the one with the smallest id stays
    root = {d: d for d in grams}
    for i, a in enumerate(sorted(grams)):
        for b in sorted(grams)[:i]:
            if root[a] != root[b] and similarity(a, b) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert set(kept["near_dedup"]) == set(root.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.normal_words(text)
        return any(decontaminate.weighted_similarity(decontaminate.shingles(words[i:i + len(t)], 5), decontaminate.shingles(t, 5)) >= 0.8
                   for t in map(decontaminate.normal_words, items) for i in range(len(words) - len(t) + 1))

    short = {d: t for d, t in kept["near_dedup"].items() if len(t) < 3000}
    assert {d for d, t in short.items() if not leaks(t)} == set(short) & set(kept["decontamination"])
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert all(not pii.base_spans(t) for t in kept["pii"].values())
    plain = [d for d, t in kept["decontamination"].items() if not pii.candidates(t)[1]]
    assert plain and all(kept["pii"][d] == kept["decontamination"][d] for d in plain)
    encoder = tokens.load_encoder()
    n_tokens = {d: len(encoder.encode(t)) + 1 for d, t in kept["pii"].items()}
    got: dict = {}
    for r in state["packing"].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == n_tokens
    assert P.run(spark, SF).count() == state["packing"].count()


def test_entry_has_the_eleven_queries_and_does_without_them():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op")]
    assert len(names) == 14
    code = ("import sys; sys.modules['veriloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)

import random
import re

from veriloom.llm import pii as P

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
            if (True, kind == 1 and max(map(int, m.group().split("."))) <= 255, 14 <= len(digits) <= 19 and total % 10 == 0,
                    10 <= len(digits) <= 15)[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    random.seed(4)
    parts = ["a", "@", "b.", "1", "12", "3.4", ".5", "+", "-", " ", "@x.y", "255.", "1.2.3.4", "(", ") ", "4111 1111 1111 1111", "9", "é", "%"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert P.base_spans(text) == slow_base(text), text


def test_long_texts_take_linear_time():
    text = "1" * 100_000 + "a" * 100_000 + "@" + "+1 " * 30_000 + "1.2" * 30_000
    P.candidates(text)


DOCS = [(1, "mail me at ann.lee@example.com or call +1 (555) 010-9999 now", 1), (2, None, 2), (3, "", 3), (4, "nothing to see here", 4),
        (4, "nothing to see here", 4), (None, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" from 10.1.2.3', 5)] + \
       [(10 + i, f'the secret key = "{i:02x}be64439e3e49cf46b2d7c90f3602a3d0b907{i:02x}" of {i}', 6) for i in range(20)]


def test_every_row_has_its_base_spans_and_more(spark):
    rows = P.personal_data(spark.createDataFrame(DOCS, "doc_id long, text string, spans int")).collect()
    assert len(rows) == len(DOCS)
    got = {r["doc_id"]: r["spans"] for r in rows}
    assert got[1] == "email:11:30,phone:39:56" and got[2] == got[3] == got[4] == ""
    assert got[None].endswith("ip:56:64") and "secret:9:49" in got[None]
    assert all("secret" in got[10 + i] for i in range(20))
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masking_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(d, t, 0 if t is None else len(t)) for d, t, _ in DOCS], "doc_id long, text string, n_chars long")
    out = P.mask_documents(df)
    assert out.columns == df.columns and out.count() == len(DOCS)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "mail me at <EMAIL> or call <PHONE> now" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[4]["text"] == "nothing to see here"


def test_reliable_labelers_are_told_from_noise():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) * 2 for q in (0.95, 0.9, 0.85, 0.9, 0.5)], 1)
    code = (votes * 3 ** np.arange(5)).sum(1)
    counts = pd.Series(code).value_counts().rename_axis("votes").reset_index(name="n").assign(kind=0, shape=0)
    model = P.fit_model(counts)
    found = np.array([model.posterior(0, int(c)) for c in code]) > 0.5
    assert (found == truth).mean() > 0.97
    trust = [model.reliability[0][1][i][2] for i in range(5)]
    assert trust[0] > 0.9 and trust[4] < 0.6

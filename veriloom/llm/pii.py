"""Personal data: labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, map_rows, stored

#: The base kinds in the order in which spans of one start are listed, then the kind that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "validity", "gazetteer", "context", "boundary")
#: An added span needs this probability.
CONFIDENCE = 0.9

# The lists the gazetteer and context labelers look up.
DOMAIN_ENDS = frozenset("com org net edu gov io co info biz de fr es uk it nl eu ch at be us ca au".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91 351 353 358 420".split())
SECRET_NAMES = frozenset("token key apikey api_key secret password passwd pwd access_key auth bearer credential".split())
CUES = {
    "email": frozenset("mail email e-mail contact write schreib correo courriel contacto".split()),
    "ip": frozenset("ip host server address client login from addr".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta account iban".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon telefono téléphone whatsapp".split()),
    "secret": SECRET_NAMES,
}
AGAINST = frozenset("version isbn issn order invoice page figure section chapter doi sha commit checksum md5 sha256 uuid build".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[\w-]{1,63}+)+"),
    "phone": re.compile(r"(?<![\w+.-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+(?![A-Za-z0-9])"),
}
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the email pattern. The name before an @ is followed back to where it begins, so time stays linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _votes(text: str, start: int, end: int, kind: int, base: bool) -> list[int]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    name, span = KINDS[kind], text[start:end]
    digits = [c for c in span if c in "0123456789"]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40):start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end:end + 20])][:1]
    if name == "email":
        valid = 1 if re.search(r"\.[A-Za-z]{2,}$", span) else -1
        known = 1 if re.split(r"[.\])\s]", span)[-1].lower() in DOMAIN_ENDS else -1
    elif name == "ip":
        parts = [int(p) for p in span.split(".")]
        valid, known = (1 if max(parts) <= 255 else -1), (-1 if parts[0] in (0, 127, 255) else 0)
    elif name == "card":
        valid = 1 if luhn("".join(digits)) else -1
        known = 1 if digits[0] in "3456" else -1
    elif name == "phone":
        valid = 1 if 10 <= len(digits) <= 15 else -1
        known = (1 if any("".join(digits[:n]) in DIAL_CODES for n in (1, 2, 3)) else -1) if span[0] == "+" or span[:2] == "00" else 0
    else:
        letters = sum(c.isalpha() for c in span)
        valid = 1 if digits and letters and len(set(span)) >= 10 else -1
        known = 1 if any(n in SECRET_NAMES for n in before[-2:]) else 0
    said = -1 if any(w in AGAINST for w in before[-2:]) else 1 if any(w in CUES[name] for w in (*before, *after)) else 0
    edges = [text[start - 1:start], text[end:end + 1]]
    free = -1 if any(c.isalnum() or c == "_" for c in edges) else 1
    return [1 if base else 0 if name != "secret" else 1 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", span) else 0, valid, known, said, free]


def _shape(text: str, start: int, end: int, kind: int) -> int:
    """A number below 1024 for the look of a span: length, share of digits, separators and what stands beside it."""
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    marks = sum(not c.isalnum() for c in span)
    cue = any(w.lower() in CUES[KINDS[kind]] for w in _WORD.findall(text[max(0, start - 40):start])[-4:])
    alone = (text[start - 1:start] or " ").isspace()
    return min(7, len(span) // 6) + 8 * min(3, 4 * digits // max(1, len(span))) + 32 * min(7, marks) + 256 * cue + 512 * alone


def candidates(text: str) -> tuple[list, list]:
    """Base spans, and all spans to vote on as (start, end, kind, votes code, shape, whether base).

    Beside the base spans these are wider matches that overlap none of them: written-out
    addresses, numbers without a plus, digits whose check sum fails, long random strings.
    """
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    if _DIGIT.search(text) or "@" in text or "(at)" in text or "[at]" in text:
        taken = sorted((a, b) for a, b, _ in base)
        for kind, name in enumerate(KINDS):
            if name in _WIDE and not (name == "email" and not any(x in text for x in ("@", "(at)", "[at]"))):
                more = ((m.start(), m.end()) for m in _WIDE[name].finditer(text))
                for a, b in more:
                    i = int(np.searchsorted([t[0] for t in taken], b)) if taken else 0
                    if not any(a < y and x < b for x, y in taken[max(0, i - 4):i]):
                        spans.append((a, b, kind, False))
    return base, [(a, b, k, sum((v + 1) * 3 ** i for i, v in enumerate(_votes(text, a, b, k, own))), _shape(text, a, b, k), own)
                  for a, b, k, own in spans]


def _features(kind: int, shape: int) -> np.ndarray:
    x = np.zeros(len(KINDS) + 8 + 4 + 8 + 2)
    x[kind] = x[5 + shape % 8] = x[13 + shape // 8 % 4] = x[17 + shape // 32 % 8] = 1
    x[25], x[26] = shape // 256 % 2, shape // 512
    return x


@dataclass
class SpanModel:
    """Prior and reliabilities of the labelers per kind, and the weights of the span classifier."""

    prior: dict = field(default_factory=dict)
    reliability: dict = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(28))

    def probability(self, kind: int, votes: int, shape: int) -> float:
        """The classifier's probability, tempered by what the votes alone say."""
        z = float(self.weights[:-1] @ _features(kind, shape) + self.weights[-1])
        own = 1 / (1 + np.exp(-z))
        return min(own, self.posterior(kind, votes))

    def posterior(self, kind: int, votes: int) -> float:
        if kind not in self.prior:
            return 0.0
        v = np.array([votes // 3 ** i % 3 for i in range(len(LABELERS))])
        log = np.log(self.prior[kind]) + np.log(self.reliability[kind][:, np.arange(len(v)), v]).sum(1)
        return float(1 / (1 + np.exp(log[0] - log[1])))


def fit_model(counts: pd.DataFrame, rounds: int = 50) -> SpanModel:
    """EM over (kind, votes, shape, n): first the labelers' reliabilities per kind, then the classifier on its posteriors."""
    model = SpanModel()
    for kind, part in counts.groupby("kind"):
        by = part.groupby("votes")["n"].sum()
        votes = np.array([[v // 3 ** i % 3 for i in range(len(LABELERS))] for v in by.index])
        n = by.to_numpy(dtype=float)
        p = 1 / (1 + np.exp(-(votes - 1).sum(1)))
        for _ in range(rounds):
            both = np.stack([n * (1 - p), n * p])
            prior = (both.sum(1) + 1) / (n.sum() + 2)
            seen = np.stack([[np.bincount(votes[:, i], weights=w, minlength=3) + 0.5 for i in range(len(LABELERS))] for w in both])
            seen /= seen.sum(2, keepdims=True)
            log = np.log(prior)[:, None] + np.log(seen[:, np.arange(len(LABELERS)), votes]).sum(2)
            p = 1 / (1 + np.exp(log[0] - log[1]))
        model.prior[int(kind)], model.reliability[int(kind)] = prior, seen
    if len(counts):
        x = np.stack([np.r_[_features(int(k), int(s)), 1] for k, s in zip(counts["kind"], counts["shape"])])
        y = np.array([model.posterior(int(k), int(v)) for k, v in zip(counts["kind"], counts["votes"])])
        n = counts["n"].to_numpy(dtype=float)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            q = 1 / (1 + np.exp(-(x @ w)))
            w = w + np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - q)) - w)
        model.weights = w
    return model


def _candidate_batch(cols: dict) -> dict:
    found = [candidates(t or "") for t in cols["text"]]
    return {"doc_id": cols["doc_id"], "base": [[list(s) for s in b] for b, _ in found],
            "spans": [[list(map(int, s)) for s in c] for _, c in found]}


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row of ``docs``; each span is a short list of numbers, no text is kept."""
    bound_batches(docs.sparkSession)
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), _candidate_batch,
                    "doc_id long, base array<array<int>>, spans array<array<int>>")


def train(rows: DataFrame) -> SpanModel:
    """A model from all candidates. They are counted by kind, votes and shape, at most 5 * 243 * 1024 groups whatever the data."""
    counts = (rows.select(F.explode("spans").alias("s")).groupBy(F.col("s")[2].alias("kind"), F.col("s")[3].alias("votes"), F.col("s")[4].alias("shape"))
              .agg(F.count(F.lit(1)).alias("n")))
    return fit_model(counts.toPandas().sort_values(["kind", "votes", "shape"]))


def decide(base: list, spans: list, model: SpanModel, confidence: float) -> list[tuple[int, int, int]]:
    """The base spans and the added ones, by start and kind; added ones do not overlap each other."""
    out = [tuple(s) for s in base]
    end = -1
    for a, b, k, votes, shape, own in sorted(spans):
        if not own and a >= end and model.probability(k, votes, shape) >= confidence:
            out.append((a, b, k))
            end = b
    return sorted(out, key=lambda s: (s[0], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _result_batch(cols: dict, model: SpanModel, confidence: float) -> dict:
    out = {"doc_id": cols["doc_id"], "spans": [], "base_sha256": [], **{f"n_{k}": [] for k in KINDS[:4]}}
    for base, spans in zip(cols["base"], cols["spans"]):
        for i, k in enumerate(KINDS[:4]):
            out[f"n_{k}"].append(sum(s[2] == i for s in base))
        out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out["spans"].append(_joined(decide(base, spans, model, confidence)))
    return out


def personal_data(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Null and empty texts have no span; repeated rows and null ids have a row
    each. Counts and digest cover the base spans, ``spans`` the added ones too,
    in code points with the end exclusive. Texts are read once.
    """
    rows = stored(candidate_rows(docs), "candidates")
    model = train(rows)
    return map_rows(rows, _result_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                    model, confidence)


def mask(text: str | Column, model: SpanModel, confidence: float = CONFIDENCE) -> Column:
    """The text with each span, overlapping ones merged, replaced by its kind in angle brackets; null stays null."""
    def one(t):
        if t is None:
            return None
        out, end = [], 0
        for a, b, k in decide(*candidates(t), model, confidence):
            if a >= end:
                out += [t[end:a], f"<{KINDS[k].upper()}>"]
            end = max(end, b)
        return "".join(out) + t[end:]

    return F.pandas_udf(lambda texts: pd.Series([one(t) for t in texts], dtype=object), "string")(text)


def mask_documents(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with masked texts and, where there is such a column, n_chars of the new text. No row is moved or lost."""
    model = train(candidate_rows(docs))
    out = docs.withColumn("text", mask("text", model, confidence))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
                             .cast(docs.schema["n_chars"].dataType))
    return out

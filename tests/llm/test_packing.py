import zlib

import numpy as np
from pyspark.sql import functions as F

from veriloom.llm import packing as K
from veriloom.llm import tokens


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return [[*e.ids, K.END_ID] for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "Hello  world\n\n\tand <|endoftext|> more", "naïve çà ü ñ 漢字 🙂 é", "don't we'll I'm 12345 !!!??? --", "a" * 3000, " " * 500 + "x", "word " * 5000,
         "\x00\x01 ​ x\r\n", "<|endoftext|>" * 3]


def test_ids_are_those_of_the_tokenizer_library():
    encoder = tokens.load_encoder()
    assert [[*encoder.encode(t), K.END_ID] for t in TEXTS] == library_ids(TEXTS)
    assert library_ids(["a <|endoftext|> b"]) == [[64, 220, 50256, 275, K.END_ID]]  # the file's special token is one id


def test_pieces_cover_every_id_once_and_sequences_have_no_gap(spark):
    docs = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(50, None, "x", 1), (None, "no id", "x", 1), (3, TEXTS[3], "x", 1)]
    packed = K.pack(spark.createDataFrame(docs, "doc_id long, text string, piece_id string, g int"), group_pieces=4)
    rows = packed.collect()
    want = sorted(zip([str(d[0]) for d in docs], library_ids([d[1] or "" for d in docs])))
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"]
        if r["start"] == 0:
            got.setdefault(str(r["doc_id"]), []).append([])
        for copy in got[str(r["doc_id"])]:
            if len(copy) == r["start"]:
                copy += np.frombuffer(r["ids"], dtype="<u4").tolist()
                break
        assert r["doc_tokens"] in {len(i) for d, i in want if d == str(r["doc_id"])}
    assert sorted((d, i) for d, copies in got.items() for i in copies) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.LENGTH
    joined = {r["sequence_id"]: r for r in K.sequences(packed).collect()}
    assert all(len(joined[s]["ids"]) == 4 * sum(n for _, n in p) and joined[s]["lengths"] == [n for _, n in sorted(p)] for s, p in by.items())
    crc = K.pack(spark.createDataFrame(docs[:3], "doc_id long, text string, piece_id string, g int"), F.crc32("ids").alias("c"))
    assert {r["c"] for r in crc.collect()} == {zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in library_ids(TEXTS[:3])}
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_assign(lengths, length, linear=1.0, quadratic=1 / 4096):
    """Every open sequence is looked at for every piece."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    full = [i for i in order if lengths[i] == length]
    out = {i: (n, 0) for n, i in enumerate(full)}
    left = [i for i in order if lengths[i] < length]
    count = len(full) + -(-sum(lengths[i] for i in left) // length)
    state = {s: (0.0, length) for s in range(len(full), count)}
    for i in left:
        fits = [(price, s) for s, (price, room) in state.items() if room >= lengths[i]]
        if not fits:
            state[count] = (0.0, length)
            fits, count = [(0.0, count)], count + 1
        # among equally cheap sequences the search by room may take another, so only cost and room are compared
        price, s = min(fits)
        out[i] = (s, length - state[s][1])
        state[s] = (price + linear * lengths[i] + quadratic * lengths[i] ** 2, state[s][1] - lengths[i])
    return out, sorted(state.values())


def test_assignment_takes_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        lengths = rng.integers(1, 2049, n)
        sequence, offset = K.assign(lengths, 2048)
        price, fill = np.zeros(n + 1), np.zeros(n + 1)
        np.add.at(price, sequence, K.cost(lengths, 1.0, 1 / 4096))
        np.add.at(fill, sequence, lengths)
        _, state = slow_assign(lengths.tolist(), 2048)
        used = [s for s in range(int(sequence.max()) + 1 if n else 0) if s not in set(sequence[lengths == 2048].tolist())]
        assert np.allclose(sorted(price[used]), [p for p, _ in state if p > 0])
        assert (fill <= 2048).all()


def test_little_is_padded():
    lengths = np.random.default_rng(2).integers(1, 2048, 8000)
    sequence, _ = K.assign(lengths, 2048)
    assert lengths.sum() / (2048 * (sequence.max() + 1)) > 0.98

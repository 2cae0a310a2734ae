"""Spelling variants: words one edit apart, found by sorting the rotations of terminator-marked words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.ordered import row_numbers
from veriloom.llm.common import bound_batches, stored

RUN = "[A-Za-zÀ-ÿ]+"
#: One occurrence in this many loses a code point before it is counted.
DAMAGE = 199
MIN_CHARS, MIN_COUNT = 6, 5
#: A variant's form occurs at least this many times as often.
RATIO = 5
#: Ends a word in its rotations; no word holds it, as words are letters.
END = "$"
#: Code points of a key up to which it is text, above that a digest.
PLAIN_CHARS = 64
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 1 << 18


def damaged(doc_id, run: str, every: int) -> str:
    """The run, without its code point h % length if ``every`` divides h, the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % every == 0 else run


def _count_batches(batches, min_chars: int, every: int | None):
    find = re.compile(RUN[:-1] + f"{{{min_chars},}}").findall  # shorter runs stay short
    held: Counter = Counter()

    def passed_on():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # bytes.lower changes A-Z only
            for run, n in Counter(find((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                word = damaged(doc, run, every) if every else run
                if len(word) >= min_chars:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield passed_on()
    if held:
        yield passed_on()


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int | None = DAMAGE) -> DataFrame:
    """(word, n): runs of letters in whole texts, lower-cased A-Z, of at least ``min_chars`` code points and ``min_count`` occurrences.

    ``every`` damages occurrences as ``damaged`` says, None leaves all as they
    are. Counts are added up in each task before they are shuffled. Null texts
    hold no word, a null doc_id counts as an empty one.
    """
    bound_batches(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(lambda it: _count_batches(it, min_chars, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, first, rank, n): what each rotation of ``word + END`` shares with words one edit away.

    A rotation starts behind the edited place and ends with it: w = A c B turns
    to B $ A c. Without its last code point it is the prefix B $ A that words with
    another code point at this place share (replacements) and that is a whole
    rotation of A B (``skipped`` is null there; indels). ``first`` is false where c repeats
    the code point before it: leaving out either gives the same word.

    Keys of more than PLAIN_CHARS code points are digests, so a word takes room in
    proportion to its length, not to the square of it.
    """
    at, size = F.col("at"), F.char_length("word")
    tail, head = F.col("word").substr(at + 1, size), F.col("word").substr(F.lit(1), at)
    rotated = words.where(size < PLAIN_CHARS).withColumn("at", F.explode(F.sequence(F.lit(0), size)))
    skipped = F.when(at > 0, F.col("word").substr(at, F.lit(1)))
    whole = F.struct(F.concat(tail, F.lit(END), head).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first"))
    without = F.struct(F.concat(tail, F.lit(END), F.col("word").substr(F.lit(1), at - 1)).alias("key"), skipped.alias("skipped"),
                       ((at == 1) | (skipped != F.col("word").substr(at - 1, F.lit(1)))).alias("first"))
    rows = F.explode(F.when(at > 0, F.array(whole, without)).otherwise(F.array(whole)))
    plain = rotated.select("rank", "n", rows.alias("r")).select("r.key", "r.skipped", "r.first", "rank", "n")
    long = words.where(size >= PLAIN_CHARS).select("rank", "n", "word").mapInArrow(_rotate_long, "key string, skipped string, first boolean, rank long, n long")
    return plain.unionByName(long)


class Rolling:
    """Digests of any rotation of a word in constant time: polynomials modulo a Mersenne prime of 127 bits."""

    PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A5F1

    def __init__(self, word: str):
        self.word, self.sums, self.powers = word, [0], [1]
        for c in word:
            self.sums.append((self.sums[-1] * self.BASE + ord(c)) % self.PRIME)
            self.powers.append(self.powers[-1] * self.BASE % self.PRIME)

    def key(self, start: int, end: int) -> str:
        """The key ``word[start:] + END + word[:end]``, as text if it has at most PLAIN_CHARS code points."""
        size = len(self.word) - start + 1 + end
        if size <= PLAIN_CHARS:
            return self.word[start:] + END + self.word[:end]
        tail = (self.sums[-1] - self.sums[start] * self.powers[len(self.word) - start]) % self.PRIME
        return f"{size}:{((tail * self.BASE + ord(END)) * self.powers[end] + self.sums[end]) % self.PRIME:x}"


def _rotate_long(batches):
    for batch in batches:
        for rank, n, word in zip(*(c.to_pylist() for c in batch.columns)):
            of, size = Rolling(word), len(word)
            for at in range(0, size + 1, HELD_WORDS):
                places = range(at, min(size + 1, at + HELD_WORDS))
                inner = [i for i in places if i]
                rows = len(places) + len(inner)
                yield pa.RecordBatch.from_arrays([
                    pa.array([of.key(i, i) for i in places] + [of.key(i, i - 1) for i in inner], pa.string()),
                    pa.array([None] * len(places) + [word[i - 1] for i in inner], pa.string()),
                    pa.array([False] * len(places) + [i == 1 or word[i - 1] != word[i - 2] for i in inner], pa.bool_()),
                    pa.array([rank] * rows, pa.int64()), pa.array([n] * rows, pa.int64())], names=["key", "skipped", "first", "rank", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of words (rank, word, n) with a near one: how many there are and the first by (-n, rank).

    Each range of equal prefixes is scanned in the order of frequency; it holds
    at most one row per code point that can be skipped, plus one whole rotation.
    A row takes the range's count and its best other row, so no pair is written.
    """
    rate = F.struct((-F.col("n")).alias("less"), F.col("rank").alias("near"))
    is_whole = F.col("skipped").isNull()
    group, scan = W.partitionBy("key"), W.partitionBy("key").orderBy(is_whole, -F.col("n"), "rank")
    seen = rotations(words).select(
        "rank", is_whole.alias("whole"), "first",
        F.count("skipped").over(group).alias("n_skipped"), F.count_if("first").over(group).alias("n_first"),
        F.min(F.when(is_whole, rate)).over(group).alias("shorter"), F.min(F.when(F.col("first"), rate)).over(group).alias("longer"),
        F.row_number().over(scan).alias("place"), F.first(rate).over(scan).alias("top"),
        F.when(~F.lead(is_whole).over(scan), F.lead(rate).over(scan)).alias("next"))
    indel = F.col("first") & F.col("shorter").isNotNull()
    replaced = F.when(F.col("n_skipped") > 1, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top")))
    found = seen.select(
        "rank", F.when(F.col("whole"), F.col("n_first")).otherwise(F.col("n_skipped") - 1 + indel.cast("int")).alias("n_near"),
        F.when(F.col("whole"), F.col("longer")).otherwise(F.least(replaced, F.when(indel, F.col("shorter")))).alias("best"))
    return found.where("n_near > 0").groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n): distinct words without END.

    ``form`` is the most frequent word one inserted, deleted or replaced code point
    away (ties: the first in code-point order) if it occurs at least ``ratio`` times
    as often, else null; ``root`` is where following forms ends. Counts grow by
    ``ratio`` with every step, so doubling the pointers as often as the logarithm
    of the longest possible chain asks for reaches every root. Null words and
    counts take no part, an empty table gives an empty one, other columns are left out.
    """
    # words are numbered in code-point order once; from then on only numbers are shuffled
    numbered = stored(row_numbers(words.select("word", F.col("n").cast("long")).dropna(), [], ["word"], "rank"), "words")
    near = neighbours(numbered)
    enough = -F.col("best.less") >= ratio * F.col("n")
    table = stored(numbered.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    steps = table.where("form is not null").select("rank", "form")
    links = steps.withColumnRenamed("form", "root")
    span = table.agg(F.min("n"), F.max("n")).first()
    chain, reached = 1, max(1, span[0] or 1)
    while reached * ratio <= (span[1] or 0):
        chain, reached = chain + 1, reached * ratio
    for _ in range(chain.bit_length()):
        ahead = links.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(ahead, "root", "left").select("rank", F.coalesce("further", "root").alias("root")), "roots")
    texts = numbered.select(F.col("rank").alias("form"), F.col("word").alias("form_word"))
    named = (steps.join(texts, "form").select("rank", "form_word")
             .join(links.join(texts.toDF("root", "root_word"), "root").select("rank", "root_word"), "rank"))
    return table.join(named, "rank", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

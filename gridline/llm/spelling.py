"""Spelling variants of words, by Aho-Corasick automata over the halves of words.

If two words differ by one code point, one half of either stands unchanged in
the other: the first at its start or the last at its end. Shards hold the
halves of words in automata; every word is scanned by the shards where its own
starts and ends may stand, hits are kept if offset and length fit, and the rest
is compared. A half that many words share is a list too long to compare: what
lies between its words' fixed ends is halved again, until lists are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, count
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, small, table

#: Fixed value: the letters of a run, once A-Z is lowered.
LETTERS = "a-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A run whose checksum this divides loses a code point.
EVERY = 199
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Words of a list that are compared directly, and halves that a shard holds at most on average.
LIST, SHARD = 64, 1 << 17
#: Words that a task counts before it sends them.
HELD = 1 << 16


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n of all texts of docs(doc_id, text): runs of letters with A-Z lowered and the fixed loss of code points.

    Tasks count their own words first, so that a frequent word is a row a task
    for each 65,536 different ones. Null texts have no words, a null doc_id
    counts as an empty one in the checksum.
    """

    runs = re.compile(f"[{LETTERS}]{{{max(1, least_chars)},}}")  # shorter runs can't become words

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                low = (text.as_py() or b"").lower().decode()  # of bytes, only A-Z
                for word, n in Counter(runs.findall(low)).items():
                    h = zlib.crc32(word.encode(), begun)
                    if not h % every:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < least_chars:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield batch()
                    held = {}
        if held:
            yield batch()

    bounded(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def one_apart(a: str, b: str) -> bool:
    """Whether one code point was inserted, deleted or replaced between a and b."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) != len(a) + 1:
        return False
    same = next(compress(count(), map(ne, a, b)), len(a))
    return a[same:] == b[same + 1 :]


class Automaton:
    """Words by the segments that they must share with a word: a start, an end, or both."""

    def __init__(self, rows: list[tuple[str, int, int, int, int]]):
        """rows: word, n, code points of its fixed start and end, and of a start that is another list's (0: none)."""
        import ahocorasick

        #: By start, end and length: words with n, the other list's start, and the code points next to the fixed ones.
        self.lists: dict[str, dict[str, dict[int, list[tuple[str, int, int, str, str]]]]] = {}
        self.found = ahocorasick.Automaton()
        for word, n, start, end, other in rows:
            first, last = word[:start], word[len(word) - end :]
            several = len(word) - start - end > 1
            ends = (word[start], word[-1 - end]) if several else ("", "")
            self.lists.setdefault(first, {}).setdefault(last, {}).setdefault(len(word), []).append((word, n, other, *ends))
            for segment in (first, last):
                if segment:
                    self.found.add_word(segment, segment)
        if len(self.found):
            self.found.make_automaton()

    def near(self, word: str) -> list[tuple[str, int]]:
        """The words, with n, that are one apart from word and share a list with it; each once."""
        if not len(self.found):
            return []
        size, starts, ends, out = len(word), [""], [""], []
        for at, segment in self.found.iter(word):
            if at + 1 == len(segment):
                starts.append(segment)
            if at + 1 == size:
                ends.append(segment)
        for start in starts:
            by_end = self.lists.get(start)
            for end in ends if by_end else ():
                by_length = by_end.get(end)
                for length in (size - 1, size, size + 1) if by_length else ():
                    if length in by_length and size >= len(start) + len(end):
                        out += self.verified(word, start, end, by_length[length])
        return out

    def verified(self, word: str, start: str, end: str, rows: list[tuple[str, int, int, str, str]]) -> list[tuple[str, int]]:
        """The words of a list that are one apart. One change can't reach both ends of what lies between the fixed segments."""
        between = len(word) - len(start) - len(end)
        a, z = (word[len(start)], word[-1 - len(end)]) if between else (None, None)
        out = []
        for other, n, elsewhere, first, last in rows:
            if (a == first or z == last or not first) and (not elsewhere or word[:elsewhere] != other[:elsewhere]) and one_apart(word, other):
                out.append((other, n))
        return out


def _halved(rows: DataFrame) -> DataFrame:
    """rows(word, n, length, start, end, other) with what lies between start and end halved: two rows of each.

    The second half's row names the start of the first's as other: who shares
    that is found there. length is that of the words looked for.
    """
    middle = F.col("length") - F.col("start") - F.col("end")
    half = F.floor(middle / 2).cast("int")
    first = F.struct((F.col("start") + half).alias("start"), F.col("end").alias("end"), F.col("other").alias("other"))
    last = F.struct(F.col("start").alias("start"), (F.col("end") + middle - half).cast("int").alias("end"), (F.col("start") + half).alias("other"))
    return rows.select("word", "n", "length", F.explode(F.array(first, last)).alias("_of")).select("word", "n", "length", "_of.*")


def _key() -> Column:
    """Where words and those that may be near them meet: the fixed segments and the length looked for."""
    fixed = [F.substring("word", F.lit(1), F.col("start")), F.when(F.col("end") > 0, F.expr("right(word, `end`)")).otherwise("")]
    return F.xxhash64(*fixed, "length", "start", "end")


def _lists(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the words that lists hold and of the words that are looked up in them: key, word, n, start, end, other."""
    begin = [F.lit(0).alias(c) for c in ("start", "end", "other")]
    held = words.select("word", "n", F.char_length("word").alias("length"), *begin)
    lengths = F.array(*[F.char_length("word") + i for i in (-1, 0, 1)])
    asked = words.select("word", "n", F.explode(lengths).alias("length"), *begin).where("length > 1")
    out = None
    while True:
        held, asked = (_halved(rows).withColumn("key", _key()) for rows in (held, asked))
        long_ones = cut(held.where("length - start - end > 1").groupBy("key").count().where(F.col("count") > most).select("key"))
        done = long_ones.isEmpty()
        long_ones = small(long_ones)
        parts = (held, asked) if done else tuple(rows.join(long_ones, "key", "left_anti") for rows in (held, asked))
        out = parts if out is None else tuple(a.unionByName(b) for a, b in zip(out, parts, strict=True))
        if done:
            return out
        held, asked = (cut(rows.join(long_ones, "key", "left_semi").drop("key")) for rows in (held, asked))


def near_words(words: DataFrame, most: int = LIST, shard: int = SHARD) -> DataFrame:
    """word, n_near, best struct<n, word>: the words of words(word, n) that have near ones, and the most frequent of those.

    A word is sent to the few shards of its segments, not to all; a shard's
    automaton holds some 131,072 halves whatever the number of words, and a
    list of over 64 words is split further. Pairs of words stay in the task
    that finds them.
    """
    bounded(words.sparkSession)
    held, asked = _lists(words, most)
    shards = max(4 * words.sparkSession.sparkContext.defaultParallelism, -(-2 * words.count() // shard))
    place = F.pmod(F.col("key"), F.lit(shards)).alias("shard")
    sent = asked.select(place, "word").distinct().select("shard", F.lit(1).alias("role"), "word", *[F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("start", "int"), ("end", "int"), ("other", "int"))])
    rows = held.select(place, F.lit(0).alias("role"), "word", "n", "start", "end", "other").unionByName(sent)
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "role")

    def run(batches: Iterator[pa.RecordBatch]):
        now, kept, automaton = None, [], None
        for batch in batches:
            found = []
            for shard, role, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    now, kept, automaton = shard, [], None
                if not role:
                    kept.append(tuple(row))
                    continue
                if automaton is None:
                    automaton, kept = Automaton(kept), []
                others = automaton.near(row[0])
                if others:
                    word, n = min(others, key=lambda x: (-x[1], x[0]))
                    found.append((row[0], len(others), n, word))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_best")).select("word", "n_near", F.struct((-F.col("_best.n")).alias("n"), F.col("_best.word").alias("word")).alias("best"))


def spelling_groups(words: DataFrame, times: int = TIMES, most: int = LIST, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), which are distinct and not null.

    A word's form is its most frequent near word (ties: the smallest in
    code-point order) if that's at least times as frequent, else null. root is
    where forms lead to, the word itself without one. times must be over 1, so
    that frequencies rise along forms and end. Roots are found by doubling:
    each round follows as many forms as all rounds before. No words give no
    rows; a null word or n and words of one code point take no part.
    """
    words = cut(words.select("word", "n").dropna().where(F.char_length("word") > 1))
    joined = words.join(near_words(words, most, shard), "word", "left")
    formed = F.col("best.n") >= times * F.col("n")
    forms = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")))
    paths = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        longer = cut(paths.join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        paths = longer.drop("_moved")
        if longer.where("_moved").isEmpty():
            break
    return forms.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of the words of all documents.

    Null and empty texts have no words, repeated rows count again, ties go to
    the smaller word; no documents give no rows.
    """
    return spelling_groups(word_counts(table(spark, sf_dir, "documents")))

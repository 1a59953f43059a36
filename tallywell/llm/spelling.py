"""Grouping spelling variants: words one edit apart, found by automata over their halves.

One edit leaves one of a word's two halves intact, so of two words one edit
apart each holds a half of the other, at its beginning or its end. Automaton
shards hold the halves of all words; every word is scanned by the automata that
can match it, which are told by the first (or last) few characters. A match
counts if the half stands where it stood, in a word of at most one character
more or less; the rest is then compared. Where many words share a half, their
rests are looked up by halves again.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import bound_batches, let, lookup, lower_ascii, materialise

#: Code points and occurrences that a word has at least; a form occurs so many times as often as its variant.
LEAST, OCCURRENCES, TIMES = 5, 3, 2
#: Characters of a half that tell its route, and code points of words whose halves one automaton holds (the longest word more).
ROUTE, SHARD = 4, 1 << 20
#: Rests that are compared one by one; more are looked up by their halves.
FEW = 16
RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def slip(run: Column, id_: Column) -> Column:
    """``run`` without one code point where 97 divides the crc32 of ``<id>:<run>``; of a null id as it is."""

    def slipped(h: Column) -> Column:
        n = F.length(run)
        at = F.pmod(h, F.greatest(n, F.lit(1))).cast("int")
        return F.when((h % 97 == 0) & (n > 0), F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)

    return let(F.crc32(F.concat(id_.cast("string"), F.lit(":"), run).cast("binary")), slipped)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, change=None) -> DataFrame:
    """(word, n): the words of at least ``least`` code points, lower-cased from A-Z, that occur at least ``occurrences`` times.

    ``change(run, id)`` may give another column for a lower-cased run of letters.
    Counts are added up in each task before they are shuffled.
    """
    runs = F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("tw_run")
    found = docs.select(F.col(id_col).alias("tw_id"), runs)
    word = change(F.col("tw_run"), F.col("tw_id")) if change else F.col("tw_run")
    found = found.select(word.alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Rests:
    """What is left of words that share a half, to find those one edit apart from a given rest."""

    __slots__ = ("own", "halves")

    def __init__(self):
        self.own: list[tuple[str, tuple]] = []
        self.halves: dict[tuple[int, bool, str], Rests] = {}

    def add(self, rest: str, entry: tuple) -> None:
        self.own.append((rest, entry))

    def near(self, rest: str) -> Iterator[tuple]:
        if len(self.own) <= FEW:
            yield from (entry for other, entry in self.own if one_edit(other, rest))
            return
        if not self.halves:
            for other, entry in self.own:
                n, h = len(other), len(other) // 2
                self.halves.setdefault((n, False, other[:h]), Rests()).add(other[h:], entry)
                if h:  # a rest of one character or none is all the last half
                    self.halves.setdefault((n, True, other[h:]), Rests()).add(other[:h], (other[:h], entry))
        for n in (len(rest) - 1, len(rest), len(rest) + 1):
            h = n // 2
            if same := self.halves.get((n, False, rest[:h])):
                found = same.near(rest[h:]) if h else (entry for other, entry in same.own if one_edit(other, rest))
                yield from found
            cut = len(rest) - (n - h)
            if h and (same := self.halves.get((n, True, rest[cut:]))):
                yield from (entry for head, entry in same.near(rest[:cut]) if head != rest[:h])


class Shard:
    """An automaton over halves of words."""

    def __init__(self):
        self.rests: dict[tuple[str, bool], Rests] = {}
        self.automaton = None

    def add(self, word: str, n: int, at_end: bool) -> None:
        h = len(word) // 2
        half, rest = (word[h:], word[:h]) if at_end else (word[:h], word[h:])
        self.rests.setdefault((half, at_end), Rests()).add(rest, (word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the shard one edit apart from ``word``, each once: by its last half only if its first isn't intact."""
        if not self.rests:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half, _ in self.rests:
                self.automaton.add_word(half, half)
            self.automaton.make_automaton()
        for end, half in self.automaton.iter(word):
            if end + 1 == len(half) and (found := self.rests.get((half, False))):
                yield from found.near(word[len(half):])
            if end + 1 == len(word) and (found := self.rests.get((half, True))):
                yield from (x for x in found.near(word[:-len(half)]) if not word.startswith(x[0][:len(x[0]) // 2]))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, scanned, at_end, word, n), a shard's halves before the words that it scans -> (word, n_near, form_n, form)."""
    name, shard = None, Shard()
    for batch in batches:
        out: list[tuple] = []
        for key, scanned, at_end, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != name:
                name, shard = key, Shard()
            if not scanned:
                shard.add(word, n, at_end)
                continue
            count, best = 0, (0, "")
            for other, m in shard.near(word):
                count += 1
                if m > best[0] or m == best[0] and other < best[1]:
                    best = (m, other)
            if count:
                out.append((word, count, *best))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])


def _route(word: Column, at_end: bool, length: Column) -> Column:
    """What tells the shards of a half of a word of ``length`` that ``word`` may hold."""
    half = F.floor((length + 1) / 2 if at_end else length / 2).cast("int")
    k = F.least(half, F.lit(ROUTE), F.length(word))
    part = F.substring(word, F.length(word) - k + 1, k) if at_end else F.substring(word, F.lit(1), k)
    return F.concat(F.lit(">" if at_end else "<"), part)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of different words.

    Words near none have 0 and nulls. The form is the near word of largest n,
    of equals the least, if it occurs TIMES as often. A task holds one automaton
    at a time and streams the words that this scans. A route's halves beyond
    ``shard`` code points are dealt to several automata, each of which scans all
    words of the route.
    """
    spark = words.sparkSession
    bound_batches(spark)
    n = F.length("word")
    own = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("at_end"))
    own = own.withColumn("route", F.when(F.col("at_end"), _route(F.col("word"), True, n)).otherwise(_route(F.col("word"), False, n)))
    sizes = materialise(own.groupBy("route").agg(F.sum(n).alias("size")), "routes")
    hot = sizes.where(F.col("size") > shard).select("route", F.ceil(F.col("size") / shard).cast("int").alias("parts"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(-(-total // shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cold = F.concat(F.lit("="), F.pmod(F.xxhash64("route"), F.lit(shards)))
    at = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("string")
    indexed = lookup(own, hot, "route", "left").select(
        F.when(F.col("parts").isNull(), cold).otherwise(F.concat("route", at)).alias("shard"), F.lit(False).alias("scanned"), "at_end", "word", "n")
    routes = F.array_distinct(F.array(*[_route(F.col("word"), end, n + d) for end in (False, True) for d in (-1, 0, 1)]))
    each = lookup(words.select("word", "n", F.explode(routes).alias("route")), hot, "route", "left")
    parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.concat("route", i.cast("string")))
    # routes of one word may share a shard, which then scans it once
    scanned = each.where(F.col("parts").isNull()).select(cold.alias("shard"), "word", "n").distinct().unionByName(
        each.where(F.col("parts").isNotNull()).select(F.explode(parts).alias("shard"), "word", "n"))
    scanned = scanned.select("shard", F.lit(True).alias("scanned"), F.lit(False).alias("at_end"), "word", "n")
    dealt = indexed.unionByName(scanned).repartition("shard").sortWithinPartitions("shard", "scanned")
    found = dealt.mapInArrow(scan, "word string, n_near long, form_n long, form string")
    every = found.select("word", F.lit(0).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("m"), "form").alias("best"))
    every = every.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:bigint,form:string>").alias("best")))
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    often = -F.col("best.m") >= TIMES * F.col("n")
    return best.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, for the words that have a form.

    Forms occur more often than their variants, so chains end. Every round
    doubles the links that a root lies ahead.
    """
    roots = materialise(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = lookup(roots.select("word", "root"), ahead, "root", "left")
        roots = materialise(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return roots.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, change=None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``; see word_counts and near_words.

    ``root`` is the last form from the word on, the word itself if it has none.
    Null and empty texts have no words; repeated rows count each time; an empty
    table gives no rows; other columns are ignored. Words may be of any length.
    """
    words = materialise(word_counts(docs, id_col, text_col, least, occurrences, change), "words")
    near = materialise(near_words(words), "near")
    out = near.join(follow(near), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Phrase collocations by relational mining: an occurrence relation, extended length by length."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachline.llm.common import stored

LONGEST, LEAST, TOP = 4, 30, 2000
CHUNK_WORDS = 1 << 18
"""Words of one language in one row of the stored occurrence relation, which one task counts at
a time: some 16 MB of arrays. Counts of a task's chunks are added up before they are shuffled."""

HELD_WORDS = 1 << 20
"""Words of all languages that a task holds while it makes chunks; beyond it the fullest one is
stored early, so many languages take no more memory than a few."""

ROWS = 1 << 15
"""Counts that leave a Python worker at once."""

MOST_BITS = 1 << 27
"""Bits of a filter, 16 MB. A fuller filter lets more rare phrases be counted; results do not
change."""

BATCH = "8m"
"""Bytes of rows that reach a Python worker at once."""

SHARES = 64
"""Parts of a language's candidates that are ranked apart before their first ones are ranked
together, so no task has all candidates of a language."""

PIECE = 1 << 20  # bytes of a text that are cut into words at once

_END = b"\xff"  # between pieces; no byte of UTF-8
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else
               32 if b == 9 else b for b in range(256))


class _Codes(dict):
    """Word to its number in a chunk, from 1 in the order of appearance; 0 ends a piece and
    -1 is no word."""

    def __init__(self) -> None:
        super().__init__({_END: 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self) - 1
        return self[word]


def _codes_of(text: str | None, codes: _Codes) -> Iterator[np.ndarray]:
    """Word numbers of a text in order, with 0 between pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        words = data[at:end].replace(_END, b" \xff ").split(b" ")
        found = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        yield found[found >= 0]
        at = end


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The occurrence relation of whole documents: per chunk and language one row with the
    word numbers in order of document, piece and position, the words by number, and their
    counts."""
    held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
    waiting: dict[str, int] = {}

    def emit(lang: str) -> pd.DataFrame:
        codes, parts = held.pop(lang)
        del waiting[lang]
        numbers = np.concatenate(parts)
        words = [w.decode("utf-8", "surrogatepass") for w in codes if w not in (b"", _END)]
        counts = np.bincount(numbers, minlength=len(words) + 1)[1:]
        rows = [(lang, numbers.tobytes(), "\n".join(words), counts)] if words else []
        return pd.DataFrame(rows, columns=["lang", "codes", "words", "counts"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in held:
                held[lang], waiting[lang] = (_Codes(), []), 0
            codes, parts = held[lang]
            for found in _codes_of(text, codes):
                parts.append(found)
                waiting[lang] += len(found)
            parts.append(np.zeros(1, np.int32))
            waiting[lang] += 1
            if waiting[lang] >= CHUNK_WORDS:
                yield emit(lang)
            elif sum(waiting.values()) >= HELD_WORDS:
                yield emit(max(waiting, key=waiting.__getitem__))
    for lang in list(held):
        yield emit(lang)


def word_ids(lang: str, words: list[str], exceptions: dict[tuple[str, str], int]) -> np.ndarray:
    """A number for each word of a language: a hash, or that of ``exceptions``."""
    head = lang.encode("utf-8", "surrogatepass") + b"\n"
    ids = np.fromiter((xxhash.xxh3_64_intdigest(head + w.encode("utf-8", "surrogatepass"))
                       for w in words), np.uint64, len(words)).view(np.int64)
    for i, word in enumerate(words) if exceptions else ():
        ids[i] = exceptions.get((lang, word), ids[i])
    return ids


def _keys(ids: np.ndarray) -> np.ndarray:
    """One hash for each row of word numbers."""
    total = np.full(len(ids), ids.shape[1], np.uint64)
    for column in ids.T:
        total = (total ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


class Filter:
    """A Bloom filter of frequent phrases: it holds all of them and few others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits  # 64 in each number

    @staticmethod
    def places(ids: np.ndarray, size: int) -> np.ndarray:
        keys = _keys(ids)
        return np.stack([(keys >> np.uint64(s)) & np.uint64(size - 1) for s in (0, 18, 36)])

    def holds(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for place in self.places(ids, 64 * len(self.bits)):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)]
                    >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, frequent: DataFrame, columns: list[str]) -> Filter:
        """Built where the rows are; only set bits, at most ``MOST_BITS``, come to the driver."""
        size = 1 << 16
        while size < min(16 * frequent.count(), MOST_BITS):
            size *= 2

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = np.zeros(size // 64, np.uint64)
            for batch in batches:
                for place in cls.places(batch.to_numpy(np.int64), size):
                    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64),
                                     np.uint64(1) << (place & np.uint64(63)))
            used = np.flatnonzero(words)
            yield pd.DataFrame({"place": used, "bits": words[used].view(np.int64)})

        rows = (frequent.select(*columns).mapInPandas(mark, "place bigint, bits bigint")
                .groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas())
        words = np.zeros(size // 64, np.uint64)
        words[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


def _grams(length: int, filters: list[Filter], exceptions: dict):
    """Counts of the phrases of ``length`` words in each chunk whose shorter parts the filters
    hold: the relation of one length is joined with itself at the next position."""
    names = [*(f"w{i + 1}" for i in range(length)), "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, words in zip(*(batch.column(c) for c in ("lang", "codes", "words"))):
                numbers = np.frombuffer(codes.as_buffer(), np.int32)
                ids = word_ids(lang.as_py(), words.as_py().split("\n"), exceptions)[:, None]
                alive = np.r_[False, filters[0].holds(ids)]
                at = np.flatnonzero(alive[numbers])  # sorted occurrences of frequent parts
                part = numbers[at].astype(np.int64) - 1
                for size in range(2, length + 1):
                    # the merge-join: occurrences that have one at the next position
                    near = np.flatnonzero(at[1:] == at[:-1] + 1)
                    pairs = part[near] * len(ids) + part[near + 1]
                    pairs, part, counts = np.unique(pairs, return_inverse=True,
                                                    return_counts=True)
                    at = at[near]
                    left, right = pairs // max(len(ids), 1), pairs % max(len(ids), 1)
                    ids = np.concatenate([ids[left], ids[right][:, -1:]], axis=1)
                    if size < length:
                        held = filters[size - 1].holds(ids)
                        kept = held[part]
                        at, part = at[kept], part[kept]
                found = [*np.ascontiguousarray(ids.T), counts.astype(np.int64)]
                for first in range(0, len(counts), ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[first:first + ROWS]) for c in found], names=names)
    return count


def _numbered(words: DataFrame) -> tuple[DataFrame, dict]:
    """Words (lang, word, f) with a number ``w1``, and the exceptions: words whose hash another
    word has too. They number n * n / 2 ** 65 of n words, and their new numbers are checked
    against all others, so numbers are unique and counts by number exact."""
    @F.pandas_udf("bigint")
    def number(langs: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([int(word_ids(a, [b], {})[0]) for a, b in zip(langs, texts)],
                         dtype="int64")

    hashed = stored(words.withColumn("w1", number("lang", "word")), "words")
    twice = (hashed.groupBy("w1").agg(F.count("*").alias("times"))
             .where("times > 1").drop("times"))
    shared = sorted((r.lang, r.word) for r in
                    hashed.join(twice, "w1", "left_semi").select("lang", "word").collect())
    exceptions: dict[tuple[str, str], int] = {}
    while len(exceptions) < len(shared):
        free = len(exceptions)
        wanted = {pair: xxhash.xxh3_64_intdigest(repr((pair, free, n))) - 2**63
                  for n, pair in enumerate(shared)}
        taken = hashed.where(F.col("w1").isin(list(wanted.values()))).count()
        if not taken and len(set(wanted.values())) == len(shared):
            exceptions = wanted
    if exceptions:
        new = hashed.sparkSession.createDataFrame(
            [(a, b, w) for (a, b), w in exceptions.items()], "lang string, word string, w bigint")
        hashed = (hashed.join(new, ["lang", "word"], "left")
                  .withColumn("w1", F.coalesce("w", "w1")).drop("w"))
    return hashed, exceptions


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside reach Python workers in batches of ``BATCH``: by default a batch
    holds 64 MB, twice that while it grows, in the JVM and again in each worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    earlier = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, earlier)


def _whole(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _scored(grams: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the cut with the smallest score, the earliest of equals."""
    options = F.array(*[
        F.struct(F.expr(f"(cast(a as decimal(20,0)) * 2000000) div "
                        f"(cast({first} as decimal(20,0)) + cast({rest} as decimal(20,0)))")
                 .alias("score"), F.lit(k).alias("k"), F.col(first).alias("l"),
                 F.col(rest).alias("r"))
        for k, (first, rest) in enumerate(cuts, 1)])
    return (grams.withColumn("cut", F.array_min(options))
            .withColumns({c: F.col(f"cut.{c}") for c in ("l", "r", "score")}).drop("cut"))


def _table(grams: DataFrame, columns: list[str], frequency: str) -> DataFrame:
    """A frequency table under other names, to look up the parts of longer phrases."""
    old = [f"w{i + 1}" for i in range(len(columns))]
    return grams.select(*[F.col(o).alias(c) for o, c in zip(old, columns)],
                        F.col("a").alias(frequency))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to 4 words that hold together
    best, ``top`` for each language.

    ``docs`` has lang (null is ``und``) and text. A-Z are lower-cased; texts are split at
    ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. a is the number
    of occurrences of a phrase within pieces, at least ``least``; n all words of the language.
    Of the cuts into two parts with l and r occurrences the one with the smallest
    floor(2000000 * a / (l + r)) gives score, l and r, the earliest of equals. A phrase whose
    words lie in a longer one with at least 80 % of its occurrences is left out. Ranks go by
    score, then a, descending, then phrase.

    Method. The occurrence relation is stored in chunks, sorted by document, piece and
    position. Phrases of each length come from joining the relation of the length before with
    itself at the next position, within chunks, as no piece is cut; they are counted per chunk,
    then over all, and only occurrences of frequent ones are extended. This semi-join is a
    filter without false negatives, of bounded size, that every task has; the counts decide.
    Occurrences are never shuffled, only their counts, so a phrase, a language or a passage
    with very many occurrences sends one row per chunk.

    Null and empty texts have no words. Repeated rows count as often as they occur. A table
    without rows or frequent phrases gives no rows. Other columns are not read.
    """
    with _small_batches(docs.sparkSession):
        levels, totals = _counted(docs, least)
    return _ranked(levels, totals, top)


def _counted(docs: DataFrame, least: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, stored, and the words of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    relation = stored(rows.mapInPandas(
        _chunks, "lang string, codes binary, words string, counts array<bigint>"), "occurrences")
    words = (relation.select("lang", F.explode(F.arrays_zip(
        F.split("words", "\n").alias("word"), F.col("counts").alias("f"))).alias("e"))
        .groupBy("lang", F.col("e")["word"].alias("word"))
        .agg(F.sum(F.col("e")["f"]).alias("a")))
    numbered, exceptions = _numbered(words)
    totals = (relation.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"),
                                                  lambda s, c: s + c).alias("n"))
              .groupBy("lang").agg(F.sum("n").alias("n")))
    levels = [stored(numbered.where(F.col("a") >= least), "words-1")]
    filters = [Filter.of(levels[0], ["w1"])]
    for length in range(2, LONGEST + 1):
        names = [f"w{i + 1}" for i in range(length)]
        counted = (relation.select("lang", "codes", "words").mapInArrow(
            _grams(length, filters, exceptions),
            ", ".join(f"{c} bigint" for c in [*names, "n"]))
            .groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least))
        levels.append(stored(counted, f"words-{length}"))
        if length < LONGEST:
            filters.append(Filter.of(levels[-1], names))
    return levels, totals


def _ranked(levels: list[DataFrame], totals: DataFrame, top: int) -> DataFrame:
    """Scores, the choice among nested phrases, and the first ``top`` of each language."""
    one, two, three, four = levels
    first = one.select("w1", "lang", F.col("a").alias("f1"))
    two = two.join(first, "w1").join(_table(one, ["w2"], "f2"), "w2")
    scored = [(two, [("f1", "f2")])]
    parts = three.join(first, "w1").join(_table(one, ["w3"], "f3"), "w3")
    parts = (parts.join(_table(levels[1], ["w1", "w2"], "f12"), ["w1", "w2"])
             .join(_table(levels[1], ["w2", "w3"], "f23"), ["w2", "w3"]))
    scored.append((parts, [("f1", "f23"), ("f12", "f3")]))
    parts = four.join(first, "w1").join(_table(one, ["w4"], "f4"), "w4")
    parts = (parts.join(_table(levels[1], ["w1", "w2"], "f12"), ["w1", "w2"])
             .join(_table(levels[1], ["w3", "w4"], "f34"), ["w3", "w4"])
             .join(_table(three, ["w1", "w2", "w3"], "f123"), ["w1", "w2", "w3"])
             .join(_table(three, ["w2", "w3", "w4"], "f234"), ["w2", "w3", "w4"]))
    scored.append((parts, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]))

    kept = None
    for size, (grams, cuts) in enumerate(scored, 2):
        names = [f"w{i + 1}" for i in range(size)]
        if size < LONGEST:
            # The most frequent longer phrase around it is one word longer: its parts occur
            # at least as often as any phrase around them.
            longer = levels[size].select(
                F.explode(F.array(*[F.struct(
                    *[F.col(f"w{i + 1 + shift}").alias(f"w{i + 1}") for i in range(size)],
                    F.col("a").alias("longer")) for shift in (0, 1)])).alias("e")).select("e.*")
            longer = longer.groupBy(*names).agg(F.max("longer").alias("longer"))
            grams = (grams.join(longer, names, "left").where(
                F.col("longer").isNull()
                | (5 * _whole(F.col("longer")) < 4 * _whole(F.col("a")))))
        grams = _scored(grams, cuts).select(
            "lang", "a", "l", "r", "score",
            *[F.col(n) if n in names else F.lit(None).cast("bigint").alias(n)
              for n in (f"w{i + 1}" for i in range(LONGEST))])
        kept = grams if kept is None else kept.unionByName(grams)

    # A place among the first of its language is one among the first of its share too.
    kept = kept.withColumn("share", F.pmod(F.xxhash64(*[f"w{i + 1}" for i in range(LONGEST)]),
                                           F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
        kept = kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    for i in range(LONGEST):
        kept = kept.join(one.select(F.col("w1").alias(f"w{i + 1}"),
                                    F.col("word").alias(f"word{i + 1}")), f"w{i + 1}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"word{i + 1}" for i in range(LONGEST)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(totals, "lang")
            .select("lang", "rank", "phrase", *[F.col(c).cast("bigint").alias(c)
                                                for c in ("a", "l", "r", "n", "score")]))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text")
    return collocations(docs)


ORACLE_SQL = rf"""
  WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  f AS (
    SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS f
    FROM split, unnest(range(1, {LONGEST + 1})) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
    GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST}),
  candidates AS (SELECT lang, k, words, f AS a FROM f WHERE k > 1),
  cuts AS (
    SELECT c.lang, c.words, c.a, c.k, j, l.f AS l, r.f AS r,
      CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score
    FROM candidates c, unnest(range(1, c.k)) AS t(j)
    JOIN f l ON l.lang = c.lang AND l.words = c.words[:j]
    JOIN f r ON r.lang = c.lang AND r.words = c.words[j + 1:]),
  best AS (
    SELECT * FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
  inside AS (
    SELECT lang, part AS words, max(a) AS longer FROM (
      SELECT c.lang, c.a, c.words[i:i + m - 1] AS part
      FROM candidates c, unnest(range(2, c.k)) AS s(m), unnest(range(1, c.k - m + 2)) AS t(i))
    GROUP BY ALL),
  kept AS (
    SELECT b.*, array_to_string(b.words, ' ') AS phrase
    FROM best b LEFT JOIN inside i USING (lang, words)
    WHERE longer IS NULL OR 100 * longer < 80 * a),
  totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM kept JOIN totals USING (lang)
  QUALIFY rank <= {TOP}"""

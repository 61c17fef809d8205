"""Benchmark decontamination: suffix arrays of the training words, searched for test suffixes."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import stored, whole_ids, with_null_ids

WINDOW = 10
SHARD_WORDS = 1 << 20
"""Words of documents in one suffix array, about 50 MB while it is sorted."""

BLOCK_BYTES = 16 << 20
"""Bytes of test texts that go to every task at once; more of them make more passes."""

PIECE = 1 << 20  # bytes of a text that are cut into words at once

_TABLE = bytes(b + 32 if 65 <= b <= 90 else
               b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in pieces: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class TestBlock:
    """A bounded block of test items, with what every search of it needs.

    ``codes`` numbers the words of the items from 1; 0 is any other word and the gap between
    documents. A row of ``windows`` has the codes of one distinct window, 0 after its end;
    ``lengths`` has its words. ``where`` lists (item number, first word) of every test suffix
    that begins with the window.
    """

    ids: list[str] = field(default_factory=list)
    codes: dict[bytes, int] = field(default_factory=dict)
    windows: np.ndarray = None
    lengths: np.ndarray = None
    where: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], size: int) -> TestBlock:
        block, found = cls(), defaultdict(list)
        for number, (item_id, text) in enumerate(items):
            block.ids.append(item_id)
            codes = [block.codes.setdefault(w, len(block.codes) + 1)
                     for piece in words_of(text) for w in piece]
            for i in range(max(len(codes) - size, 0) + 1 if codes else 0):
                found[tuple(codes[i:i + size])].append((number, i))
        block.windows = np.zeros((len(found), size), np.uint64)
        for row, window in enumerate(found):
            block.windows[row, :len(window)] = window
        block.lengths = np.array([len(w) for w in found], np.int64)
        block.where = list(found.values())
        return block


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a known word in the order of the ``depth`` words that begin there.

    Prefix doubling: positions are sorted by as many words as a number holds; then those that
    are not alone with their rank are sorted by pairs of ranks at growing offsets. A suffix
    that begins with an unknown word equals no test suffix and is left out.
    """
    bits = max(int(codes.max(initial=0)).bit_length(), 1)
    held = min(64 // bits, depth)
    key = _packed(codes, bits, held)
    starts = np.flatnonzero(codes)
    order = starts[np.argsort(key[starts], kind="stable")]
    rank = np.zeros(len(codes) + 1, np.int64)  # 0: left out, or behind the end
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]][:len(order)]
    # A rank is the place of the first of its equals, so it holds while others are refined.
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(1, len(order) + 1), 0))
    while held < depth:
        alone = fresh & np.r_[fresh[1:], True][:len(order)]
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        open_ = order[places]
        second = rank[np.minimum(open_ + held, len(codes))]
        again = np.lexsort((second, rank[open_]))
        open_, second = open_[again], second[again]
        order[places] = open_
        first = rank[open_]
        fresh[places] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[open_] = np.maximum.accumulate(np.where(fresh[places], places + 1, 0))
        held *= 2
    return order


def _packed(codes: np.ndarray, bits: int, count: int) -> np.ndarray:
    """At every position the next ``count`` codes as one number."""
    padded = np.r_[codes, np.zeros(count, codes.dtype)].astype(np.uint64)
    total = np.zeros(len(codes), np.uint64)
    for k in range(count):
        total = (total << np.uint64(bits)) | padded[k:k + len(codes)]
    return total


def search(codes: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every place in ``codes`` where a window of ``block`` begins.

    Two binary searches per window in the suffix array find the range of its occurrences.
    """
    size = block.windows.shape[1]
    none = np.zeros(0, np.int64)
    order = suffix_array(codes, size) if len(block.windows) else none
    if not len(order):
        return none, none
    padded = np.r_[codes, np.zeros(size, codes.dtype)].astype(np.uint64)
    cut = np.arange(size)[None, :] < block.lengths[:, None]

    def beyond(at: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix at ``order[at]``, cut to the window's words, is larger."""
        seen = np.where(cut, padded[order[at][:, None] + np.arange(size)], 0)
        differs = seen != block.windows
        first = differs.argmax(axis=1)
        rows = np.arange(len(at))
        larger = seen[rows, first] > block.windows[rows, first]
        return larger | (~differs.any(axis=1) & or_equal)

    def bound(or_equal: bool) -> np.ndarray:
        low = np.zeros(len(block.windows), np.int64)
        high = np.full(len(block.windows), len(order), np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(order) - 1)
            over = beyond(middle, or_equal)
            live = low < high
            high = np.where(live & over, middle, high)
            low = np.where(live & ~over, middle + 1, low)
        return low

    first, last = bound(True), bound(False)
    counts = last - first
    window = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[first[window] + inside], window


def search_long(codes: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """``search`` in shards of ``SHARD_WORDS`` that overlap by a window less one word."""
    size = block.windows.shape[1]
    found = []
    for at in range(0, max(len(codes), 1), SHARD_WORDS):
        position, window = search(codes[at:at + SHARD_WORDS + size - 1], block)
        # What fits into the overlap whole belongs to the next shard, which has it too.
        own = position < SHARD_WORDS
        found.append((position[own] + at, window[own]))
    return tuple(np.concatenate(part) for part in zip(*found))


def maximal(position: np.ndarray, window: np.ndarray, block: TestBlock
            ) -> list[tuple[int, int, int, int]]:
    """(item number, item word, position, words): windows that follow each other in document
    and item joined to longest verbatim matches."""
    rows = sorted((number, at - start, at, int(block.lengths[w]))
                  for at, w in zip(position.tolist(), window.tolist())
                  for number, start in block.where[w])
    out: list[list[int]] = []
    for number, shift, at, length in rows:
        if out and out[-1][:2] == [number, shift] and at <= out[-1][2] + out[-1][3] - length + 1:
            out[-1][3] = at + length - out[-1][2]
        else:
            out.append([number, shift, at, length])
    return [(number, at - shift, at, length) for number, shift, at, length in out]


FOUND = ("doc_id bigint, no_id boolean, text_hash string, n_words bigint, "
         "spans array<array<bigint>>, items array<string>, "
         "matches array<struct<item_id:string,item_word:bigint,first_word:bigint,words:bigint>>")


def _scan(block: TestBlock, with_matches: bool, all_rows: bool):
    """Rows of ``FOUND``, one for each document; spans are (first, last) hit words."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = block.codes.get
        held: list[np.ndarray] = []
        heads: list[tuple] = []
        waiting = 0

        def emit() -> pd.DataFrame:
            codes = np.concatenate(held) if held else np.zeros(0, np.int32)
            position, window = search_long(codes, block)
            ends = np.cumsum([h[3] + 1 for h in heads])
            begins = ends - [h[3] + 1 for h in heads]
            by_place = np.argsort(position, kind="stable")
            position, window = position[by_place], window[by_place]
            cuts = np.searchsorted(position, np.r_[begins, ends[-1:]])
            rows = []
            for n, (doc, none, text, words) in enumerate(heads):
                part = slice(cuts[n], cuts[n + 1])
                at, of = position[part] - begins[n], window[part]
                if not len(at) and not all_rows:
                    continue
                spans: list[list[int]] = []
                for first, length in zip(at.tolist(), block.lengths[of].tolist()):
                    if spans and first <= spans[-1][1] + 1:
                        spans[-1][1] = max(spans[-1][1], first + length - 1)
                    else:
                        spans.append([first, first + length - 1])
                items = sorted({block.ids[i] for w in np.unique(of).tolist()
                                for i, _ in block.where[w]})
                matches = [(block.ids[i], a, b, c) for i, a, b, c in maximal(at, of, block)
                           ] if with_matches else []
                rows.append((doc, none, text, words, spans, items, matches))
            held.clear(), heads.clear()
            return pd.DataFrame(rows, columns=["doc_id", "no_id", "text_hash", "n_words",
                                               "spans", "items", "matches"])

        for batch in batches:
            for doc, none, text, mark in zip(batch["doc_id"], batch["no_id"], batch["text"],
                                             batch["text_hash"]):
                count = 0
                for words in words_of(text):
                    held.append(np.fromiter((code(w, 0) for w in words), np.int32, len(words)))
                    count += len(words)
                held.append(np.zeros(1, np.int32))
                heads.append((doc, none, mark, count))
                waiting += count + 1
                if waiting >= SHARD_WORDS:
                    yield emit()
                    waiting = 0
        if heads:
            yield emit()
    return scan


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_bytes``, or of one item that is longer."""
    block, size = [], 0
    rows = items.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for item_id, text in rows.toLocalIterator():
        more = len(text.encode("utf-8", "surrogatepass"))
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += more
    yield block


def contaminations(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES, with_matches: bool = True) -> DataFrame:
    """Where the texts of ``docs`` repeat ``window`` consecutive words of an item, or the whole
    of an item with fewer words: ``FOUND`` without no_id, a row for every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text. ``spans`` are the hit words as
    (first, last); ``items`` the sorted ids of the items that occur; ``matches`` the longest
    verbatim matches with their places in item and document. Words are compared with A-Z
    lower-cased; marks between them do not count.

    Method. Tasks gather the words of whole documents into shards and build a suffix array of
    each by prefix doubling; every suffix of the test items is looked up by two binary
    searches, which give all its places. Documents are not shuffled. Test items go to the tasks
    in blocks of at most ``block_bytes`` (a longer item makes its own); each further block is
    a further pass, whose findings are merged by document.

    Null texts have no words. Items without item_id count under an empty id; item ids that
    repeat are one item. Rows that repeat a doc_id are judged each by its own text, also
    without doc_id. Empty tables give empty results, an empty test set no hits. Other columns
    are not read.
    """
    rows = whole_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                     .withColumn("text_hash", F.sha2(F.col("text"), 256)))
    found = None
    for part in _blocks(items, block_bytes):
        scan = _scan(TestBlock.of(part, window), with_matches, found is None)
        more = rows.mapInPandas(scan, FOUND)
        if found is None:
            found, first = more, more
        else:
            found = found.unionByName(stored(more, "contaminations"))
    if found is not first:
        found = _merged(first, found)
    return with_null_ids(found)


def _merged(first: DataFrame, found: DataFrame) -> DataFrame:
    """The findings of several passes, by document and text; every row of ``first`` stays."""
    keys = ["doc_id", "no_id", "text_hash"]
    by_key = found.where(F.size("spans") > 0).groupBy(*keys).agg(*[
        F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "items", "matches")])

    def join(spans):
        """Sorted spans, those that touch as one."""
        last = lambda a: F.element_at(a, -1)
        step = lambda a, s: F.when(
            s[0] <= last(a)[1] + 1,
            F.concat(F.slice(a, 1, F.size(a) - 1),
                     F.array(F.array(last(a)[0], F.greatest(last(a)[1], s[1]))))
        ).otherwise(F.concat(a, F.array(s)))
        whole = F.sort_array(spans)
        return F.aggregate(F.slice(whole, 2, F.greatest(F.size(whole), F.lit(1))),
                           F.slice(whole, 1, 1), step)

    empty = {"spans": "array<array<bigint>>", "items": "array<string>"}
    merged = by_key.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           join(F.col("spans")).alias("spans"),
                           F.array_sort(F.array_distinct("items")).alias("items"),
                           F.array_distinct("matches").alias("matches"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    out = first.drop("spans", "items", "matches").join(merged, same, "left")
    kinds = {**empty, "matches": first.schema["matches"].dataType}
    return out.select(*keys, "n_words", *[
        F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in kinds.items()])


def judge_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    @F.pandas_udf("string")
    def digest(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest())

    found = contaminations(docs, items, window, with_matches=False)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        digest("items").alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text repeats an item; null texts stay."""
    hit = (contaminations(docs, items, window, with_matches=False)
           .where(F.size("spans") > 0).select(F.col("text_hash").alias("__hash")).distinct())
    return docs.join(hit, F.sha2(F.col("text"), 256) == F.col("__hash"), "left_anti")


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return judge_contamination(docs, items)


_WORDS_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE_SQL = f"""
  WITH item_words AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
  doc_words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
  windows AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
      array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS words
    FROM item_words, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS t(i)
    WHERE len(w) > 0),
  places AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
    FROM doc_words, unnest(range(1, len(w) + 1)) AS t(i),
      (SELECT DISTINCT size FROM windows) WHERE i + size - 1 <= len(w)),
  met AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, words)),
  hit AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM met, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
  ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
  FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

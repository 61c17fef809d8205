"""Best-fit packing of documents into training sequences under conflict constraints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import whole_ids, with_null_ids, word_count

CAPACITY = 2048
PER_SOURCE = 3
PIECES_PER_SHARD = 20_000

PLACED = ("doc_id bigint, source string, first_word bigint, n_words bigint, bin_id string, "
          "bin_offset bigint, bin_words bigint")


class Bins:
    """Open bins ordered by residual capacity, with the bitmaps of what they hold.

    ``at[r]`` has the bins with r words left, grouped by the bitmap of sources that are full in
    them; ``present`` is a bitmap of the residuals that occur. A bin has one bitmap per place of
    a source (bit s of bitmap n: it holds more than n pieces of source s) and one of duplicate
    clusters.
    """

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.present = 0
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def _take(self, size: int, source: int, cluster: int) -> int | None:
        """Out of the order: the tightest compatible bin with room for ``size``."""
        ahead = self.present >> size
        room = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1  # successor among the residuals
            room += step
            for full, bins in self.at[room].items():
                if full & source:
                    continue
                for place, b in enumerate(bins):
                    if not self.clusters[b] & cluster:
                        bins[place] = bins[-1]
                        bins.pop()
                        if not bins:
                            del self.at[room][full]
                            if not self.at[room]:
                                self.present &= ~(1 << room)
                        return b
            ahead >>= step + 1
            room += 1
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``cluster`` are single bits or 0."""
        b = self._take(size, source, cluster)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        self.clusters[b] |= cluster
        for n, held in enumerate(self.sources[b]):
            if not held & source:
                self.sources[b][n] = held | source
                break
        if self.left[b]:
            self.at[self.left[b]].setdefault(self.sources[b][-1], []).append(b)
            self.present |= 1 << self.left[b]
        return b, offset


def pack_shard(pieces: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """Bin and offset of every piece (words, source, cluster), longest first.

    Of clusters only those with several pieces need a bit. Pieces of the full capacity have a
    bin of their own. Pieces without words take no room and share one bin, if there is no other.
    """
    sources = {s: 1 << i for i, s in enumerate(sorted({p[1] for p in pieces}, key=repr))}
    repeated = [c for c, n in Counter(p[2] for p in pieces).items() if n > 1]
    clusters = {c: 1 << i for i, c in enumerate(sorted(repeated))}
    bins = Bins(capacity, per_source)
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i))
    out: list = [None] * len(pieces)
    for i in order:
        size, source, cluster = pieces[i]
        if size:
            out[i] = bins.place(size, sources[source], clusters.get(cluster, 0))
        else:
            out[i] = (0, 0)
    return out


def join_bins(pieces: list[tuple], placed: list[tuple[int, int]], capacity: int
              ) -> list[tuple[int, int]]:
    """``placed`` with bins that have room put together, as if each were one piece.

    The bound on sources left that room, so it gives way: no other source was there to fill it.
    Clusters stay apart.
    """
    repeated = [c for c, n in Counter(p[2] for p in pieces).items() if n > 1]
    clusters = {c: 1 << i for i, c in enumerate(sorted(repeated))}
    size, held = Counter(), Counter()
    for (words, _, cluster), (b, _) in zip(pieces, placed):
        size[b] += words
        if words:
            held[b] |= clusters.get(cluster, 0)
    again = Bins(capacity, 1)
    moved = {b: again.place(size[b], 0, held[b])
             for b in sorted(size, key=lambda b: (-size[b], b)) if size[b]}
    return [(moved[b][0], moved[b][1] + offset) if b in moved else (b, offset)
            for b, offset in placed]


def _pack(capacity: int, per_source: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        shard = pd.concat(parts, ignore_index=True).sort_values(
            ["doc_id", "no_id", "cluster", "first_word", "n_words", "source"], ignore_index=True)
        pieces = list(zip(
            shard["n_words"].tolist(), shard["source"].where(shard["source"].notna(), None),
            shard["cluster"].tolist()))
        placed = join_bins(pieces, pack_shard(pieces, capacity, per_source), capacity)
        # A shard is named by its number, and by what it holds to tell runs apart: a task that
        # runs again gives the same bins, and shards with equal pieces have different ones.
        name = f"{TaskContext.get().partitionId()}-" + xxhash.xxh3_64_hexdigest(
            pd.util.hash_pandas_object(shard[["doc_id", "first_word", "cluster"]])
            .to_numpy().tobytes())
        shard["bin_id"] = [f"{name}-{b}" for b, _ in placed]
        shard["bin_offset"] = [o for _, o in placed]
        shard["bin_words"] = shard.groupby("bin_id")["n_words"].transform("sum")
        yield shard[[*(c.split()[0] for c in PLACED.split(", ")), "no_id"]]
    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
                   pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Where every word of ``docs`` goes: pieces with doc_id, source, first_word, n_words,
    bin_id, bin_offset and bin_words (words in the bin).

    A document longer than ``capacity`` words is cut into full pieces and a rest. No two pieces
    in a bin have one duplicate cluster, that is equal texts up to case and white space, and at
    most ``per_source`` pieces have one source, as long as other sources are left in the shard:
    then bins with room are joined. Pieces are dealt evenly to shards of at most about
    ``pieces_per_shard``, whatever their source or text, and each shard is packed best fit,
    longest first: the tightest bin with room that is compatible. Only numbers are moved,
    no texts.

    Null and empty texts are pieces without words, in a bin of their shard. Null sources are one
    source. Repeated rows are all packed. Other columns are not read.
    """
    words = F.regexp_replace(F.lower(F.trim("text")), r"[\x20\x09-\x0D]+", " ")
    size = F.col("size")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source",
        word_count(F.col("text")).alias("size"),
        F.coalesce(F.xxhash64(words), F.lit(0)).alias("document"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)), F.lit(capacity))
    pieces = rows.withColumn("first_word", F.explode(starts))
    pieces = pieces.select(
        "doc_id", "source", "first_word",
        F.least(size - F.col("first_word"), F.lit(capacity)).alias("n_words"),
        F.xxhash64("document", "first_word").alias("cluster"))
    # No document has more pieces than this: a word and its space are two bytes.
    most = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / (2 * capacity)))
    counted = docs.agg(F.sum(F.coalesce(most, F.lit(1)))).first()[0] or 1
    shards = max(1, -(-counted // pieces_per_shard))
    return with_null_ids(whole_ids(pieces).repartition(shards).mapInPandas(
        _pack(capacity, per_source), f"{PLACED}, no_id boolean"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))

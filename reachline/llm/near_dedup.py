"""Near-duplicate documents: HyperMinHash registers, bands, then exact set comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import components, stored, whole_ids, with_null_ids

REGISTERS, MANTISSA = 128, 10
"""Registers of a signature, each six bits of leading zeros and ten of mantissa."""

MOST_MISSED = 1e-7
"""Probability up to which a pair at the threshold may share no band."""

SMALL = 256  # sets below this size are always compared, as their registers repeat elements
BUCKET_TEXTS = 2048  # nodes that share a band and are compared in one task
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 65_536  # texts of a family that are compared in one task

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KEPT_WORDS = 300_000


class WordHashes(dict):
    """Word to its 64-bit hash, for the words a task has met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        self[word] = xxhash.xxh3_64_intdigest(word)
        return self[word]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words, A-Z lower-cased.

    A text with fewer words is one shingle; one without words has none.
    """
    found = (text or "").encode("utf-8").translate(_LOWER).split()
    count = len(found)
    if not count:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, count)
    taken = min(size, count)
    total = np.full(count - taken + 1, taken, np.uint64)
    for j in range(taken):
        total = total * np.uint64(0x9E3779B97F4A7C15) + ids[j:count - taken + 1 + j]
    return np.unique(_mixed(total))


_PROBES = np.argsort(np.random.default_rng(8).random((REGISTERS, REGISTERS)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash: the smallest hash of every bucket as leading zeros and mantissa.

    The first seven bits name the bucket. An empty bucket takes the register of the first full
    one in an order of its own, so registers of small sets agree as often as their elements.
    """
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
    starts = np.searchsorted(hashes, edges)
    full = np.diff(np.r_[starts, len(hashes)]) > 0
    least = hashes[np.minimum(starts, len(hashes) - 1)] << np.uint64(7)
    zeros = np.uint64(64) - np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = np.where(least == 0, np.uint64(57), np.minimum(zeros, np.uint64(57)))
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    marks = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    if not full.all():
        donors = _PROBES[np.arange(REGISTERS), full[_PROBES].argmax(axis=1)]
        marks = np.where(full, marks, marks[donors])
    return marks


def chance_matches(sizes: np.ndarray, size: int) -> np.ndarray:
    """Registers of unrelated sets that agree by chance: equal leading zeros and mantissa."""
    ends = 0.5 ** np.arange(0, 58)
    share = lambda n: np.diff(-(1 - ends) ** np.maximum(n / REGISTERS, 1))
    other = np.abs(share(np.asarray(size, float)))
    bins, places = np.unique(np.round(np.log2(np.maximum(sizes, 1))), return_inverse=True)
    each = [np.abs(share(2.0**b)) @ other / 2**MANTISSA for b in bins]
    return REGISTERS * np.asarray(each)[places]


def band_rows(threshold: float) -> int:
    """Registers of a band, 4, 2 or 1: as many as leave pairs at the threshold unmet with
    probability ``MOST_MISSED`` at most. Thresholds below 0.12 are refused."""
    for rows in (4, 2, 1):
        if (1 - threshold**rows) ** (REGISTERS // rows) <= MOST_MISSED:
            return rows
    raise ValueError(f"{REGISTERS} registers cannot find pairs of similarity {threshold}")


def least_estimate(threshold: float) -> float:
    """Pairs with a lower estimate are not compared: six deviations below the threshold, and
    a little more for the correction of chance matches."""
    return threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5 - 0.03


def _bands(signature: Column, rows: int) -> Column:
    """The bands of a signature, whose numbers hold four registers each."""
    if rows == 4:
        return signature
    mask = F.lit((1 << 16 * rows) - 1)
    return F.flatten(F.transform(signature, lambda four: F.array(*[
        F.shiftrightunsigned(four, 16 * rows * k).bitwiseAND(mask) for k in range(4 // rows)])))


def _signatures(size: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            counts, nodes, bands = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, size, words)
                counts.append(len(hashes))
                if len(hashes):
                    nodes.append(int(xxhash.xxh3_64_intdigest(hashes.tobytes())) - 2**63)
                    bands.append(registers(hashes).view(np.int64))
                else:
                    nodes.append(None)
                    bands.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"],
                                "text_hash": batch["text_hash"], "n_shingles": counts,
                                "node": pd.array(nodes, "Int64"), "bands": bands})
    return sign


def _shingles(size: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(text, size, words).tobytes() for text in batch["text"]]
            yield batch.drop(columns="text").assign(shingles=sets)
    return cut


def _met(least: int, of: int):
    """Pairs (a, b, sure) of every cell of a bucket; rows arrive sorted by bucket and cell."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["band"].tolist(), batch["word"].tolist(),
                               batch["i"].tolist(), batch["j"].tolist(), batch["node"].tolist(),
                               batch["chunk"].tolist(), batch["n_shingles"].tolist(),
                               batch["bands"], batch["shingles"])

        pairs: list[tuple[int, int, bool]] = []
        for (_, _, i, j), cell in groupby(rows(), key=lambda r: r[:4]):
            pairs += _pairs([r[4:] for r in cell], i != j, least, of)
            if len(pairs) > 10_000:
                yield pd.DataFrame(pairs, columns=["a", "b", "sure"])
                pairs = []
        yield pd.DataFrame(pairs, columns=["a", "b", "sure"]).astype(
            {"a": "int64", "b": "int64", "sure": "bool"})
    return compare


def _pairs(members: list[tuple], across: bool, least: int, of: int
           ) -> list[tuple[int, int, bool]]:
    """Of one cell of a bucket the pairs that span its links.

    Pairs with a set below ``SMALL`` are compared exactly and are sure. Of the others those
    with a sufficient estimate come out, not sure, so that each is joined by such pairs or
    by sure ones. Sets come by size, and each meets those that are not too large for it.
    """
    members.sort(key=lambda r: (r[2], r[0]))
    nodes = [r[0] for r in members]
    chunks = np.array([r[1] for r in members])
    sizes = np.array([r[2] for r in members])
    ends = np.searchsorted(sizes, of * sizes // least, "right")
    if (ends == np.arange(1, len(nodes) + 1)).all():
        return []
    sets = [np.frombuffer(r[4], np.uint64) for r in members if r[4] is not None]
    starts = np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)]
    if sets and sizes[0] < SMALL:
        distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(len(distinct), bool)
    marks, cut = None, least_estimate(least / of)
    linked, close = np.arange(len(nodes)), np.arange(len(nodes))
    pairs = []
    for i, end in enumerate(ends):
        others = np.arange(i + 1, end)
        others = others[linked[others] != linked[i]]
        if across:
            others = others[chunks[others] != chunks[i]]
        small = sizes[i] < SMALL
        if not small:
            others = others[close[others] != close[i]]
        if not len(others):
            continue
        group = linked if small else close
        if small:
            marked[places[starts[i]:starts[i + 1]]] = True
            begin, last = others[0], others[-1]
            hits = marked[places[starts[begin]:starts[last + 1]]]
            shared = np.add.reduceat(hits, starts[begin:last + 1] - starts[begin],
                                     dtype=np.int64)[others - begin]
            marked[places[starts[i]:starts[i + 1]]] = False
            found = of * shared >= least * (sizes[others] + sizes[i] - shared)
        else:
            if marks is None:
                marks = np.stack([np.asarray(r[3], np.int64) for r in members]).view(np.uint16)
            chance = chance_matches(sizes[others], sizes[i])
            same = (marks[others] == marks[i]).sum(1)
            found = (same - chance) / (REGISTERS - chance) >= cut
        for k in others[found]:
            if group[k] != group[i]:
                pairs.append((nodes[i], nodes[k], small))
                group[group == group[k]] = group[i]
    return pairs


def _cells(least: int, of: int):
    """Spanning links of every cell; rows arrive sorted by family and cell."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["family"].tolist(), batch["i"].tolist(), batch["j"].tolist(),
                               batch["node"].tolist(), batch["chunk"].tolist(), batch["bands"],
                               batch["shingles"])

        links: list[tuple[int, int]] = []
        for (_, i, j), cell in groupby(rows(), key=lambda r: r[:3]):
            members = {node: (chunk, bands, np.frombuffer(shingles, np.uint64))
                       for _, _, _, node, chunk, bands, shingles in cell}
            links += _links(members, i != j, least, of)
            if len(links) > 10_000:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
        yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")
    return compare


def _links(members: dict, across: bool, least: int, of: int) -> list[tuple[int, int]]:
    """Verified links that span the components of one cell, found estimate first.

    A document is compared exactly with all others at once: its hashes are marked and counted
    in the joined arrays of the cell. That is left out where no other of another component
    has a sufficient estimate.
    """
    nodes = list(members)
    if len(nodes) < 2:
        return []
    cut = least_estimate(least / of)
    chunks = np.array([members[n][0] for n in nodes])
    marks = np.stack([np.asarray(members[n][1], np.int64) for n in nodes]).view(np.uint16)
    sets = [members[n][2] for n in nodes]
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    group = np.arange(len(nodes))
    links = []
    for i in range(len(nodes)):
        open_pairs = (group != group[i]) & (of * np.minimum(sizes, sizes[i])
                                            >= least * np.maximum(sizes, sizes[i]))
        if across:
            open_pairs &= chunks != chunks[i]
        if not open_pairs.any():
            continue
        chance = chance_matches(sizes, sizes[i])
        estimate = ((marks == marks[i]).sum(1) - chance) / (REGISTERS - chance)
        open_pairs &= (estimate >= cut) | (np.minimum(sizes, sizes[i]) < SMALL)
        if not open_pairs.any():
            continue
        own = places[starts[i]:starts[i] + sizes[i]]
        marked[own] = True
        shared = np.add.reduceat(marked[places], starts, dtype=np.int64)
        marked[own] = False
        linked = open_pairs & (of * shared >= least * (sizes + sizes[i] - shared))
        for k in np.flatnonzero(linked):
            if group[k] != group[i]:
                links.append((nodes[i], nodes[k]))
                group[group == group[k]] = group[i]
    return links


def _dealt(members: DataFrame, group: list[str]) -> DataFrame:
    """Members of groups of ``chunks`` chunks, once for every cell (i, j) of two chunks or one
    that holds theirs; cells lie sorted within partitions."""
    cell = [*group, "i", "j"]
    return (members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("i", F.least("chunk", "k")).withColumn("j", F.greatest("chunk", "k"))
            .drop("k", "chunks").repartition(*cell).sortWithinPartitions(*cell))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100)
                    ) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for every row of ``docs``.

    Documents are linked if their sets of distinct ``size``-word shingles have a similarity
    (intersection over union) of at least ``similarity``, a fraction; components are those of
    the links, named by their smallest doc_id, which is kept.

    Method. Equal sets are one node from the start. Each node's registers are cut into bands;
    nodes that share a band are a bucket, compared in cells of at most two chunks of
    ``BUCKET_TEXTS`` nodes. Sets below ``SMALL`` travel whole and their pairs are verified there;
    of larger ones the pairs with enough registers in common, corrected for chance, form
    families (components, so nobody lists pairs). So documents that share a band but are
    unlike do not gather in families, however many there are. A family is compared in cells of
    at most two chunks of about ``CHUNK_TEXTS`` texts, on the full sets, and only links that
    join two components of a cell come out. Every pair that shares a band is in a cell, so no
    link is lost but those missed by all bands. The registers of a band follow from the
    threshold (``band_rows``: 4 from 0.8 on, fewer below), as does the least estimate;
    thresholds below 0.12 are an error.

    Null and empty texts link with nothing and are kept. Rows without doc_id link with nothing
    and are kept, with a null component_id. Rows that repeat a doc_id and its text share its
    fate; if their texts differ, each row has its own component. Other columns are not read.
    """
    return _judged(docs, size, similarity).drop("text_hash")


def _judged(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text, as rows of one doc_id can differ.

    The text of a node is that of the row with its smallest (doc_id, text_hash).
    """
    least, of = similarity
    in_band = band_rows(least / of)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64("text").alias("text_hash"))
    signed = stored(with_null_ids(whole_ids(rows).mapInPandas(
        _signatures(size), "doc_id bigint, no_id boolean, text_hash bigint, n_shingles bigint, "
        "node bigint, bands array<bigint>")), "registers")
    nodes = (signed.where("node is not null and doc_id is not null").groupBy("node")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"),
                  F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
             .select("row.*", "node", "n_shingles", "bands"))
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.posexplode(_bands(F.col("bands"), in_band))
                          .alias("band", "word"))
    # Bands shared by the same nodes are one bucket.
    buckets = (banded.groupBy("band", "word")
               .agg(F.min("node").alias("first"), F.max("node").alias("last"),
                    F.count("*").alias("texts"), F.bit_xor(F.xxhash64("node")).alias("mixed"))
               .where("first < last").groupBy("first", "last", "texts", "mixed")
               .agg(F.min(F.struct("band", "word")).alias("bucket"))
               .select("bucket.*", F.ceil(F.col("texts") / BUCKET_TEXTS).cast("int")
                       .alias("chunks")))
    held = stored(banded.join(buckets, ["band", "word"]), "buckets")
    wanted = nodes.join(held, "node", "left_semi")
    members = stored(rows.where("doc_id is not null").join(wanted, ["doc_id", "text_hash"])
                     .dropDuplicates(["doc_id", "text_hash"])
                     .select("node", "n_shingles", "bands", "text")
                     .mapInPandas(_shingles(size), "node bigint, n_shingles bigint, "
                                  "bands array<bigint>, shingles binary"), "members")
    exact = F.when(F.col("n_shingles") * least <= of * SMALL, F.col("shingles"))
    met = stored(_dealt(held.join(members.withColumn("shingles", exact), "node"),
                        ["band", "word"])
                 .mapInPandas(_met(least, of), "a bigint, b bigint, sure boolean"), "met")

    families = (components(met.where("not sure").select("a", "b"), "families")
                .withColumnRenamed("component", "family").join(members, "node"))
    chunks = (families.groupBy("family")
              .agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("shingles"))
              .select("family", F.ceil(F.greatest(F.col("texts") / CHUNK_TEXTS,
                                                  F.col("shingles") / CHUNK_SHINGLES))
                      .cast("int").alias("chunks")))
    links = (_dealt(families.join(chunks, "family"), ["family"])
             .mapInPandas(_cells(least, of), "a bigint, b bigint")
             .unionByName(met.where("sure").select("a", "b")))
    joined = components(links, "links")
    named = (nodes.select("node", "doc_id").join(joined, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    named = named.select("node", "component").join(
        named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    return (signed.select("doc_id", "text_hash", "n_shingles", "node")
            .join(named.select("node", "component_id"), "node", "left")
            .select("doc_id", "text_hash", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(),
                           F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                           F.lit(True))))


def drop_near_duplicates(docs: DataFrame, size: int = 5,
                         similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` without those that ``near_duplicates`` does not keep, row by row."""
    lost = (_judged(docs, size, similarity).where("not kept")
            .select(F.col("doc_id").alias("__lost"), F.col("text_hash").alias("__hash"))
            .distinct())
    return docs.join(lost, (F.col("doc_id") == F.col("__lost"))
                     & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=3, similarity=(85, 100))

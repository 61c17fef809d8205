"""Document fingerprints: content-defined chunks, compared by shared length."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, USUAL, MOST = 16, 32, 128
"""Bytes of a chunk: none shorter, the size from which a boundary becomes likelier, none longer."""

HARD, EASY = np.uint32(0x3F << 26), np.uint32(0x0F << 26)
"""Bits of the rolling hash that are zero at a boundary, below and from ``USUAL`` bytes."""

DIGEST = 10
_GEAR = np.random.default_rng(0).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """Gear hash at every byte: sum of gear[byte j back] << j over the last 32 bytes.

    The sum over 2n bytes is that over n bytes, plus the one n bytes back shifted by n.
    """
    hashes = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        longer = hashes.copy()
        longer[width:] += hashes[:-width] << np.uint32(width)
        hashes = longer
    return hashes


def chunks(data: bytes) -> list[bytes]:
    """``data`` cut at content-defined boundaries.

    A chunk ends after a byte whose hash is zero in ``HARD``, or from ``USUAL`` bytes on in
    ``EASY``, or at ``MOST`` bytes. As boundaries depend on the last 32 bytes only, two texts
    that share a passage cut it alike soon after its beginning.
    """
    if len(data) <= LEAST:
        return [data] if data else []
    hashes = gear_hashes(data)
    easy = (np.flatnonzero((hashes & EASY) == 0) + 1).tolist()
    hard = (np.flatnonzero((hashes & HARD) == 0) + 1).tolist()
    found, start, size = [], 0, len(data)
    while size - start > LEAST:
        i = bisect_left(hard, start + LEAST)
        end = hard[i] if i < len(hard) else size
        if end >= start + USUAL:
            i = bisect_left(easy, start + USUAL)
            end = min(easy[i] if i < len(easy) else size, start + MOST)
        found.append(data[start:end])
        start = end
    if start < size:
        found.append(data[start:])
    return found


def fingerprint(text: str) -> str:
    """The distinct chunks of ``text``, in order of digest: ten hexadecimal digits of a digest
    and two of the length each. Empty for an empty text."""
    digest = xxhash.xxh3_64_hexdigest
    return "".join(sorted({f"{digest(c)[:DIGEST]}{len(c):02x}"
                           for c in chunks(text.encode("utf-8"))}))


def likeness(one: str, other: str) -> float:
    """Bytes in chunks that both fingerprints have, over the bytes of the smaller one.

    1 if one text's chunks are all in the other, so also for equal texts; two empty ones are
    alike, an empty one is unlike all others.
    """
    if one == other:
        return 1.0
    step = DIGEST + 2
    first, second = ({f[i:i + step] for i in range(0, len(f), step)} for f in (one, other))
    weight = lambda parts: sum(int(p[DIGEST:], 16) for p in parts)
    least = min(weight(first), weight(second))
    return weight(first & second) / least if least else 0.0


def neighbours(docs: DataFrame, per_block: int = 4096) -> DataFrame:
    """(doc_id, text, __block, __guest): documents in blocks that descend by doc_id.

    Each block also gets the first document of the block after it, as a guest; the last block
    gets the very first. Boundaries are approximate quantiles of doc_id and the blocks' first
    ids are read in the driver: numbers, one per block. Each text is moved once, those at
    boundaries twice.
    """
    docs = docs.where("doc_id is not null")
    counted = docs.select("doc_id")
    rows = counted.count()
    wanted = max(1, min(rows // per_block + 1, 20_000))
    bounds = sorted({b for b in counted.agg(F.percentile_approx(
        "doc_id", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] or []}
        if wanted > 1 else [])

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        places = len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left")
        return pd.Series(places).astype("int32")

    placed = docs.select("doc_id", "text", block("doc_id").alias("__block"))
    first = {r[0]: r[1] for r in counted.select("doc_id", block("doc_id").alias("b"))
             .groupBy("b").agg(F.max("doc_id")).collect()}
    order = sorted(first)
    guest_of = {first[b]: order[i - 1] for i, b in enumerate(order)}
    if not order:
        return placed.where("false").withColumn("__guest", F.lit(False))
    firsts = docs.sparkSession.createDataFrame(
        list(guest_of.items()), "__first bigint, __to int")
    # At most 20,000 rows of two numbers are broadcast; texts are moved once.
    known = placed.join(F.broadcast(firsts), F.col("doc_id") == F.col("__first"), "left")
    own = F.struct(F.col("__block").alias("block"), F.lit(False).alias("guest"))
    other = F.struct(F.col("__to").alias("block"), F.lit(True).alias("guest"))
    places = F.when(F.col("__to").isNotNull(), F.array(own, other)).otherwise(F.array(own))
    # Of rows that repeat a block's first id the least text leads the block, as a guest too.
    return (known.select("doc_id", "text", F.inline(places).alias("__block", "__guest"))
            .repartitionById(len(bounds) + 1, F.col("__block"))
            .sortWithinPartitions("__block", "__guest", F.desc("doc_id"),
                                  F.coalesce("text", F.lit(""))))


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double, edited string")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None  # the last row, which waits for the next one
    for batch in batches:
        out = []
        texts = batch["text"].where(batch["text"].notna(), "").tolist()
        for key, text, at, guest in zip(batch["doc_id"].tolist(), texts,
                                        batch["__block"].tolist(), batch["__guest"].tolist()):
            mark = fingerprint(text)
            if held and held[2] == at:
                out.append(_row(held, text, mark))
            held = None if guest else (key, text, at, mark)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def _row(held: tuple, following: str, following_mark: str) -> tuple:
    key, text, _, mark = held
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    edited_mark = fingerprint(edited)
    return (key, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), mark,
            edited_mark, likeness(mark, edited_mark), likeness(mark, following_mark), edited)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, its edited text and their likeness.

    The next document is that with the next smaller doc_id, after the last the first; a single
    document is its own next. The edited text has the last floor(n / 2) characters replaced by
    the first as many, or all, of the next document. Null texts are empty. Rows that repeat a
    doc_id follow each other by text. Rows without doc_id have no place in the order: an empty
    text follows them. Other columns are not read. Results: see ``RESULT``.
    """
    alone = docs.where("doc_id is null").select(
        "doc_id", "text", F.monotonically_increasing_id().alias("__block"))
    following = F.explode(F.array(F.struct("text", F.lit(False).alias("__guest")),
                                  F.struct(F.lit("").alias("text"), F.lit(True).alias("__guest"))))
    alone = alone.select("doc_id", "__block", following.alias("row")).select(
        "doc_id", "row.text", "__block", "row.__guest")
    placed = neighbours(docs).withColumn("__block", F.col("__block").cast("bigint"))
    return (placed.mapInPandas(_compared, RESULT)
            .unionByName(alone.mapInPandas(_compared, RESULT)))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return compare_with_next(docs).drop("edited")

"""Removal of byte strings that repeat across documents, by hashes doubled in texts and anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import stored, whole_ids, with_null_ids

LENGTH = 50
REACH = 32  # windows that may share an anchor, a power of two
PIECE = 1 << 20  # bytes of a text that are hashed at once
TOGETHER = 1 << 16  # bytes of short texts that are hashed at once
SHARD_BYTES = 24 << 20  # text whose anchors are compared in one task
RECORD = 25  # bytes of an anchor: gram, union, document, right and left half, in planes
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BYTES = np.random.default_rng(10).integers(0, 2**63, 256, dtype=np.uint64)
_STEPS = [np.uint64(2 * int(x) + 1)
          for x in np.random.default_rng(11).integers(2**61, 2**62, 40, dtype=np.int64)]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def doubled(data: np.ndarray) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4 ... bytes at every position, each level from pairs of
    ranks of the level before."""
    levels, width = [_BYTES[data]], 1
    while 2 * width <= min(len(data), 64):
        last = levels[-1]
        levels.append(last[:-width] * _STEPS[len(levels)] + last[width:])
        width *= 2
    return levels


def ranked(levels: list[np.ndarray], starts: np.ndarray | slice, length: int) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at ``starts``, from those of powers of two."""
    total, at, part = np.uint64(0), 0, 0
    while at < length:
        k = min(len(levels), (length - at).bit_length()) - 1
        if isinstance(starts, slice):
            value = levels[k][at:at + starts.stop]
        else:
            value = levels[k][starts + at]
        total = total * _STEPS[20 + part % 20] + value
        at, part = at + (1 << k), part + 1
    return _mixed(total)


def anchor_runs(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of all windows of ``length`` bytes: (anchor, first window, last window, gram,
    union), in pieces.

    A window's anchor is where, among its first ``REACH`` positions, the string of
    length - REACH + 1 bytes has the smallest rank, the leftmost of equals. It depends on the
    window's bytes alone, so equal windows have their anchors at the same place. ``gram`` ranks
    that string, which all windows of the anchor contain; ``union`` ranks all bytes that any
    window with this anchor can have.
    """
    for anchors, firsts, lasts, grams, union, _, _ in _runs(data, length, False):
        yield anchors, firsts, lasts, grams, union


def _runs(data: bytes, length: int, halves: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor_runs`` with two ranks of 24 bits: of the bytes that the later windows of the
    anchor have in common (right) and of those of the earlier ones (left). A half without
    windows has 0."""
    half = REACH // 2
    raw, size = np.frombuffer(data, np.uint8), len(data)
    core = length - REACH + 1
    for begin in range(0, max(size - length + 1, 0), PIECE):
        windows = min(PIECE, size - length + 1 - begin)
        low = max(0, begin - REACH + 1)
        part = raw[low:min(size, begin + windows + 2 * length)]
        levels = doubled(part)
        shift = begin - low
        grams = ranked([x[shift:] for x in levels], slice(0, windows + REACH - 1), core)
        least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step < REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        breaks = np.flatnonzero(at[1:] != at[:-1])
        firsts = np.concatenate(([0], breaks + 1))
        lasts = np.concatenate((breaks, [len(at) - 1]))
        anchors = at[firsts]
        union = np.zeros(len(anchors), np.uint64)
        inside = ((anchors + begin >= REACH - 1) & (anchors + begin + length <= size))
        union[inside] = ranked(levels, anchors[inside] + shift - REACH + 1, length + REACH - 1)
        for i in np.flatnonzero(~inside):
            a = int(anchors[i]) + begin
            left, right = min(a, REACH - 1), min(size - a, length)
            union[i] = xxhash.xxh3_64_intdigest(data[a - left:a + right], left * 1000 + right)
        sides = []
        for there, back in ((anchors - lasts < half, 0), (anchors - firsts >= half, half)):
            side = np.zeros(len(anchors) if halves else 0, np.uint64)
            if halves:
                ranks = ranked(levels, anchors[there] + shift - back, length - half + 1)
                side[there] = np.maximum(ranks >> np.uint64(40), np.uint64(1))
            sides.append(side)
        yield anchors + begin, firsts + begin, lasts + begin, grams[anchors], union, *sides


def _runs_of(texts: Iterable[bytes], length: int, halves: bool = True
             ) -> Iterator[tuple[np.ndarray, ...]]:
    """``_runs`` of many texts, with the number of the text before the other columns. Short texts
    are hashed together, and only windows that lie within one of them count."""
    held: list[tuple[int, bytes]] = []
    waiting = 0
    for n, data in enumerate(texts):
        if len(data) >= TOGETHER:
            for run in _runs(data, length, halves):
                yield np.full(len(run[0]), n), *run
        elif len(data) >= length:
            held.append((n, data))
            waiting += len(data)
            if waiting >= TOGETHER:
                yield _runs_together(held, length, halves)
                held, waiting = [], 0
    if held:
        yield _runs_together(held, length, halves)


def _runs_together(held: list[tuple[int, bytes]], length: int, halves: bool
                   ) -> tuple[np.ndarray, ...]:
    core, half = length - REACH + 1, REACH // 2
    data = b"".join(d for _, d in held)
    sizes = np.array([len(d) for _, d in held])
    ends = np.cumsum(sizes)
    levels = doubled(np.frombuffer(data, np.uint8))
    grams = ranked(levels, slice(0, len(data) - core + 1), core)
    least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    own = np.repeat(np.arange(len(held)), sizes)[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[own])
    at = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    breaks = np.flatnonzero(at[1:] != at[:-1])
    firsts = starts[np.concatenate(([0], breaks + 1))]
    lasts = starts[np.concatenate((breaks, [len(at) - 1]))]
    anchors = at[np.concatenate(([0], breaks + 1))]
    which = own[firsts]
    begin, end = (ends - sizes)[which], ends[which]
    union = np.zeros(len(anchors), np.uint64)
    inside = (anchors - begin >= REACH - 1) & (anchors + length <= end)
    union[inside] = ranked(levels, anchors[inside] - REACH + 1, length + REACH - 1)
    edge = np.flatnonzero(~inside)
    for i, a, low, high in zip(edge.tolist(), anchors[edge].tolist(), begin[edge].tolist(),
                               end[edge].tolist()):
        left, right = min(a - low, REACH - 1), min(high - a, length)
        union[i] = xxhash.xxh3_64_intdigest(data[a - left:a + right], left * 1000 + right)
    sides = []
    for there, back in ((anchors - lasts < half, 0), (anchors - firsts >= half, half)):
        side = np.zeros(len(anchors) if halves else 0, np.uint64)
        if halves:
            ranks = ranked(levels, anchors[there] - back, length - half + 1)
            side[there] = np.maximum(ranks >> np.uint64(40), np.uint64(1))
        sides.append(side)
    names = np.array([n for n, _ in held])
    return (names[which], anchors - begin, firsts - begin, lasts - begin, grams[anchors], union,
            *sides)


def _mark(gram: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Names an anchor's gram and union, of which records keep 40 and 48 bits."""
    return _mixed((gram >> np.uint64(24)) * _STEPS[0] + (union & np.uint64(2**48 - 1))
                  ).view(np.int64)


def _tag(data: bytes) -> int:
    """Tells texts apart that share a doc_id."""
    return xxhash.xxh3_64_intdigest(data) & 0x7FFFFF


def _planes(records: np.ndarray) -> bytes:
    """Bytes of records column by column, which compress well."""
    return np.ascontiguousarray(records.T).tobytes()


def _anchors(length: int, shards: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, waiting = [], 0
            keys = batch["doc_id"].to_numpy(np.int64).view(np.uint64)
            texts = ((text or "").encode("utf-8") for text in batch["text"])
            for which, _, _, _, gram, union, right, left in _runs_of(texts, length):
                held.append(np.stack([gram, union, keys[which], right, left], axis=1))
                waiting += len(which)
                if waiting > 1_000_000:
                    yield _dealt(np.concatenate(held), shards)
                    held, waiting = [], 0
            if waiting:
                yield _dealt(np.concatenate(held), shards)
    return emit


def _dealt(rows: np.ndarray, shards: int) -> pd.DataFrame:
    """Records by shard: five bytes of gram, six of union, eight of document, three of each half."""
    shard = (rows[:, 0] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    raw = np.ascontiguousarray(rows[order]).view(np.uint8).reshape(len(rows), 40)
    raw = np.concatenate([raw[:, 3:8], raw[:, 8:14], raw[:, 16:27], raw[:, 32:35]], axis=1)
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    used = [s for s in range(shards) if ends[s] < ends[s + 1]]
    return pd.DataFrame({"shard": np.array(used, np.int32),
                         "data": [_planes(raw[ends[s]:ends[s + 1]]) for s in used]})


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one shard's anchors those whose gram occurs in several documents.

    Anchors whose union occurs in a smaller document too are settled: all their windows repeat.
    The others stay open if one of their halves is shared with other such anchors of their gram.
    """
    shards: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for shard, data in zip(batch["shard"], batch["data"]):
            shards.setdefault(shard, []).append(
                np.frombuffer(data, np.uint8).reshape(RECORD, -1))
    for parts in shards.values():
        raw = np.concatenate(parts, axis=1)
        words = np.zeros((5, raw.shape[1], 8), np.uint8)
        words[0, :, 3:], words[1, :, :6], words[2] = raw[:5].T, raw[5:11].T, raw[11:19].T
        words[3, :, :3], words[4, :, :3] = raw[19:22].T, raw[22:].T
        columns = words.view(np.uint64).reshape(5, -1)
        columns = columns[:, _shared(columns[0], columns[2].view(np.int64))]
        if not columns.shape[1]:
            continue
        gram, union, keys, right, left = columns[:, np.lexsort((
            columns[2].view(np.int64), columns[1], columns[0]))]
        keys = keys.view(np.int64)
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (union[1:] != union[:-1])]
        settled = keys > keys[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        wanted = settled.copy()
        for side in (right, left):
            still = np.flatnonzero(~settled & (side > 0))
            wanted[still] |= _shared(gram[still] | side[still], keys[still])
        fresh = (fresh | np.r_[True, keys[1:] != keys[:-1]]).cumsum()[wanted]
        once = np.flatnonzero(wanted)[np.r_[True, fresh[1:] != fresh[:-1]][:len(fresh)]]
        yield pd.DataFrame({"doc_id": keys[once], "mark": _mark(gram[once], union[once]),
                            "settled": settled[once]})


def _shared(gram: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which grams occur in more than one document."""
    if not len(gram):
        return np.zeros(0, bool)
    order = np.lexsort((keys, gram))
    fresh = np.r_[True, gram[order][1:] != gram[order][:-1]]
    starts = np.flatnonzero(fresh)
    ends = np.r_[starts[1:], len(gram)] - 1
    several = keys[order[starts]] < keys[order[ends]]
    out = np.zeros(len(gram), bool)
    out[order] = several[np.cumsum(fresh) - 1]
    return out


CONTEXT = ("doc_id bigint, tag int, anchor bigint, low int, high int, clip int, context binary, "
           "first bigint, last bigint")


def _held(sorted_marks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of ``marks`` are among ``sorted_marks``."""
    if not len(sorted_marks):
        return np.zeros(len(marks), bool)
    return sorted_marks[np.minimum(np.searchsorted(sorted_marks, marks),
                                   len(sorted_marks) - 1)] == marks


def _contexts(length: int):
    """Settled anchors as ranges of repeated windows; open ones with the bytes around them."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: dict[str, list] = {"open": [], "ranges": []}
            counts_of: dict[str, list] = {"open": [], "ranges": []}
            around, ranges = [], {}
            keys, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            encoded = lambda n: (texts[n] or "").encode("utf-8")
            listed = [[np.sort(np.asarray(x if x is not None else [], np.int64)) for x in batch[c]]
                      for c in ("settled", "open")]
            for which, *columns in _runs_of(map(encoded, range(len(texts))), length, False):
                breaks = np.flatnonzero(which[1:] != which[:-1]) + 1
                marks = _mark(columns[3], columns[4])
                for low, high in zip([0, *breaks.tolist()], [*breaks.tolist(), len(which)]):
                    n = int(which[low])
                    a, first, last = (x[low:high] for x in columns[:3])
                    mark = marks[low:high]
                    hit = _held(listed[0][n], mark)
                    if hit.any():
                        ranges.setdefault(n, []).append(np.stack([first[hit], last[hit]], axis=1))
                    rest = np.flatnonzero(_held(listed[1][n], mark) & ~hit)
                    if not len(rest):
                        continue
                    data = encoded(n)
                    at = a[rest]
                    clip = np.minimum(at, REACH - 1) * 1000 + np.minimum(len(data) - at, length)
                    parts["open"].append(np.stack([at, at - last[rest], at - first[rest], clip]))
                    counts_of["open"].append((keys[n], _tag(data), len(rest)))
                    padded = bytes(REACH) + data + bytes(length)
                    around += [padded[x + 1:x + REACH + length] for x in at.tolist()]
            for n, found in ranges.items():
                joined = _joined(np.concatenate(found), 1)
                parts["ranges"].append(np.array(joined, np.int64).T)
                counts_of["ranges"].append((keys[n], _tag(encoded(n)), len(joined)))
            for kind, names in (("open", ["anchor", "low", "high", "clip"]),
                                ("ranges", ["first", "last"])):
                if not parts[kind]:
                    continue
                ids, tags, counts = (np.array(x, np.int64) for x in zip(*counts_of[kind]))
                frame = pd.DataFrame({"doc_id": np.repeat(ids, counts),
                                      "tag": np.repeat(tags, counts)})
                nothing = pd.arrays.IntegerArray(np.zeros(len(frame), np.int64),
                                                 np.ones(len(frame), bool))
                given = dict(zip(names, np.concatenate(parts[kind], axis=1)))
                for name in ("anchor", "low", "high", "clip", "first", "last"):
                    frame[name] = given.get(name, nothing)
                frame.insert(6, "context", around if kind == "open" else None)
                yield frame
    return emit


def _joined(ranges: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Ranges (first, last) in order, those at most ``gap`` apart as one."""
    found: list[tuple[int, int]] = []
    for first, last in sorted(map(tuple, ranges.tolist())):
        if found and first <= found[-1][1] + gap:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


def _between(context: Column, begin: Column, size: int) -> Column:
    return F.xxhash64(F.substring(context, begin + 1, F.lit(size)))


def _stored(frame: DataFrame, label: str) -> DataFrame:
    """``stored``; its shuffle files go with it, not when the driver next collects garbage."""
    conf = frame.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(frame, label)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, first, last): starts of the windows of ``length`` bytes that also start in
    a document with a smaller doc_id, as ranges. ``docs`` has doc_id, never null, and text.

    Method. Ranks of strings grow by doubling: within a text from bytes to grams, then across
    texts around anchors (see ``anchor_runs``), so that one position in 16 is compared and
    not each. A first comparison by gram settles the anchors whose widest string is known
    from a smaller document and drops those whose gram is unique, or shared but longer on
    neither side: any common window has the half of them on one side that the first round would
    compare. So a gram that many documents have by chance costs no stored surroundings.
    The others go through rounds.
    In each the windows of an anchor are halved; their common part, longer every time, and
    their union are ranked, grouped and joined back. Unique common parts drop out, known unions
    are settled, and after the last round each window stands alone. Groups of the rounds are
    summed up before they are shuffled and their joins can be split. The first comparison is not:
    all anchors of one gram lie in one shard and so in one task, 25 bytes each, which grows with
    the documents that share the passage. Ranks are 64-bit hashes; nothing is sorted as rank
    pairs in Spark.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, min(total // SHARD_BYTES + 1, 60_000))
    marks = _stored(docs.mapInPandas(_anchors(length, shards), "shard int, data binary")
                    .repartitionById(shards, F.col("shard"))
                    .mapInPandas(_repeated, "doc_id bigint, mark bigint, settled boolean"),
                    "marks")
    listed = marks.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("settled"), F.col("mark"))).alias("settled"),
        F.collect_list(F.when(~F.col("settled"), F.col("mark"))).alias("open"))
    found = _stored(docs.join(listed, "doc_id").mapInPandas(_contexts(length), CONTEXT), "contexts")
    windows = ["doc_id", "tag", "first", "last"]
    settled = [found.where("first is not null").select(*windows)]
    rows = found.where("anchor is not null").drop("first", "last").withColumn("at", F.lit(0))
    size = REACH
    while size > 1:
        size //= 2
        halves = F.array(F.col("at"), F.col("at") + size)
        rows = (rows.withColumn("at", F.explode(halves))
                .where((F.col("low") <= F.col("at") + size - 1) & (F.col("high") >= F.col("at"))))
        far = F.col("at") + size - 1
        rows = rows.withColumn("common", F.xxhash64("at", _between(
            F.col("context"), REACH - 1 - F.col("at"), length - size + 1)))
        shared = (rows.groupBy("common").agg(F.min("doc_id").alias("least"),
                                             F.max("doc_id").alias("most"))
                  .where("least < most").drop("most"))
        rows = rows.join(shared, "common")
        if size > 1:
            rows = rows.withColumn("widest", F.xxhash64("at", "clip", _between(
                F.col("context"), REACH - 1 - far, length + size - 1)))
            known = rows.groupBy("common", "widest").agg(F.min("doc_id").alias("source"))
            rows = rows.join(known, ["common", "widest"])
        else:
            rows = rows.withColumn("source", F.col("least"))
        rows = _stored(rows.drop("common", "widest", "least"), f"rank-{size}")
        settled.append(rows.where("source < doc_id").select(
            "doc_id", "tag", (F.col("anchor") - F.least("high", F.col("at") + size - 1))
            .alias("first"), (F.col("anchor") - F.greatest("low", "at")).alias("last")))
        rows = rows.where("source = doc_id").drop("source")
        if rows.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out if settled else spark.createDataFrame([], "doc_id bigint")


def _spans(packed, tag: int, length: int) -> list[tuple[int, int]]:
    """Removed runs (begin, end) of one text."""
    own = [(w["first"], w["last"]) for w in (packed if packed is not None else [])
           if w["tag"] == tag]
    return [(first, last + 1) for first, last in
            _joined(np.array([(f, t + length - 1) for f, t in own]).reshape(-1, 2), 1)]


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with the column __windows; its rows without doc_id have none."""
    known = docs.where("doc_id is not null")
    windows = repeated_windows(known.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                            "text"), length)
    listed = windows.groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_list(F.struct("tag", "first", "last")).alias("__windows"))
    return docs.join(listed, F.col("doc_id") == F.col("__id"), "left").drop("__id")


RESULT = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "spans array<array<bigint>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For every row of ``docs`` the bytes that a string of ``length`` bytes covers which also
    starts in a document with a smaller doc_id: see ``RESULT``; spans are (begin, end).

    Matches never cross documents; strings are judged on the input. A null text is empty. Rows
    without doc_id lose nothing and are no source for others. Rows that repeat a doc_id are
    judged each by itself, against smaller ids only. Other columns are not read.
    """
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, none, text, packed in zip(batch["doc_id"], batch["no_id"], batch["text"],
                                               batch["__windows"]):
                data = (text or "").encode("utf-8")
                spans = _spans(packed, _tag(data), length)
                sha, at = hashlib.sha256(), 0
                for begin, end in spans:
                    sha.update(data[at:begin])
                    at = end
                sha.update(data[at:])
                out.append((key, len(data), sum(e - b for b, e in spans), len(spans),
                            sha.hexdigest(), [list(s) for s in spans], none))
            yield pd.DataFrame(out, columns=[*(c.split()[0] for c in RESULT.split(", ")), "no_id"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return with_null_ids(whole_ids(_marked(rows, length)).mapInPandas(
        finish, f"{RESULT}, no_id boolean"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with those bytes cut from ``text``, as far as they are whole characters.

    Every row stays, with an empty text if nothing is left of it; null texts stay null. A column
    n_chars, if there is one, is counted anew.
    """
    @F.pandas_udf("string")
    def cut(texts: pd.Series, packed: pd.Series) -> pd.Series:
        out = []
        for text, windows in zip(texts, packed):
            if text is not None and windows is not None:
                data = text.encode("utf-8")
                kept, at = [], 0
                for begin, end in _spans(windows, _tag(data), length):
                    while begin < end and data[begin] & 0xC0 == 0x80:
                        begin += 1
                    while end < len(data) and end > begin and data[end] & 0xC0 == 0x80:
                        end -= 1
                    kept.append(data[at:begin])
                    at = max(at, end)
                text = b"".join([*kept, data[at:]]).decode("utf-8")
            out.append(text)
        return pd.Series(out, dtype=object)

    marked = _marked(docs, length)
    out = marked.withColumn("text", cut("text", "__windows")).drop("__windows")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).drop("spans")

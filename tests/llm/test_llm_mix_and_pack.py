from collections import Counter, defaultdict

import pytest
from edges import edge_frame, empty_frame, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachline.llm.common import word_count
from reachline.llm.mixing import MOST_COPIES, mix_copies, mix_documents, source_targets
from reachline.llm.packing import Bins, join_bins, pack_documents, pack_shard


def filled(sizes: dict) -> dict:
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] for s in capped}
        target |= {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1, None: 1000, "d": 7}, {"a": 1}, {"a": 0, "b": 9}, {"a": 0}])
def test_targets_are_reshared(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in source_targets(frame).collect()}
    assert found == pytest.approx(filled(sizes) if sum(sizes.values()) else {"a": 0.0})


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", 1 + i * 7 % 50) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    mixed = mix_copies(frame, [F.col("doc_id")])
    first = mixed.collect()
    taken, target = Counter(), {}
    for r in first:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= MOST_COPIES
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
    again = mix_copies(frame.repartition(7), [F.col("doc_id")]).collect()
    pick = lambda rs: sorted((r.doc_id, r.copies) for r in rs)
    assert pick(first) == pick(again)


def test_mixed_documents_take_edge_rows(spark):
    docs = edge_frame(spark)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    count = lambda frame: Counter(map(tuple, frame.collect()))
    was, now = count(docs), count(mixed)
    assert set(now) <= set(was)
    assert all(n <= MOST_COPIES * was[row] for row, n in now.items())
    assert mix_documents(empty_frame(spark)).count() == 0


def test_word_count(spark):
    texts = [None, "", " a\x0bb\x0c", "é\xa0x y z", "a" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(word_count(F.col("t"))).collect()] == [0, 0, 2, 2, 1]


def best_fit(pieces, capacity, per_source):
    """Straight search through all bins."""
    bins = []
    out = {}
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, source, cluster = pieces[i]
        fits = [b for b in bins if b[0] >= size and b[1][source] < per_source
                and cluster not in b[2]]
        chosen = min(fits, key=lambda b: b[0], default=None)
        if chosen is None:
            chosen = [capacity, Counter(), set(), []]
            bins.append(chosen)
        chosen[0] -= size
        chosen[1][source] += 1
        chosen[2].add(cluster)
        out[i] = capacity - chosen[0] - size
    return len(bins), sorted(b[0] for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from("aab"), st.integers(0, 9)),
                max_size=40))
def test_pieces_fit_without_conflicts(pieces):
    placed = pack_shard(pieces, 20, 2)
    bins = defaultdict(list)
    for piece, (b, offset) in zip(pieces, placed):
        bins[b].append((offset, piece))
    for held in bins.values():
        at = 0
        for offset, piece in sorted(held, key=lambda h: h[0]):
            assert offset == at
            at += piece[0]
        assert at <= 20
        assert max(Counter(p[1] for _, p in held).values()) <= 2
        assert len({p[2] for _, p in held}) == len(held)


def test_search_goes_on_to_the_tightest_compatible_bin():
    bins = Bins(10, 1)
    assert bins.place(6, 1, 0) == (0, 0)
    assert bins.place(5, 1, 0) == (1, 0)  # the source is in bin 0
    assert bins.place(4, 1, 0) == (2, 0)  # and in bin 1
    assert bins.place(4, 2, 1) == (0, 6)  # the tightest with room
    assert bins.place(5, 2, 1) == (1, 5)
    assert bins.place(6, 4, 1) == (2, 4)
    pieces = [(n, "ab"[n % 2], n % 5) for n in range(1, 20)]
    assert best_fit(pieces, 20, 2)[0] == len({b for b, _ in pack_shard(pieces, 20, 2)})


def test_all_words_are_packed(spark):
    docs = edge_frame(spark)
    rows = pack_documents(docs, capacity=100, per_source=2, pieces_per_shard=9).collect()
    held = Counter()
    for r in rows:
        held[r.doc_id] += r.n_words
    sizes = Counter()
    for r in docs.select("doc_id", word_count(F.col("text")).alias("n")).collect():
        sizes[r.doc_id] += r.n
    assert held == sizes and {r.doc_id for r in rows} == set(sizes)
    for b in {r.bin_id for r in rows}:
        parts = sorted((r.bin_offset, r.n_words) for r in rows if r.bin_id == b)
        assert all(x + n <= y for (x, n), (y, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= 100
    assert pack_documents(empty_frame(spark)).count() == 0


def test_copies_never_share_a_bin(spark):
    text = " ".join(words(9, 10))
    docs = spark.createDataFrame([(i, text if i % 3 else f"{i} x", "s") for i in range(60)],
                                 "doc_id bigint, text string, source string")
    rows = pack_documents(docs, per_source=50).where("doc_id % 3 > 0").collect()
    assert len({r.bin_id for r in rows}) == 40


def test_shards_with_equal_pieces_have_bins_of_their_own(spark):
    text = " ".join(words(10, 1500))
    docs = spark.createDataFrame([(1, text, "s")] * 12, "doc_id bigint, text string, source string")
    rows = pack_documents(docs, pieces_per_shard=4).collect()
    assert len({r.bin_id for r in rows}) == 12 and all(r.bin_words == 1500 for r in rows)


def test_one_source_fills_its_bins(spark):
    docs = spark.createDataFrame(
        [(i, " ".join([f"w{i}", *words(i, 9)]), "only") for i in range(5000)],
        "doc_id bigint, text string, source string")
    bins = {r.bin_id: r.bin_words for r in pack_documents(docs).collect()}
    assert sum(bins.values()) == 50_000 and len(bins) == -(-50_000 // 2048)


def test_bins_are_joined_without_conflicts():
    pieces = [(7, "a", n % 4) for n in range(40)] + [(0, "b", 9)]
    placed = join_bins(pieces, pack_shard(pieces, 50, 2), 50)
    held = defaultdict(list)
    for piece, (b, offset) in zip(pieces, placed):
        if piece[0]:
            held[b].append((offset, piece))
    assert len(held) == 10  # four clusters, each once in a bin
    for parts in held.values():
        assert sorted(o for o, _ in parts) == [7 * i for i in range(len(parts))]
        assert len({p[2] for _, p in parts}) == len(parts)

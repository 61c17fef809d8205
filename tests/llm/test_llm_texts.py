"""Text operators against brute force on small and awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from edges import edge_documents, edge_frame, empty_frame, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachline.llm import fingerprints as fp
from reachline.llm import licenses, near_dedup, quality, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + size]) for i in range(max(1, len(found) - size + 1)))


def brute_components(docs, size, least):
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if s and t and i is not None and j is not None \
                    and 100 * len(s & t) >= least * len(s | t):
                parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        same = [sets[b][0] for b in range(len(sets))
                if find(b) == find(a) and sets[b][0] is not None]
        component = None if i is None else min(same)
        out.append((i, len(s), component, i is None or i == component))
    return sorted(out, key=repr)


def mutated(seed, count, each):
    base = words(seed, 90)
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(count):
        own = list(base)
        for at in rng.choice(len(own), each, replace=False):
            own[at] = f"w{seed}x{k}y{at}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("size,least", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, size, least):
    texts = [(r[0], r[1]) for r in edge_documents()]
    texts += [(100 + i, t) for i, t in enumerate(mutated(7, 40, 1) + mutated(8, 40, 2)
                                                 + mutated(9, 30, 4))]
    texts += [(300 + i, " ".join(words(50 + i, n))) for i, n in enumerate([3, 3, 4, 5, 6, 7])]
    texts += [(400 + i, " ".join(words(50 + i, n)) + " z") for i, n in enumerate([3, 3, 4, 9, 9])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(frame, size, (least, 100)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_components(texts, size, least)


def test_large_families_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_TEXTS", 12)
    texts = list(enumerate(mutated(3, 60, 2) + mutated(4, 40, 1)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(frame, 3, (85, 100)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_components(texts, 3, 85)


@pytest.mark.parametrize("length,step", [(90, 20), (400, 130)])
def test_unlike_texts_that_share_bands_do_not_gather_in_families(spark, monkeypatch, length, step):
    """A chain of texts, each like the next one but below the threshold."""
    sizes, found = [], near_dedup.components

    def counted(edges, label):
        out = found(edges, label)
        sizes.append(out.groupBy("component").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(near_dedup, "components", counted)
    chain = [f"c{n}" for n in range(120 * step + length)]
    texts = [(k, " ".join(chain[k * step:k * step + length])) for k in range(120)]
    texts += [(200 + k, t) for k, t in enumerate(mutated(61, 6, 1))]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    result = near_dedup.near_duplicates(frame, 3, (85, 100)).collect()
    assert sorted(map(tuple, result), key=repr) == brute_components(texts, 3, 85)
    assert max(sizes) <= 6


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_a_bucket_span_its_links(seed):
    """All links of small sets, and nothing that sets of unlike size or text have in common."""
    rng, size = np.random.default_rng(seed), near_dedup.WordHashes()
    texts = [t for k in range(6) for t in mutated(10 * seed + k, 9, 1 + k % 3)]
    texts += [" ".join(words(70 + k, 8 + k)) for k in range(20)]
    sets = [near_dedup.shingle_hashes(t, 2, size) for t in texts]
    rows = [(n, int(rng.integers(2)), len(x), near_dedup.registers(x).view(np.int64),
             x.tobytes()) for n, x in enumerate(sets)]
    for across in (False, True):
        pairs = near_dedup._pairs(list(rows), across, 85, 100)
        assert all(sure and 100 * len(np.intersect1d(sets[a], sets[b]))
                   >= 85 * len(np.union1d(sets[a], sets[b])) for a, b, sure in pairs)
        group = list(range(len(texts)))
        for a, b, _ in pairs:
            group = [group[a] if g == group[b] else g for g in group]
        for a, b in ((a, b) for a in range(len(texts)) for b in range(a)):
            if (100 * len(np.intersect1d(sets[a], sets[b]))
                    >= 85 * len(np.union1d(sets[a], sets[b]))
                    and not (across and rows[a][1] == rows[b][1])):
                assert group[a] == group[b]


def test_near_duplicates_keep_columns_and_take_empty_tables(spark):
    docs = edge_frame(spark)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {1, 3, 4, 5, 6, 7, 10} <= set(ids) and 2 not in ids and ids.count(None) == 2
    assert near_dedup.near_duplicates(empty_frame(spark)).count() == 0


def test_texts_of_one_id_are_verified_on_their_own_shingles(spark):
    pairs = [mutated(20 + k, 2, 1) for k in range(8)]
    texts = [(50, own) for own, _ in pairs]  # eight texts of one id, each with a copy elsewhere
    texts += [(100 + k, copy) for k, (_, copy) in enumerate(pairs)]
    texts += [(60, pairs[0][0]), (60, " ".join(words(30, 90)))]  # one text lost, the other alone
    for rows in (texts, texts[::-1]):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = near_dedup.near_duplicates(frame, 3, (85, 100)).collect()
        assert sorted(map(tuple, found), key=repr) == brute_components(rows, 3, 85)
        kept = near_dedup.drop_near_duplicates(frame, 3, (85, 100)).collect()
        assert sorted(map(tuple, kept)) == sorted([*texts[:8], texts[-1]])


@pytest.mark.parametrize("least", [30, 50, 70, 80, 85])
def test_no_link_is_lost_at_lower_thresholds(spark, least):
    """Pairs a little above and below the threshold, each of its own words."""
    docs, linked = [], set()
    for n in range(120):
        base = words(1000 + n, 300)
        kept = int(300 * 2 * (least + (3 if n % 2 else -5)) / (100 + least))
        docs += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base[:kept] + words(
            5000 + n, 300 - kept)))]
        sets = [{tuple(t.split()[i:i + 2]) for i in range(299)} for _, t in docs[-2:]]
        if 100 * len(sets[0] & sets[1]) >= least * len(sets[0] | sets[1]):
            linked.add(n)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(frame, 2, (least, 100)).where("not kept").collect()
    assert {r.doc_id // 2 for r in found} == linked and 40 < len(linked) < 120


def test_bands_follow_from_the_threshold():
    assert [near_dedup.band_rows(t) for t in (0.95, 0.85, 0.8, 0.7, 0.5, 0.3, 0.2)] == [
        4, 4, 4, 2, 2, 1, 1]
    with pytest.raises(ValueError, match="cannot find"):
        near_dedup.band_rows(0.1)


def test_hubs_do_not_meet_in_one_task(spark):
    from reachline.llm.common import components
    edges = [(0, n) for n in range(1, 2000)] + [(5000 + n, 5001 + n) for n in range(60)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "hub").collect()
    assert {r.node: r.component for r in found} == {
        **{n: 0 for n in range(2000)}, **{5000 + n: 5000 for n in range(61)}}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    for shared in (0, 500, 1000):
        one, other = pool[:1000], np.sort(pool[1000 - shared:2000 - shared])
        chance = near_dedup.chance_matches(np.array([1000]), 1000)[0]
        same = (near_dedup.registers(one) == near_dedup.registers(other)).sum()
        estimate = (same - chance) / (near_dedup.REGISTERS - chance)
        assert abs(estimate - shared / (2000 - shared)) < 0.16


def brute_repeats(docs, length):
    out = []
    for i, text in docs:
        data = (text or "").encode()
        known = {(o or "").encode()[p:p + length] for j, o in docs
                 if i is not None and j is not None and j < i
                 for p in range(len((o or "").encode()) - length + 1)}
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p:p + length] in known:
                gone[p:p + length] = b"\1" * length
        flags = np.frombuffer(bytes(gone), np.uint8)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(flags.sum()), int((np.diff(np.r_[0, flags]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _removed(spark, docs, length):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = repeats.repeated_spans(frame, length).drop("spans").collect()
    return sorted(map(tuple, found), key=repr)


def test_repeats_match_brute_force_on_edge_rows(spark):
    docs = [(r[0], r[1]) for r in edge_documents() if len(r[1] or "") < 5000]
    docs += [(30, "ab" * 100), (31, "ba" * 60), (32, "\0" * 80), (33, "x" + "\0" * 60)]
    assert _removed(spark, docs, 50) == brute_repeats(docs, 50)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_match_brute_force_on_cut_and_pasted_texts(spark, seed):
    rng = np.random.default_rng(seed)
    stock = "".join(rng.choice(list("abé "), 900))
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.integers(1, 7)):
            at = int(rng.integers(0, 800))
            parts.append(stock[at:at + int(rng.integers(20, 90))])
            parts.append("".join(rng.choice(list("abcd"), rng.integers(0, 60))))
        docs.append((int(rng.integers(0, 30)), "".join(parts)))
    assert _removed(spark, docs, 50) == brute_repeats(docs, 50)


def test_pieces_of_a_long_text_agree_with_the_whole(monkeypatch):
    data = "".join(np.random.default_rng(0).choice(list("abc "), 5000)).encode()

    def windows(piece):
        monkeypatch.setattr(repeats, "PIECE", piece)
        return {w: (int(a), int(g), int(u)) for run in repeats.anchor_runs(data, 50)
                for a, f, t, g, u in zip(*run) for w in range(f, t + 1)}

    assert windows(1 << 20) == windows(333)


def test_texts_hashed_together_have_the_anchors_they_have_alone():
    texts = [t.encode() for t in (" ".join(words(k, 5 + 9 * k)) for k in range(30))]
    texts[3:3] = [b"", b"a" * 49, b"a" * 50, b"ab" * 90, (" ".join(words(99, 30_000))).encode()]
    for length in (50, 100):
        alone = {(n, *map(int, row)) for n, text in enumerate(texts)
                 for run in repeats._runs(text, length) for row in zip(*run)}
        together = [tuple(map(int, row)) for run in repeats._runs_of(texts, length)
                    for row in zip(*run)]
        assert set(together) == alone and len(together) == len(alone) > 1000


def test_grams_shared_by_chance_leave_no_surroundings(spark, monkeypatch):
    """Strings of 30 bytes that all texts have, none of them within a common one of 50."""
    rng, held = np.random.default_rng(3), {}

    def counted(frame, label, store=repeats.stored):
        out = store(frame, label)
        if label == "contexts":
            held["open"] = out.where("anchor is not null").count()
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = [noise(30) for _ in range(12)]
    docs = [(k, "".join(noise(60) + c for c in common)) for k in range(30)]
    assert _removed(spark, docs, 50) == brute_repeats(docs, 50) and held["open"] == 0
    passage = noise(56)
    docs += [(100 + k, noise(k) + passage + noise(70 - k)) for k in range(9)]
    assert _removed(spark, docs, 50) == brute_repeats(docs, 50)
    assert 0 < held["open"] < 200


def test_repeats_are_cut_at_whole_characters(spark):
    docs = edge_frame(spark)
    cut = repeats.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    rows = {r.doc_id: r for r in cut.collect() if r.doc_id not in (None, 19, 20)}
    assert rows[12].text == "another" + " close"[-6:] or len(rows[12].text) < 30
    assert rows[5].text is None and rows[13].text == "" and rows[13].n_chars == 0
    assert rows[17].text == "" and rows[10].text == edge_documents()[9][1]
    assert repeats.remove_repeats(empty_frame(spark)).count() == 0


def test_gear_hash_has_a_window_of_32_bytes():
    data = np.random.default_rng(0).integers(0, 256, 300, dtype=np.uint8).tobytes()
    for at in (0, 10, 31, 32, 299):
        part = data[max(0, at - 31):at + 1]
        rolled = 0
        for b in part:
            rolled = (rolled * 2 + int(fp._GEAR[b])) % 2**32
        assert fp.gear_hashes(data)[at] == rolled


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=2000))
def test_chunks_join_to_the_text(data):
    parts = fp.chunks(data)
    assert b"".join(parts) == data
    assert all(len(p) <= fp.MOST + fp.LEAST for p in parts)


def test_likeness_resists_shifts():
    text = " ".join(words(1, 800))
    mark = fp.fingerprint(text)
    assert fp.likeness(mark, fp.fingerprint("some words before " + text)) > 0.95
    assert fp.likeness(mark, fp.fingerprint(" ".join(words(2, 800)))) < 0.1
    assert fp.likeness("", "") == 1.0 and fp.likeness(mark, "") == 0.0


@pytest.mark.parametrize("per_block", [3, 1000])
def test_edited_texts_come_from_the_next_document(spark, per_block, monkeypatch):
    whole = fp.neighbours
    monkeypatch.setattr(fp, "neighbours", lambda docs: whole(docs, per_block))
    docs = [(r[0], r[1]) for r in edge_documents()]
    found = fp.compare_with_next(spark.createDataFrame(docs, "doc_id bigint, text string"))
    order = sorted(((i, t or "") for i, t in docs if i is not None), key=lambda r: (-r[0], r[1]))
    pairs = list(zip(order, order[1:] + order[:1]))
    pairs += [((None, t or ""), (None, "")) for i, t in docs if i is None]
    wanted = []
    for (i, text), (_, following) in pairs:
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        mark, marks = fp.fingerprint(text), [fp.fingerprint(t) for t in (edited, following)]
        wanted.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, marks[0],
                       fp.likeness(mark, marks[0]), fp.likeness(mark, marks[1]), edited))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_fingerprints_of_few_rows(spark):
    assert fp.compare_with_next(empty_frame(spark)).count() == 0
    row = fp.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string"))
    assert row.first().edited == "abab"


def brute_licenses(docs, templates):
    grams = lambda ws: [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    out = set()
    for i, text in docs:
        own = grams(licenses.plain_words(text))
        for name, notice in templates:
            wanted = set(grams(licenses.plain_words(notice)))
            reach = 1 << (len(wanted).bit_length() - 1)
            for at in range(0, len(own), 2 * reach):
                if len(set(own[at:at + 4 * reach]) & wanted) >= 0.8 * len(wanted):
                    out.add((i, name))
    return out


def test_licenses_match_brute_force(spark):
    docs = [(r[0], r[1]) for r in edge_documents()]
    for n, (_, notice) in enumerate(licenses.TEMPLATES):
        before = " ".join(words(60 + n, 37 * n + n % 3))
        docs += [(100 + n, f"{before} {notice.upper()} {before}"), (200 + n, notice),
                 (300 + n, f"{before} {notice.rsplit(' ', 2)[0]}"),
                 (400 + n, " ".join(notice.split()[::-1])),
                 (500 + n, notice.replace(" ", "\n * "))]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs],
                                  "doc_id bigint, text string, license string, all string")
    found = licenses.scan_licenses(frame, licenses.template_table(spark)).collect()
    wanted = brute_licenses(docs, licenses.TEMPLATES)
    assert {(r.doc_id, r.license) for r in found} == wanted and len(found) == len(wanted)
    assert {(200 + n, t[0]) for n, t in enumerate(licenses.TEMPLATES)} <= wanted
    table = licenses.template_table(spark)
    assert licenses.scan_licenses(empty_frame(spark), table).count() == 0
    assert licenses.scan_licenses(frame, table.where("false")).count() == 0


def test_notices_of_fewer_words_than_a_shingle_are_found(spark):
    notices = [("one", "Proprietary."), ("two", "Public domain."), ("three", "All rights reserved"),
               ("four", "Do not copy this"), ("five", "Licensed under CC BY 4")]
    docs = [(n, text) for n, (_, text) in enumerate(notices)]
    docs += [(10 + n, f"{' '.join(words(80 + n, 31 + n))} {text.upper()}! {' '.join(words(90, 9))}")
             for n, (_, text) in enumerate(notices)]
    docs += [(20, "reserved rights all"), (21, "all rights are reserved"), (22, "domain public"),
             (23, "all rights"), (24, None), (25, ""), (26, "licensed under cc by"),
             (27, "public domain, all rights\n * reserved")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = licenses.scan_licenses(frame, licenses.template_table(spark, notices)).collect()
    wanted = {(n + more, notices[n][0]) for n in range(5) for more in (0, 10)}
    assert {(r.doc_id, r.license) for r in found} == wanted | {(27, "two"), (27, "three")}
    assert len(found) == 12 and all(r.containment == 1 for r in found)
    table = licenses.template_table(spark)
    assert table.count() == len(licenses.TEMPLATES) + len(licenses.SHORT_TEMPLATES)
    found = licenses.scan_licenses(frame, table).collect()
    assert sorted(r.doc_id for r in found) == [2, 12, 27]
    with pytest.raises(ValueError, match="blank"):
        licenses.template_table(spark, [*notices, ("blank", " . ")])


def test_whole_license_texts_beyond_the_broadcast_bound(spark):
    notices = [(f"n{k}", " ".join(words(200 + k, 1100))) for k in range(20)]
    notices.append(("short", "All rights reserved."))
    docs = [(k, f"{' '.join(words(90, 7 * k))} {notices[k][1]} all rights reserved")
            for k in range(3)]
    docs += [(10, notices[3][1][:3000]), (11, None), (None, notices[4][1]), (12, "x y z")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = licenses.template_table(spark, notices)
    assert table.agg(F.sum(F.size("shingles"))).first()[0] > licenses.MOST_BROADCAST
    found = licenses.scan_licenses(frame, table).collect()
    wanted = {(k, name) for k in range(3) for name in (f"n{k}", "short")} | {(None, "n4")}
    assert {(r.doc_id, r.license) for r in found} == wanted and len(found) == 7


def test_whole_license_texts_are_found_among_long_texts(spark):
    every = licenses.TEMPLATES + licenses.WHOLE_TEXTS
    docs = [(k, f"{' '.join(words(300 + k, 20_000))} {text} {' '.join(words(310, 900))}")
            for k, (_, text) in enumerate(licenses.WHOLE_TEXTS)]
    docs.append((9, licenses.WHOLE_TEXTS[0][1][:400]))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = licenses.scan_licenses(frame, licenses.template_table(spark, every)).collect()
    assert {(r.doc_id, r.license) for r in found} == brute_licenses(docs, every)
    assert {(k, name) for k, (name, _) in enumerate(licenses.WHOLE_TEXTS)} <= {
        (r.doc_id, r.license) for r in found}


def test_quality_is_learned_from_rows_that_are_not_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id < 4000")
    spoiled = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")),
                                                  1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    model = quality.fit_quality(docs, spoiled.select("doc_id", "quality"))
    scored = quality.score_documents(docs, model)
    rows = (scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
            .select("predicted", "quality").collect())
    assert len(rows) > 200
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    edge = quality.score_documents(edge_frame(spark), model)
    assert edge.columns == [*edge_frame(spark).columns, "predicted"]
    assert all(0 <= r.score <= 1 for r in edge.collect())


def test_every_labelled_document_counts_once(spark, monkeypatch):
    """Rows that repeat a labelled id do not crowd out others."""
    seen = []
    real = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda rows, labels, seed=0: (
        seen.append((len(rows), float(labels.mean()))) or real(rows, labels, seed)))
    docs = [(n, " ".join(words(n, 20 + n % 7))) for n in range(60)]
    labels = spark.createDataFrame([(n, int(n % 5 > 0)) for n in range(60)],
                                   "doc_id bigint, quality int")
    for copies in (1, 6):
        frame = spark.createDataFrame(docs * copies, "doc_id bigint, text string")
        quality.fit_quality(frame, labels, most_labelled=40)
    assert seen[0] == seen[1] and seen[0][0] == 40


def test_gradients_and_context_sums(spark):
    """Pooling and context sums against plain loops."""
    texts = ["one two two", None, "", "two three", "x " * 60_000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    terms, index = quality._Terms(), quality.index_vectors()
    wanted = np.zeros((quality.TERMS, quality.WIDTH))
    pairs = lambda w: (terms[w] >> 16, terms[w] & 0xFFFF)
    for text in texts:
        found = (text or "").split()
        for i, word in enumerate(found):
            near = sum((index[t] for j in (i - 1, i + 1) if 0 <= j < len(found)
                        for t in pairs(found[j])), np.zeros(quality.WIDTH))
            for term in pairs(word):
                wanted[term] += near
    wanted -= wanted.sum(0) / max(np.abs(wanted).sum(), 1) * np.abs(wanted).sum(1, keepdims=True)
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-6)
    contexts = quality.context_vectors(frame)
    assert np.allclose(contexts, wanted, atol=1e-4)
    row = quality.pooled("one two two", contexts, index, terms)
    mean = sum(contexts[terms[w] >> 16] for w in ("one", "two", "two")) / 3
    assert np.allclose(row[:quality.WIDTH], mean, atol=1e-5)
    assert np.allclose(row[-4:], [np.log(3) / 10, 1 / 3, 2 / 3, 1])


def test_quality_without_labels_or_documents(spark):
    docs = edge_frame(spark)
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)],
                                   "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels)
    assert quality.score_documents(docs, model).where("score between 0 and 1").count() == 26
    model = quality.fit_quality(empty_frame(spark), labels)
    assert quality.score_documents(empty_frame(spark), model).count() == 0

"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest
from edges import edge_frame, empty_frame
from test_llm_mix_and_pack import filled
from pyspark.sql import functions as F
from test_llm_texts import WORD, brute_components

import corpus_pipeline
from reachline.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark):
    """The rows before the first stage and after each of the stages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], FOLDER), name))
    return {name: (before.collect(), after.collect(), before.columns == after.columns)
            for (name, _), before, after in zip(corpus_pipeline.STAGES, frames, frames[1:])}


def test_quality_keeps_whole_rows(passed):
    before, after, same = passed["quality"]
    assert same and set(after) < set(before)
    assert len(after) > len(before) / 2


def test_one_document_of_each_group_stays(passed):
    before, after, same = passed["near_duplicates"]
    rows = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert same and sorted(r.doc_id for r in after) == sorted(r[0] for r in rows if r[3])
    assert set(after) <= set(before)


def test_repeated_passages_are_cut(passed):
    before, after, same = passed["repeats"]
    length, seen, wanted = corpus_pipeline.REPEATED_BYTES, {}, {}
    for r in sorted(before, key=lambda r: r.doc_id):
        data = r.text.encode()
        starts = [data[p:p + length] for p in range(len(data) - length + 1)]
        gone = bytearray(len(data))
        for p, part in enumerate(starts):
            if seen.get(part, r.doc_id) < r.doc_id:
                gone[p:p + length] = b"\1" * length
        for part in starts:
            seen.setdefault(part, r.doc_id)
        kept, at = [], 0  # a character stays if any of its bytes does
        for character in r.text:
            size = len(character.encode())
            if not all(gone[at:at + size]):
                kept.append(character)
            at += size
        wanted[r.doc_id] = "".join(kept)
    assert same and {r.doc_id: r.text for r in after} == wanted
    assert all(r.n_chars == len(r.text) for r in after)


def test_sources_come_near_their_targets(passed):
    before, after, same = passed["mix"]
    size = lambda r: len(WORD.findall(r.text))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in after:
        taken[r.source] += size(r)
    target = filled(dict(sizes))
    assert same and set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_all_words_are_packed_without_conflicts(passed):
    before, after, _ = passed["pack"]
    words, packed = Counter(), Counter()
    for r in before:
        words[r.doc_id] += len(WORD.findall(r.text))
    for r in after:
        packed[r.doc_id] += r.n_words
        assert r.bin_words <= 2048
    assert words == packed
    parts = Counter((r.bin_id, r.doc_id, r.first_word) for r in after if r.n_words)
    assert max(parts.values()) == 1  # copies of a document never share a bin


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_edge_rows_and_empty_tables(spark, name):
    """Nulls, long and repeated texts, and columns of a user named score, predicted, size ..."""
    stage = dict(corpus_pipeline.STAGES)[name]
    for frame in (edge_frame(spark).withColumn("predicted", F.col("node")),
                  empty_frame(spark)):
        out = stored(stage(spark, frame, FOLDER), name)
        if name != "pack":
            assert out.schema == frame.schema
        if name in ("quality", "near_duplicates"):
            was, now = Counter(map(tuple, frame.collect())), Counter(map(tuple, out.collect()))
            assert not now - was  # rows stay as they are, mine stays mine
        if name == "repeats":
            drop = lambda f: Counter(map(tuple, f.drop("text", "n_chars").collect()))
            assert drop(frame) == drop(out)

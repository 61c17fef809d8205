"""Collocations, conversation repair and decontamination against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from edges import edge_documents, edge_frame, empty_frame, words
from reachline.llm import collocations, conversations, decontaminate


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- phrases

def plain_collocations(docs, least, top):
    total, counts = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            found = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(found)
            for k in range(1, 5):
                counts[lang].update(tuple(found[i:i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()  # occurrences of the most frequent longer phrase around each
        for q, b in chosen.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    around[q[i:i + k]] = max(around[q[i:i + k]], b)
        scored = []
        for p, a in chosen.items():
            if 100 * around[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


def phrase_documents():
    rng = random.Random(11)
    texts = []
    for n in range(60):
        found = rng.choices(["a", "b", "C", "dé", "e", "x y z w", "so. what", "p q", "\x00"], k=60)
        texts.append((rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\t"]).join(found)))
    texts += [("en", None), ("en", ""), ("de", " \t\n "), (None, "one"), ("fr", ".;!"),
              ("en", "p q " * 30000), ("en", "a" * 3_000_000), *[("en", "same text here again")] * 40]
    return texts


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    docs = phrase_documents()
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("n", F.lit("x"))
    found = rows(collocations.collocations(frame, least=5, top=40))
    assert found == plain_collocations(docs, 5, 40)
    assert len(found) > 60


def test_phrases_of_words_with_one_hash_are_told_apart(spark, monkeypatch):
    real = collocations.xxhash.xxh3_64_intdigest

    class Weak:
        @staticmethod
        def xxh3_64_intdigest(data):
            return 7 if data in (b"en\na", b"en\nb") else real(data)

    docs = [("en", "a b a c b c")] * 10
    frame = spark.createDataFrame(docs, "lang string, text string")
    hashed = spark.createDataFrame([("en", "a", 20, 7), ("en", "b", 20, 7), ("en", "c", 20, 8)],
                                   "lang string, word string, a bigint, h bigint")
    monkeypatch.setattr(collocations, "xxhash", Weak)
    ids = collocations.word_ids("en", ["a", "b"], {("en", "b"): 5})
    assert ids.tolist() == [7, 5]
    monkeypatch.undo()
    numbered, exceptions = collocations._numbered(hashed.drop("h"))
    assert not exceptions and numbered.select("w1").distinct().count() == 3
    assert rows(collocations.collocations(frame, 5, 9)) == plain_collocations(docs, 5, 9)


def test_collocations_of_edge_rows(spark):
    docs = [(lang, text) for _, text, lang, *_ in edge_documents()] * 6
    found = rows(collocations.collocations(edge_frame(spark).crossJoin(spark.range(6)), 6, 50))
    assert found == plain_collocations(docs, 6, 50)
    assert collocations.collocations(empty_frame(spark)).count() == 0
    one = spark.createDataFrame([("en", "just a few words")], "lang string, text string")
    assert collocations.collocations(one).count() == 0


def test_large_counts_do_not_overflow(spark):
    grams = spark.createDataFrame([(8 * 10**18, 9 * 10**18, 9 * 10**18)],
                                  "a bigint, x bigint, y bigint")
    got = collocations._scored(grams, [("x", "y")]).first()
    assert got.score == 2000000 * 8 * 10**18 // (18 * 10**18)


# --- repairs

NEXT = {"n": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("n", "s"), ("n", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(judged):
    """Uniform-cost search over whole prefixes: the first goal popped is the least."""
    heap, seen = [(0, "", 0, "n", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if seen.get((i, state), (cost, audit + "~")) <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == len(judged) and state in "na":
            return cost, audit, lines
        name = {"u": "user", "a": "assistant"}[NEXT[state]]
        heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[state], (*lines, name + ":")))
        if i == len(judged):
            continue
        role, text, fault = judged[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if fault in "bd":
            continue
        more = 5 if fault == "t" else 0
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, NEXT[state],
                              (*lines, f"{name}:{text}")))
        if (state, role[:1]) in KEPT:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1],
                                  (*lines, f"{role}:{text}")))


def plain_repairs(table, damage):
    held = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, found in held.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).hexdigest()
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2])))
        seen, judged = set(), []
        for _, role, text in found:
            shown = text.rstrip(" \t\n\v\f\r")
            judged.append((role, text, "b" if not shown else "d" if (role, text) in seen else
                           "t" if shown[-1] not in ".!?" else "-"))
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        cost, audit, lines = cheapest(judged)
        count = Counter(f for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au")
                      for a, b in zip(judged, judged[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    count["b"], count["d"], count["t"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversation_rows(seed=12):
    rng = random.Random(seed)
    table = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 9)):
            table.append((conv, rng.choice([turn, turn, turn, turn + 3, None]),
                          rng.choice(["user", "assistant", "user", "assistant", "system", "tool",
                                      None, ""]),
                          rng.choice(["Yes.", "No!", "Why?", "cut off", "ok. \n", "", None, " \t",
                                      "é.", "x" * 5000 + ".", f"t{rng.random()}."])))
    table += [(70, 0, "user", "Hi.")] * 3 + [(71, None, "assistant", "A.")]
    return table


@pytest.mark.parametrize("damage", [False, True])
def test_repairs_equal_uniform_cost_search(spark, damage):
    table = conversation_rows()
    frame = spark.createDataFrame(table, TURNS).withColumn("block", F.lit("x"))
    hurt = conversations.damaged(frame) if damage else frame
    found = rows(conversations.judge_repairs(hurt, frame))
    assert found == plain_repairs(table, damage)


def test_a_conversation_in_many_parts(spark, monkeypatch):
    """Parts of three rows, ranges that cut conversations, and one with most of the rows."""
    monkeypatch.setattr(conversations, "PART_ROWS", 3)
    rng = random.Random(13)
    table = conversation_rows(14)
    table += [(99, t, rng.choice(["user", "assistant", "system"]),
               rng.choice(["Yes.", "cut", f"t{t}.", f"t{t}."])) for t in range(300)]
    table += [(98, 1, "user", "Same.")] * 200
    frame = spark.createDataFrame(table, TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(conversations.judge_repairs(frame))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == plain_repairs(table, False)


def test_no_conversations(spark):
    frame = spark.createDataFrame([], TURNS)
    assert conversations.judge_repairs(frame).count() == 0
    only = spark.createDataFrame([(1, 2, "user", "Hi.")], TURNS)
    empty = rows(conversations.judge_repairs(only.where("false"), only))
    assert empty == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns_in_order(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"),
                                   (1, 2, "assistant", "Yes."), (1, 3, "user", "cut")], TURNS)
    turns = conversations.Repairs(frame).turns().orderBy("block", "part", "place").collect()
    assert [(t.role, t.text) for t in turns] == [("user", "Hello?"), ("assistant", "Yes.")]


# --- benchmark passages

def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_contamination(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        found = plain_words(text)
        for i in range(max(len(found) - size, 0) + 1 if found else 0):
            windows[tuple(found[i:i + size])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        found, hit, ids = plain_words(text), set(), set()
        for m in lengths:
            for i in range(len(found) - m + 1):
                if tuple(found[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    ids |= windows[tuple(found[i:i + m])]
        out.append((doc, len(found), len(hit), len(ids),
                    hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_tables():
    rng = random.Random(15)
    pool = words(16, 400)
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 9, 10, 11, 40])))) for i in range(30)]
    items += [(30, items[0][1]), (5, "second text of item five " * 3), (31, None), (32, "!!"),
              (None, " ".join(pool[:12])), (33, "again " * 25), (34, "one")]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 80)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, max(len(part) - 1, 0))
            text += rng.choice([", ", " ", ".\n"]) + " - ".join(part[at:]).upper()
        docs.append((i, text))
    docs += [(i, t) for i, t, *_ in edge_documents()]
    docs += [(81, "again " * 50_000), (82, items[4][1] * 3), (82, "other"), (82, "other")]
    return docs, items


@pytest.mark.parametrize("shard, block", [(64, 1 << 24), (1 << 20, 200)])
def test_contamination_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate.contaminations, "__defaults__", (10, block, True))
    docs, items = leak_tables()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn(
        "items", F.lit(1))
    tests = spark.createDataFrame(items, "item_id bigint, text string").withColumn(
        "doc_id", F.lit(1))
    wanted = plain_contamination(docs, items, 10)
    assert rows(decontaminate.judge_contamination(frame, tests)) == wanted
    clean = decontaminate.remove_contaminated(frame, tests)
    assert clean.columns == frame.columns
    assert clean.count() == sum(not w[-1] for w in wanted)


def test_longest_matches_and_their_places(spark):
    item = " ".join(words(17, 30))
    doc = "before it " + " ".join(item.split()[4:25]) + " and after " + item
    found = decontaminate.contaminations(
        spark.createDataFrame([(1, doc)], "doc_id bigint, text string"),
        spark.createDataFrame([(9, item)], "item_id bigint, text string")).first()
    assert sorted(map(tuple, found.matches)) == [("9", 0, 25, 30), ("9", 4, 2, 21)]
    assert [list(s) for s in found.spans] == [[2, 22], [25, 54]]


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    tests = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.judge_contamination(empty_frame(spark), tests).count() == 0
    judged = decontaminate.judge_contamination(edge_frame(spark), none)
    assert judged.count() == len(edge_documents()) and not judged.where("contaminated").count()

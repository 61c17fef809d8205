"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score string, node string, size string, component_id string, rank int")


def words(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9))) for _ in range(count)]


def edge_documents() -> list[tuple]:
    base = words(1, 120)
    near = list(base)
    near[60] = "changed"
    passage = " ".join(words(2, 60))
    texts = [
        (1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base).upper(), "b"),
        (4, "", "b"), (5, None, None), (6, "  \n\t ", "b"), (7, "one", "a"), (8, "one two", "a"),
        (9, "one", "c"), (10, " ".join(words(3, 9000)), "a"),
        (11, "start here " + passage + " the end", "c"),
        (12, "another " + passage + " close", None), (13, passage, "c"),
        (14, "again " * 300, "c"), (None, " ".join(base), "a"), (None, None, None),
        (15, "x" * 49, "b"), (16, "x" * 50, "b"), (17, "x" * 51, "b"),
        (18, "é" * 30 + passage[:200] + "é", "b"),
        (19, " ".join(words(4, 40)), "a"), (19, " ".join(words(5, 40)), "a"),
        (20, " ".join(words(6, 40)), "a"), (20, " ".join(words(6, 40)), "a"),
        (2**60 + 1, " ".join(words(7, 60)), "a"), (2**60 + 2, " ".join(words(7, 60)), "a"),
    ]
    return [(i, t, "en", s, len(t or ""), "x", "y", "z", "w", 1) for i, t, s in texts]


def edge_frame(spark):
    return spark.createDataFrame(edge_documents(), SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)

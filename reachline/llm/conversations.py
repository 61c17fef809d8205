"""Repair of conversation structure: the cheapest edits, by branch and bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.llm.common import stored

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, UNSOUND = 0, 1, 2, 5, 5
"""Costs of the edits; ``UNSOUND`` is added for a truncated row that stays."""

PART_ROWS = 64
"""Rows that one search covers; longer conversations are searched in parts."""

KEPT_SEARCHES = 50_000  # searches whose result a task remembers

NOTHING, SYSTEM, USER, ASSISTANT, END = range(5)
"""What the repaired turns end with; ``END`` as a goal is a whole conversation: nothing or an
assistant's turn, if need be after inserts."""

_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER,
         (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _least_ahead(codes: str) -> list[list[int]]:
    """Per row and state what the rows from there on cost at least, whatever the goal."""
    ahead = [[0] * 4]
    for at in range(len(codes) - 2, -1, -2):
        initial, fault = codes[at], codes[at + 1]
        later, more = ahead[-1], UNSOUND if fault == "t" else 0
        now = []
        for state in range(4):
            least = DELETE + later[state]
            if fault != "x":
                least = min(least, REROLE + more + later[_NEXT[state]])
                kept = _KEPT.get((state, initial))
                if kept is not None:
                    least = min(least, KEEP + more + later[kept])
            now.append(least)
        for _ in range(2):
            now = [min(now[state], INSERT + now[_NEXT[state]]) for state in range(4)]
        ahead.append(now)
    return ahead[::-1]


def search(codes: str, entry: int, goal: int) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of some rows, the ASCII-least of equals.

    A row is two characters of ``codes``: the initial of its role, ``o`` for others, and its
    fault, ``x`` (must go), ``t`` (truncated) or ``-``. Depth-first branch and bound: a stack
    of open prefixes, lower bounds for the rows ahead, the best complete solution (cost,
    audit), and per row and state the best prefix, which eliminates worse ones. It ends when no
    open prefix can be better. Inserts stand before a row, after the last one only
    if the goal is ``END``. None if the goal cannot be reached.
    """
    rows = len(codes) // 2
    ahead = _least_ahead(codes)
    best: tuple[int, str] | None = None
    dominating: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None and (cost + ahead[i][state], audit) > (best[0], best[1][:len(audit)]):
            continue
        known = dominating.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        dominating[i, state] = (cost, audit)
        if i == rows and (state == goal or goal == END and state in (NOTHING, ASSISTANT)):
            if best is None or (cost, audit) < best:
                best = (cost, audit)
            continue
        branches = []
        if i < rows or goal == END:
            branches.append((i, _NEXT[state], cost + INSERT, audit + "I"))
        if i < rows:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            branches.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault != "x":
                more = UNSOUND if fault == "t" else 0
                kept = _KEPT.get((state, initial))
                if kept != _NEXT[state]:
                    branches.append((i + 1, _NEXT[state], cost + REROLE + more, audit + "R"))
                if kept is not None:
                    branches.append((i + 1, kept, cost + KEEP + more, audit + "K"))
        # The last one is tried first: the lowest bound, of equals the ASCII-least.
        branches.sort(key=lambda b: (b[2] + ahead[b[0]][b[1]], b[3]), reverse=True)
        stack += branches
    return best


class _Searches(dict):
    """Results of ``search`` by its arguments, as conversations look alike."""

    def __missing__(self, key: tuple[str, int, int]) -> tuple[int, str] | None:
        if len(self) > KEPT_SEARCHES:
            self.clear()
        self[key] = search(*key)
        return self[key]


PART = ("conv string, block int, part int, closed boolean, codes string, copies array<bigint>, "
        "numbered array<boolean>, turns array<bigint>, digests array<string>, "
        "blank bigint, duplicate bigint, truncated bigint, cost bigint, audit string, "
        "costs array<bigint>, ranks array<int>, audits array<string>")
_PART = [c.split()[0] for c in PART.split(", ")]
GOALS = [(entry, goal) for entry in range(4) for goal in range(5)]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``PART`` from sorted rows of one block.

    A conversation of at most ``PART_ROWS`` rows that neither begins nor ends the block is
    closed: solved at once. Of all other parts the best edits from each state to each state.
    """
    searches, out = _Searches(), []

    def rows():
        """(conversation, initial, fault, first of its copies?, key), copies one by one."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (row.numbered, row.turn, row.digest)
                for copy in range(row.n):
                    fault = ("b" if row.fault == "b" else "d" if copy or not row.first
                             else row.fault)
                    yield row.conv, row.block, row.initial + fault, key, copy

    def part(conv, block, number, held, closed):
        codes = "".join(code[0] + ("x" if code[1] in "bd" else code[1])
                        for code, _, _ in held)
        keys, copies = [], []
        for _, key, copy in held:
            if keys and copy:
                copies[-1] += 1
            else:
                keys.append(key), copies.append(1)
        counts = [sum(code[1] == f for code, _, _ in held) for f in "bdt"]
        row = [conv, block, number, closed, "".join(code for code, _, _ in held), copies,
               [bool(k[0]) for k in keys], [int(k[1]) for k in keys], [k[2] for k in keys],
               *counts]
        if closed:
            return (*row, *searches[codes, NOTHING, END], None, None, None)
        found = [searches[codes, entry, goal] for entry, goal in GOALS]
        order = {a: i for i, a in enumerate(sorted({f[1] for f in found if f}))}
        return (*row, None, None, [f[0] if f else -1 for f in found],
                [order[f[1]] if f else -1 for f in found], [f[1] if f else "" for f in found])

    first = True
    waiting = None  # a short conversation that may turn out to be the last of the block
    for (conv, block), group in groupby(rows(), key=lambda r: r[:2]):
        if waiting:
            out.append(part(*waiting, True))
            waiting = None
        held, number, whole = [], 0, not first
        first = False
        for row in group:
            if len(held) == PART_ROWS:
                out.append(part(conv, block, number, held, False))
                held, number, whole = [], number + 1, False
            held.append(row[2:])
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=_PART)
                out = []
        if whole:
            waiting = (conv, block, number, held)
        else:
            out.append(part(conv, block, number, held, False))
    if waiting:
        out.append(part(*waiting, False))
    yield pd.DataFrame(out, columns=_PART)


CHOICE = "conv string, block int, part int, entry int, place int, cost bigint"


def _choices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which edits of each open part the best whole repair takes; ``cost`` stands at the last.

    Parts arrive in order. Per state the best edits so far are known by cost and by their
    order among those of the other states. No audit of a part begins with another one of it,
    as each ends with the edit of its last row, so concatenations compare by ranks.
    """
    def rows():
        for batch in batches:
            yield from batch.itertuples(index=False)

    out: list[tuple] = []
    for conv, group in groupby(rows(), key=lambda r: r.conv):
        labels = {NOTHING: (0, 0)}
        came: list[tuple[int, int, bytes]] = []  # block, part, and per state where from

        def options(row, goal):
            return [((cost + int(row.costs[entry * 5 + goal]), rank,
                      int(row.ranks[entry * 5 + goal])), entry)
                    for entry, (cost, rank) in labels.items() if row.ranks[entry * 5 + goal] >= 0]

        last = None
        for row in group:
            if last is not None:
                reached = {goal: min(found) for goal in range(4) if (found := options(last, goal))}
                order = {key: i for i, key in enumerate(sorted({
                    label[1:] for label, _ in reached.values()}))}
                labels = {goal: (label[0], order[label[1:]])
                          for goal, (label, _) in reached.items()}
                came.append((last.block, last.part, bytes(
                    reached[goal][1] if goal in reached else 9 for goal in range(4))))
            last = row
        (cost, _, _), entry = min(options(last, END))
        out.append((conv, last.block, last.part, entry, entry * 5 + END, cost))
        for block, number, origins in reversed(came):
            goal, entry = entry, origins[entry]
            out.append((conv, block, number, entry, entry * 5 + goal, None))
        if len(out) > 10_000:
            yield _choice_frame(out)
            out = []
    yield _choice_frame(out)


def _choice_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CHOICE.split(", ")])
    return frame.astype({"cost": "Int64"})


LINE = ("conv string, block int, part int, place int, edit string, role string, "
        "numbered boolean, turn bigint, digest string")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns of the repaired conversations: inserted and reroled ones with their role,
    kept and reroled ones with the key of their row."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            state, at = row.entry, 0
            keys = [k for k, n in enumerate(row.copies) for _ in range(int(n))]
            for place, edit in enumerate(row.audit):
                head = (row.conv, row.block, row.part, place, edit)
                if edit != "I":
                    key, initial = keys[at], row.codes[2 * at]
                    at += 1
                if edit == "D":
                    continue
                state = _KEPT[state, initial] if edit == "K" else _NEXT[state]
                out.append((*head, None if edit == "K" else _ROLES[state], *(
                    (False, 0, None) if edit == "I" else
                    (bool(row.numbered[key]), int(row.turns[key]), row.digests[key]))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINE.split(", ")])


def _conv(conv_id: Column) -> Column:
    """A conversation id as text, also where it is null."""
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _spaced(conversations: DataFrame) -> DataFrame:
    """Rows with their conversation as text; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    turn = F.col("turn").cast("bigint")
    return conversations.select(
        _conv(F.col("conv_id")).alias("conv"), turn.isNotNull().alias("numbered"),
        F.coalesce(turn, F.lit(0).cast("bigint")).alias("turn"), role.alias("role"),
        text.alias("text"), F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text),
                                   256).alias("digest"))


class Repairs:
    """The cheapest repair of every conversation of a table (conv_id, turn, role, text).

    A repaired conversation is empty, or has an optional system turn and then user and assistant
    in turn, by the initials of the roles. Keeping a row costs nothing, giving it the role user
    or assistant 1, deleting it 2, inserting an empty turn 5; a truncated row that stays costs 5
    more. Blank rows, and rows whose role and text an earlier one of the conversation has, must
    go. Of the cheapest repairs the one with the ASCII-least audit (initials of the edits in
    order) is taken.

    Rows go by turn, null turns first, then by role and by the SHA-256 of role and text. Null
    roles and texts count as one space, rows without conv_id as one conversation. A role that
    is empty or has another initial can only be given a new role or be deleted. Equal rows are
    counted before they are moved. An empty table has no conversations; other columns are not
    read, and texts only once the edits are known.

    Method. Thin rows (faults, initials, digests) are sorted into ranges, so a conversation of
    any length lies in several tasks. Each part of at most ``PART_ROWS`` rows is searched (see
    ``search``); of conversations that fill several parts or touch the ends of a range, the
    best edits from each state to each state are found, and one pass over those small tables
    picks the best whole.
    """

    def __init__(self, conversations: DataFrame) -> None:
        self.rows = _spaced(conversations)
        blank = ~F.rlike("text", F.lit(f"[^{SPACE}]"))
        sound = F.rlike("text", F.lit(rf"[.!?][{SPACE}]*\z"))
        fault = F.when(blank, "b").when(~sound, "t").otherwise("-")
        initial = F.substring("role", 1, 1)
        order = ["conv", "numbered", "turn", "role", "digest"]
        thin = (self.rows.withColumns({
            "fault": fault,
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
            "letter": initial}).groupBy(*order, "fault", "initial", "letter")
            .agg(F.count("*").alias("n")))
        self.thin = stored(thin, "turns")
        firsts = (self.thin.groupBy("conv", "digest")
                  .agg(F.min(F.struct("numbered", "turn")).alias("least")))
        marked = self.thin.join(firsts, ["conv", "digest"]).withColumn(
            "first", F.struct("numbered", "turn") == F.col("least"))
        sorted_ = (marked.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("block", F.spark_partition_id()))
        self.parts = stored(sorted_.select(
            "conv", "block", "numbered", "turn", "digest", "initial", "fault", "first", "n")
            .mapInPandas(_parts, PART), "parts")
        still = self.parts.where("not closed")
        choices = stored(still.select("conv", "block", "part", "costs", "ranks")
                         .repartition("conv").sortWithinPartitions("conv", "block", "part")
                         .mapInPandas(_choices, CHOICE), "choices")
        place = ["conv", "block", "part"]
        chosen = still.drop("cost", "audit").join(choices, place).withColumn(
            "audit", F.get("audits", F.col("place")))
        shown = [*place, "entry", "audit", "cost", "codes", "copies", "numbered", "turns",
                 "digests", "blank", "duplicate", "truncated"]
        self.edited = chosen.select(*shown).unionByName(
            self.parts.where("closed").withColumn("entry", F.lit(NOTHING)).select(*shown))

    def turns(self) -> DataFrame:
        """(conv, block, part, place, edit, role, text): the repaired turns; the first four
        columns are their order."""
        lines = self.edited.select("conv", "block", "part", "entry", "audit", "codes", "copies",
                                   "numbered", "turns", "digests").mapInPandas(_lines, LINE)
        lines = stored(lines, "lines")
        key = ["conv", "numbered", "turn", "digest"]
        texts = self.rows.groupBy(*key).agg(F.min("role").alias("old_role"),
                                            F.min("text").alias("text"))
        columns = ["conv", "block", "part", "place", "edit", "role", "text"]
        written = (lines.where("edit <> 'I'").join(texts, key)
                   .withColumn("role", F.coalesce("role", "old_role")))
        return written.select(*columns).unionByName(
            lines.where("edit = 'I'").withColumn("text", F.lit("")).select(*columns))

    def summaries(self) -> DataFrame:
        """(conv, blank, duplicate, truncated, cost, audit) of conversations with rows."""
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("block", "part", "audit"))), lambda p: p.audit), "")
        return self.edited.groupBy("conv").agg(
            *[F.sum(c).cast("bigint").alias(c)
              for c in ("blank", "duplicate", "truncated", "cost")], audit.alias("audit"))


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): numbers between the first and the last turn that no row has."""
    turns = rows.select("conv", F.when(F.col("numbered"), F.col("turn")).alias("turn")).distinct()
    return turns.groupBy("conv").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))


def illegal_neighbours(thin: DataFrame) -> DataFrame:
    """(conv, illegal): rows that may not follow the row before them, by the initials of their
    roles. Equal rows follow each other, and no role may follow itself.

    Sorted ranges again: each task counts within its range and tells its ends, and the ends
    are joined in order, one row for each range and conversation.
    """
    order = ["conv", "numbered", "turn", "role", "digest"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["conv"], batch["block"], batch["letter"], batch["n"])

        out = []
        for (conv, block), group in groupby(rows(), key=lambda r: r[:2]):
            illegal, first, last = 0, None, None
            for _, _, letter, n in group:
                if last is None:
                    first = letter
                else:
                    illegal += last + letter not in ("su", "ua", "au")
                illegal += n - 1
                last = letter
            out.append((conv, block, first, last, illegal))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["conv", "block", "first", "last", "illegal"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "block", "first", "last", "illegal"])

    ranges = (thin.select(*order, "letter", "n").repartitionByRange(*order)
              .sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
              .select("conv", "block", "letter", "n")
              .mapInPandas(count, "conv string, block int, first string, last string, "
                                  "illegal bigint"))
    ends = F.array_sort(F.collect_list(F.struct("block", "first", "last")))
    across = F.size(F.filter(
        F.zip_with("ends", F.slice("ends", 2, F.size("ends")), lambda a, b: F.concat(
            a.last, b.first)), lambda pair: ~pair.isin("su", "ua", "au")))
    return ranges.groupBy("conv").agg(F.sum("illegal").alias("illegal"), ends.alias("ends")).select(
        "conv", (F.col("illegal") + across).alias("illegal"))


def transcript_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines; the lines stream through their task."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["conv"], batch["role"], batch["text"])

        out = []
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            sha = hashlib.sha256()
            for n, (_, role, text) in enumerate(group):
                sha.update((("\n" if n else "") + role + ":" + text).encode("utf-8"))
            out.append((conv, sha.hexdigest()))
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])

    return (turns.repartition("conv").sortWithinPartitions("conv", "block", "part", "place")
            .select("conv", "role", "text")
            .mapInPandas(digest, "conv string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) % 20; nulls are one space, also there."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"),
                                shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(
            "text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def judge_repairs(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A row for every conv_id of ``ids`` (default: of ``conversations``); one without rows has
    zeros, an empty audit and the hash of an empty text. See ``Repairs`` for the rules.
    """
    ids = (conversations if ids is None else ids).select("conv_id").distinct().withColumn(
        "conv", _conv(F.col("conv_id")))
    repairs = Repairs(conversations)
    out = ids
    for part in (turn_gaps(repairs.thin), repairs.summaries(), illegal_neighbours(repairs.thin),
                 transcript_digests(repairs.turns())):
        out = out.join(part, "conv", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in
                     ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
        .alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    return judge_repairs(damaged(rows), rows)


def _more(label: str, cost: str, edit: str) -> str:
    """A label is its cost in twelve digits and its audit, so the least label is the best."""
    return (f"lpad(CAST(CAST({label}[:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') "
            f"|| {label}[13:] || '{edit}'")


def _walk_sql() -> str:
    """One row after the labels of the four states (n, s, u, a), as a fold."""
    given = {state: f"z.{state}" for state in "nsua"}
    inserted = dict(given)
    inserted["u"] = "least({})".format(", ".join(
        [given["u"], *[_more(given[x], str(INSERT), "I") for x in "nsa"]]))
    stay = "CASE WHEN x.f = 't' THEN 5 ELSE 0 END"
    gone = "x.f IN ('b', 'd')"

    def kept(state: str, initial: str) -> str:
        return (f"CASE WHEN NOT {gone} AND x.c = '{initial}' "
                f"THEN {_more('y.' + state, stay, 'K')} END")

    def reroled(state: str) -> str:
        return f"CASE WHEN NOT {gone} THEN {_more('y.' + state, '1 + ' + stay, 'R')} END"

    deleted = {state: _more("y." + state, str(DELETE), "D") for state in "nsua"}
    new = {"n": deleted["n"], "s": f"least({deleted['s']}, {kept('n', 's')})",
           "u": "least({})".format(", ".join([deleted["u"], *[f(x) for x in "nsa" for f in (
               lambda x: kept(x, "u"), reroled)]])),
           "a": f"least({deleted['a']}, {kept('u', 'a')}, {reroled('u')})"}
    two = f"{{'n': z.n, 's': z.s, 'u': z.u, 'a': least(z.a, {_more('z.u', str(INSERT), 'I')})}}"
    one = "{{'n': z.n, 's': z.s, 'u': {}, 'a': z.a}}".format(inserted["u"])
    step = "{" + ", ".join(f"'{k}': {v}" for k, v in new.items()) + "}"
    return (f"list_transform(list_transform(list_transform([z], lambda z: {one}), "
            f"lambda z: {two}), lambda y: {step})[1]")


_CRC_SQL = """list_reduce(list_transform(string_split(id, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda v, n: CASE WHEN v & 1 = 1
        THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT))"""
_LETTERS = "CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END"
_MISSING = "CAST(NULL AS VARCHAR)"
ORACLE_SQL = rf"""
  WITH given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id
    FROM conversations),
  kinds AS (SELECT *, xor({_CRC_SQL}, 4294967295) % 20 AS kind FROM given),
  rows_after AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
        AS text
    FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(n)),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM rows_after),
  judged AS (
    SELECT *, {_LETTERS} AS c, lag(left(role, 1)) OVER w AS earlier,
      CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 't' ELSE '-' END AS f
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
  folded AS (
    SELECT conv_id, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts,
      list(c ORDER BY i) AS letters,
      coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
      count(*) FILTER (f = 't') AS truncated,
      count(*) FILTER (earlier || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
      list_reduce(list({{'f': f, 'c': c, 'n': {_MISSING}, 's': {_MISSING}, 'u': {_MISSING},
                         'a': {_MISSING}}} ORDER BY i),
        lambda z, x: {{'f': x.f, 'c': x.c, 'n': STEP.n, 's': STEP.s, 'u': STEP.u, 'a': STEP.a}},
        {{'f': '', 'c': '', 'n': '000000000000', 's': {_MISSING}, 'u': {_MISSING},
          'a': {_MISSING}}}) AS z
    FROM judged GROUP BY conv_id),
  finished AS (
    SELECT *, least(z.n, z.a, {_more('z.u', '5', 'I')}, {_more('z.s', '10', 'II')},
                    {_more('z.n', '10', 'II')}) AS label FROM folded),
  walked AS (
    SELECT *, label[13:] AS audit, list_reduce(
      list_transform(string_split(label[13:], ''), lambda e: {{
        'e': e, 'i': 0, 'c': 'n', 'lines': CAST([] AS VARCHAR[])}}),
      lambda w, x: {{'e': x.e,
        'i': CASE WHEN x.e IN ('K', 'R', 'D') THEN w.i + 1 ELSE w.i END,
        'c': CASE x.e WHEN 'K' THEN letters[w.i + 1] WHEN 'R' THEN NEXT WHEN 'I' THEN NEXT
             ELSE w.c END,
        'lines': CASE x.e
          WHEN 'K' THEN list_append(w.lines, roles[w.i + 1] || ':' || texts[w.i + 1])
          WHEN 'R' THEN list_append(w.lines, ROLE || ':' || texts[w.i + 1])
          WHEN 'I' THEN list_append(w.lines, ROLE || ':') ELSE w.lines END}},
      {{'e': '', 'i': 0, 'c': 'n', 'lines': CAST([] AS VARCHAR[])}}).lines AS lines
    FROM finished)
  SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(CAST(label[:12] AS BIGINT), 0) AS cost,
    coalesce(audit, '') AS audit,
    sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN walked w ON w.conv_id IS NOT DISTINCT FROM o.conv_id""".replace(
    "NEXT", "CASE WHEN w.c = 'u' THEN 'a' ELSE 'u' END").replace(
    "ROLE", "CASE WHEN w.c = 'u' THEN 'assistant' ELSE 'user' END")
for _state in "nsua":
    ORACLE_SQL = ORACLE_SQL.replace(f"STEP.{_state}", f"({_walk_sql()}).{_state}")

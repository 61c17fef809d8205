import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from reachline.operators.completion import completion_moments, with_completion
from reachline.operators.conversions import conversion_orders, rollup_with_conversions
from reachline.operators.customers import customer_rollup
from reachline.operators.receipts import (KEYS, fold_receipts, stage_event_counts,
                                          upsert_communications)
from reachline.sources import tables
from reachline.sources.receipts import parse_receipts, stream_bodies
from reachline.sources.schemas import COMMUNICATIONS
from reachline.streaming import changes, customers, pending, receipts as streams

START = datetime(2000, 1, 1)
CAMPAIGN = "id string, status string, total_sent bigint"


def bodies(rng, n):
    kinds = ["sent", "delivered", "failed", "opened", "read", "clicked", "converted"]
    rows = []
    for seq in range(n):
        kind = rng.choice(kinds)
        rows.append({"seq": seq, "body": json.dumps({
            "campaign_id": f"c{rng.choice([0, 0, 0, 1, 2])}",
            "customer_id": f"p{rng.randint(0, 40)}", "event_type": kind,
            "timestamp": (START + timedelta(seconds=rng.randint(0, 10 ** 6))).isoformat(),
            "metadata": {"order_value": rng.randint(0, 3)} if kind == "converted" else {}})})
    return rows


def write_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def read_all(spark, folder):
    return parse_receipts(spark.read.schema("seq bigint, body string").json(str(folder)))


def follow(spark, folder, root, campaigns):
    """One run over the files not yet seen, one file per micro-batch."""
    receipts = parse_receipts(stream_bodies(spark, str(folder), max_files=1))
    streams.follow_messages(receipts, str(root), campaigns).awaitTermination()


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_stream_with_restart_and_repeats_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    sent = bodies(rng, 300)
    shuffled = sent[:]
    rng.shuffle(shuffled)  # files carry receipts out of arrival order
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    campaigns = spark.createDataFrame(
        [("c0", "sending", 41), ("c1", "sending", 41), ("c2", "running", 1)], CAMPAIGN)
    queued = spark.createDataFrame(
        [("c0", f"p{i}") for i in range(41)], "campaign_id string, customer_id string"
    ).select("*", F.lit("queued").alias("status"),
             F.lit(None).cast("timestamp_ntz").alias("sent_at"),
             F.lit(START).cast("timestamp_ntz").alias("updated_at"))
    streams.seed_messages(queued, str(root))

    for part in range(2):
        write_file(inbox, f"a{part}.json", shuffled[part * 100:part * 100 + 100])
    follow(spark, inbox, root, campaigns)
    write_file(inbox, "b0.json", shuffled[200:])
    write_file(inbox, "b1.json", shuffled[50:150])  # delivered twice
    follow(spark, inbox, root, campaigns)           # restarts from its checkpoint

    everything = parse_receipts(spark.createDataFrame(
        [(r["seq"], r["body"]) for r in sent], "seq bigint, body string"))
    folded = fold_receipts(everything)
    untouched = queued.join(folded, KEYS, "left_anti")
    wanted = folded.select(streams.STATUS_COLUMNS).unionByName(untouched)
    found = streams.message_statuses(spark, str(root)).select(streams.STATUS_COLUMNS)
    assert rows(found) == rows(wanted)

    live = streams.live_campaigns(spark, str(root))
    moments = completion_moments(campaigns, queued, everything)
    counters = ["campaign_id", "total_sent", "messages", "queued"]
    assert rows(live.select(counters)) == rows(moments.select(counters))
    batches = [p.name for p in (root / "messages").glob("batch=*")]
    assert len(batches) == 5  # the seed and four files


def test_conversion_stream_is_idempotent(spark, tmp_path):
    rng = random.Random(2)
    sent = bodies(rng, 200)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    people = spark.createDataFrame([(f"p{i}", "Pune") for i in range(30)],
                                   "id string, city string")
    write_file(inbox, "a.json", sent[:120])
    write_file(inbox, "b.json", sent[60:])
    write_file(inbox, "c.json", sent[:10])
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams.follow_conversions(receipts, people, str(root)).awaitTermination()
    found = changes.current(spark, f"{root}/orders", ["id"]).drop("items")
    wanted = conversion_orders(parse_receipts(spark.createDataFrame(
        [(r["seq"], r["body"]) for r in sent], "seq bigint, body string")), people)
    assert rows(found) == rows(wanted.select(found.columns))
    assert found.count() > 10


def test_stage_counter_stream(spark, tmp_path):
    sent = bodies(random.Random(3), 90)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    for part in range(3):
        write_file(inbox, f"{part}.json", sent[part * 30:part * 30 + 30])
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams.follow_stages(receipts, str(root)).awaitTermination()
    found = changes.current(spark, f"{root}/stages", ["event_type"])
    assert rows(found) == rows(stage_event_counts(read_all(spark, inbox)))


def test_a_batch_that_runs_again_leaves_the_same_rows(spark, tmp_path):
    root = str(tmp_path / "log")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    later = spark.createDataFrame([("b", 2)], "k string, v int")
    changes.write_batch(first, root, 0)
    changes.write_batch(later, root, 1)
    changes.write_batch(later, root, 1)
    assert rows(changes.current(spark, root, ["k"])) == [("a", 1), ("b", 2)]
    assert changes.all_rows(spark, root).count() == 3


def test_repeats_within_a_horizon_are_dropped(spark, tmp_path):
    sent = bodies(random.Random(4), 80)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    write_file(inbox, "a.json", sent)
    write_file(inbox, "b.json", sent)
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams_in = streams.drop_repeats_within(receipts, "30 days")
    changes.keep_changes(streams_in, f"{root}/rows", f"{root}/_progress",
                         mode="append").awaitTermination()
    kept = changes.all_rows(spark, f"{root}/rows")
    kinds = {(json.loads(r["body"])["campaign_id"], json.loads(r["body"])["customer_id"],
              json.loads(r["body"])["event_type"]) for r in sent}
    assert kept.count() == len(kinds)
    assert kept.where(F.col("order_value") > Decimal(0)).count() >= 0


def test_whole_messages_equal_batch_and_survive_a_rerun(spark, tmp_path):
    sent = bodies(random.Random(5), 240)
    random.Random(6).shuffle(sent)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    queued = spark.createDataFrame(
        [("m1", "c0", "p1", "a@x", "sms", "queued", [], None, START),
         ("m2", "c0", "idle", "b@x", "sms", "queued", [], None, START)], COMMUNICATIONS)
    streams.seed_communications(queued, str(root))
    for part in range(3):
        write_file(inbox, f"{part}.json", sent[part * 80:part * 80 + 80])
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams.follow_communications(receipts, str(root)).awaitTermination()

    text = F.to_json("events").alias("events")
    kept = [c for c in streams.MESSAGE_COLUMNS if c != "events"]
    found = streams.communications(spark, str(root)).select(*kept, text)
    everything = parse_receipts(spark.createDataFrame(
        [(r["seq"], r["body"]) for r in sent], "seq bigint, body string"))
    wanted = rows(upsert_communications(queued, everything).select(*kept, text))
    assert rows(found) == wanted

    # the last batch again: it must start from what the batches before it left
    last = max(int(p.name.split("=")[1]) for p in (root / "communications").glob("batch=*"))
    (root / "_progress" / "commits" / str(last)).unlink()
    for leftover in (root / "_progress" / "commits").glob(f".{last}.crc"):
        leftover.unlink()
    streams.follow_communications(receipts, str(root)).awaitTermination()
    found = streams.communications(spark, str(root)).select(*kept, text)
    assert rows(found) == wanted


def test_ids_keep_their_text(spark, tmp_path):
    """Ids that look like numbers stay apart, whatever the first batch holds."""
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    names = ["12", "007", "7", "c1"]
    for n, name in enumerate(names):
        write_file(inbox, f"{n}.json", [{"seq": n, "body": json.dumps({
            "campaign_id": name, "customer_id": "p", "event_type": "sent",
            "timestamp": START.isoformat(), "metadata": {}})}])
    campaigns = spark.createDataFrame([(n, "sending", 1) for n in names], CAMPAIGN)
    follow(spark, inbox, root, campaigns)
    live = streams.live_campaigns(spark, str(root)).collect()
    assert sorted((r.campaign_id, r.messages) for r in live) == sorted((n, 1) for n in names)
    assert sorted(r.campaign_id for r in streams.message_statuses(spark, str(root)).collect()) \
        == sorted(names)


def test_merged_state_gives_the_same_counts_and_bounds_what_is_read(spark, tmp_path):
    rng = random.Random(6)
    sent = bodies(rng, 160)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    for n in range(8):
        write_file(inbox, f"{n}.json", sent[n * 20:(n + 1) * 20])
    campaigns = spark.createDataFrame(
        [("c0", "sending", 41), ("c1", "sending", 41), ("c2", "running", 1)], CAMPAIGN)
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams.follow_messages(receipts, str(root), campaigns, merge_every=3).awaitTermination()
    everything = read_all(spark, inbox)
    none = spark.createDataFrame([], "campaign_id string, customer_id string, status string")
    live = streams.live_campaigns(spark, str(root))
    assert rows(live) == rows(completion_moments(campaigns, none, everything)
                              .select(live.columns))
    kept = ["campaign_id", "customer_id", "status"]
    assert rows(streams.message_statuses(spark, str(root)).select(kept)) == rows(
        fold_receipts(everything).select(kept))
    for name in ("messages", "counts", "campaigns"):
        numbers = {int(p.name.split("=")[1]) for p in (root / name).glob("batch=*")}
        assert numbers == set(range(3, 8))  # what the merge after batch 2 holds is gone
        merged = {int(p.name.split("=")[1]) for p in (root / f"{name}-merged").glob("batch=*")}
        assert merged == {2, 5}


def test_calls_and_files_do_not_grow_with_the_batches(spark, tmp_path, monkeypatch):
    """State is read with as many file system calls in batch 200 as in batch 20."""
    root = str(tmp_path / "log")
    like = spark.createDataFrame([], "k string, v int")
    probes = []
    real = tables._folders

    def counted(*args):
        files, found = real(*args)
        probes.append(len(found))
        return files, found

    monkeypatch.setattr(tables, "_folders", counted)
    calls, files = {}, {}
    for batch in range(201):
        probes.clear()
        state = changes.state_before(spark, root, batch, like)
        calls[batch] = (len(probes), sum(probes))
        if batch in (20, 200):
            files[batch] = len(state.inputFiles())
        changes.write_batch(spark.createDataFrame([("a", batch), (f"k{batch % 7}", batch)],
                                                  like.schema).coalesce(1), root, batch)
        if changes.merges(batch, 4):
            changes.merge(spark, root, batch, ["k"], like)
    assert calls[200] == calls[20] and max(n for _, n in calls.values()) <= 6
    assert files[200] == files[20]
    assert rows(changes.current(spark, root, ["k"])) == sorted(
        [("a", 200)] + [(f"k{i}", max(b for b in range(201) if b % 7 == i)) for i in range(7)])


def test_reading_state_leaves_the_schema_it_is_given(spark, tmp_path):
    """Also where all batches read are empty and no file tells the columns."""
    root = str(tmp_path / "log")
    like = spark.createDataFrame([], "k string, v int")
    for batch in range(2):
        changes.write_batch(like, root, batch, ["v"])
        state = changes.state_before(spark, root, batch + 1, like)
        assert state.columns == ["k", "v", "batch"] and state.count() == 0
        assert like.schema.names == ["k", "v"]


def test_status_before_outlasts_the_completion(spark):
    counts = spark.createDataFrame([("c", 2, 0)], "campaign_id string, messages int, queued int")
    heads = spark.createDataFrame(
        [("c", "completed", "sending", 1, START)], "id string, status string, "
        "status_before string, total_sent bigint, completed_at timestamp_ntz")
    none = spark.createDataFrame([], "campaign_id string, completed_at timestamp_ntz")
    found = with_completion(heads, counts, none).first()
    assert (found.status_before, found.status, found.completed_at) == (
        "sending", "completed", START)


def replay(campaigns, queued, receipts):
    """The rule, receipt by receipt."""
    rank = {"sent": 1, "delivered": 2, "failed": 2, "opened": 3, "read": 4, "clicked": 5,
            "converted": 6}
    status = {key: "queued" for key in queued}
    done, seen = {}, set()
    for campaign, customer, kind, ts in receipts:
        key = (campaign, customer)
        status.setdefault(key, "queued")
        if (key, kind) in seen:
            continue
        seen.add((key, kind))
        if status[key] != "failed" and rank.get(kind, 0) > rank.get(status[key], 0):
            status[key] = kind
        own = [s for (c, _), s in status.items() if c == campaign]
        total = campaigns.get(campaign, 0)
        if campaign not in done and total and "queued" not in own and len(own) == total:
            done[campaign] = ts
    return done


def test_completion_moments_equal_a_replay_and_last_in_the_stream(spark, tmp_path):
    rng = random.Random(8)
    names = [f"c{i}" for i in range(12)]
    total = {name: rng.randint(1, 6) for name in names}
    queued = [(n, f"p{i}") for n in names for i in range(rng.choice([total[n], total[n], 3]))]
    sent = []
    for seq in range(400):
        name = rng.choice(names)
        sent.append((seq, name, f"p{rng.randint(0, total[name] + (seq > 250))}",
                     rng.choice(["sent", "delivered", "opened", "noise"]),
                     START + timedelta(seconds=rng.randint(0, 10 ** 6))))
    wanted = replay(total, queued, [r[1:] for r in sent])
    assert 3 < len(wanted) < 12
    campaigns = spark.createDataFrame([(n, "sending", total[n]) for n in names], CAMPAIGN)
    messages = spark.createDataFrame(queued, "campaign_id string, customer_id string").select(
        "*", F.lit("queued").alias("status"), F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        F.lit(START).cast("timestamp_ntz").alias("updated_at"))
    receipts = spark.createDataFrame(sent, "seq bigint, campaign_id string, customer_id string, "
                                           "event_type string, ts timestamp_ntz")
    found = completion_moments(campaigns, messages, receipts).collect()
    assert {r.campaign_id: r.completed_at for r in found if r.completed_at} == wanted
    assert {r.campaign_id for r in found if r.status == "completed"} == set(wanted)
    late = [r for r in found if r.status == "completed" and r.messages != r.total_sent]
    assert late  # strangers came after the end

    inbox, root = tmp_path / "inbox", tmp_path / "out"
    for n in range(5):
        write_file(inbox, f"{n}.json", [
            {"seq": seq, "body": json.dumps({
                "campaign_id": c, "customer_id": p, "event_type": kind,
                "timestamp": ts.isoformat(), "metadata": {}})}
            for seq, c, p, kind, ts in sent[n * 80:n * 80 + 80]])
    streams.seed_messages(messages, str(root))
    stream = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    streams.follow_messages(stream, str(root), campaigns, merge_every=2).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (root / "messages").glob("batch=*"))
    for leftover in (str(last), f".{last}.crc"):  # the last batch again
        path = root / "_progress" / "commits" / leftover
        if path.exists():
            path.unlink()
    streams.follow_messages(stream, str(root), campaigns, merge_every=2).awaitTermination()
    live = streams.live_campaigns(spark, str(root))
    assert rows(live) == sorted(tuple(r[c] for c in live.columns) for r in found
                                if r.campaign_id in {s[1] for s in sent})


def test_completed_campaigns_keep_their_time(spark):
    campaigns = spark.createDataFrame(
        [("c", "completed", 1, START), ("d", "sending", 1, None)],
        "id string, status string, total_sent bigint, completed_at timestamp_ntz")
    none = spark.createDataFrame([], "campaign_id string, customer_id string, status string")
    receipts = spark.createDataFrame(
        [(1, k, "p", "sent", START + timedelta(days=1)) for k in "cd"],
        "seq bigint, campaign_id string, customer_id string, event_type string, "
        "ts timestamp_ntz")
    found = {r.campaign_id: (r.status, r.completed_at)
             for r in completion_moments(campaigns, none, receipts).collect()}
    assert found == {"c": ("completed", START), "d": ("completed", START + timedelta(days=1))}
    nobody = completion_moments(campaigns, none, receipts.where("false")).collect()
    assert {r.campaign_id: r.status for r in nobody} == {"c": "completed", "d": "sending"}


def test_customer_counters_equal_batch_with_a_batch_run_twice(spark, tmp_path):
    rng = random.Random(9)
    sent = bodies(rng, 300)
    inbox, root = tmp_path / "inbox", tmp_path / "out"
    people = spark.createDataFrame([(f"p{i}", "Pune") for i in range(30)],
                                   "id string, city string")
    orders = spark.createDataFrame(
        [(f"p{i % 20}", Decimal(i), "completed", START + timedelta(days=i)) for i in range(50)],
        "customer_id string, amount decimal(18,2), status string, created_at timestamp_ntz")
    write_file(inbox, "a.json", sent[:100])
    write_file(inbox, "b.json", sent[100:200])
    write_file(inbox, "c.json", sent[50:150])  # repeated receipts
    write_file(inbox, "d.json", sent[200:])
    receipts = parse_receipts(stream_bodies(spark, str(inbox), max_files=1))
    customers.seed_customers(customer_rollup(people, orders), str(root))

    def run():
        customers.follow_customers(receipts, people, str(root), merge_every=2).awaitTermination()

    run()
    made = conversion_orders(parse_receipts(spark.createDataFrame(
        [(r["seq"], r["body"]) for r in sent], "seq bigint, body string")), people)
    wanted = rows(rollup_with_conversions(people, orders, made).select(
        "id", "total_orders", "total_spent", "last_order_date"))
    found = customers.customer_counters(spark, str(root)).select(*customers.COUNTERS)
    assert rows(found) == wanted
    last = max(int(p.name.split("=")[1]) for p in (root / "customers").glob("batch=*"))
    for leftover in (str(last), f".{last}.crc"):
        path = root / "_progress" / "commits" / leftover
        if path.exists():
            path.unlink()
    run()
    found = customers.customer_counters(spark, str(root)).select(*customers.COUNTERS)
    assert rows(found) == wanted


def test_children_find_parents_that_come_first_or_later(spark, tmp_path):
    rng = random.Random(10)
    children = [(n, f"p{rng.randint(0, 12)}" if n % 9 else None) for n in range(90)]
    parents = [(f"p{i}", i) for i in range(10)]
    for order in range(2):
        box = tmp_path / str(order)
        child_rows, parent_rows = children[:], parents[:] + parents[:3]
        rng.shuffle(child_rows)
        rng.shuffle(parent_rows)
        for n in range(3):
            for name, table, schema in (("c", child_rows, "n bigint, parent string"),
                                        ("p", parent_rows, "key string, v bigint")):
                part = table[n::3] if order else table[n::3] if name == "c" or n else []
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(
                    str(box / name))
        read = lambda name, schema: (spark.readStream.schema(schema)
                                     .option("maxFilesPerTrigger", 1).parquet(str(box / name)))
        for query in pending.follow_children(read("c", "n bigint, parent string"),
                                             read("p", "key string, v bigint"), "parent", "key",
                                             str(box / "out")):
            query.awaitTermination()
        known = dict(parents if order else [p for n in (1, 2) for p in parent_rows[n::3]])
        wanted = sorted((n, p, p, known[p]) for n, p in children if p in known)
        assert rows(pending.found_children(spark, str(box / "out"))) == wanted
        waiting = pending.waiting_children(spark, str(box / "out")).first()
        assert tuple(waiting) == (90, len(wanted), 90 - len(wanted))

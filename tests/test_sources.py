from datetime import datetime

import pytest

from reachline.session import new_work_path, shared_folder
from reachline.sources import retail, tables
from reachline.sources.schemas import TABLES


@pytest.mark.parametrize("name", list(TABLES))
def test_tables_round_trip(spark, tmp_path, name):
    empty = spark.createDataFrame([], TABLES[name])
    empty.write.parquet(str(tmp_path / name))
    assert tables.read_table(spark, name, str(tmp_path / name)).schema == empty.schema


def test_json_tables_use_the_declared_schema(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        '{"id":"1","customer_id":"a","amount":12.5,"items":[{"name":"n","quantity":2,'
        '"price":6.25}],"created_at":"2001-01-01T00:00:00","extra":1}')
    row = tables.read_table(spark, "orders", str(tmp_path), fmt="json").first()
    assert float(row.amount) == 12.5 and row["items"][0].quantity == 2
    assert row.created_at == datetime(2001, 1, 1)


def test_only_written_campaigns_are_replaced(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = lambda *r: spark.createDataFrame(list(r), "campaign_id string, message string")
    tables.write_outbound(rows(("a", "1"), ("b", "1")), path)
    tables.write_outbound(rows(("b", "2")), path)
    tables.write_outbound(rows(("b", "2")), path)
    found = sorted((r.campaign_id, r.message) for r in spark.read.parquet(path).collect())
    assert found == [("a", "1"), ("b", "2")]


def test_readers_take_the_newest_version(spark, tmp_path):
    root = str(tmp_path / "customers")
    tables.write_version(spark.range(3), root, 1)
    tables.write_version(tables.read_latest(spark, root).where("id > 0"), root, 2)
    assert sorted(r.id for r in tables.read_latest(spark, root).collect()) == [1, 2]


def test_unfinished_versions_are_not_read(spark, tmp_path):
    root = tmp_path / "customers"
    tables.write_version(spark.range(3), str(root), 9)
    tables.write_version(spark.range(5), str(root), 10)
    (root / "version=10" / "_SUCCESS").unlink()
    assert tables.read_latest(spark, str(root)).count() == 3
    with pytest.raises(ValueError):
        (root / "version=9" / "_SUCCESS").unlink()
        tables.read_latest(spark, str(root))


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_work_path(spark, "x") != new_work_path(spark, "x")
    assert new_work_path(spark, "x").startswith(shared_folder(spark))


def test_event_stream_takes_every_event_in_many_files(spark, tmp_path):
    ids = [None if i % 50 == 0 else i for i in range(600)]
    events = spark.createDataFrame([(i,) for i in ids], "event_id bigint")
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("event_id").limit(1)
    events.crossJoin(source).repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    stream = retail.event_stream(spark, str(tmp_path), f"{tmp_path}/stream")
    query = (stream.writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/out"))
    query.awaitTermination()
    found = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found, key=str) == sorted(ids, key=str)
    assert 3 <= sum(p["numInputRows"] > 0 for p in query.recentProgress) <= 5
    files = spark.read.parquet(f"{tmp_path}/stream").inputFiles()
    assert len(files) > 4  # no part comes from a single task


def test_a_micro_batch_of_events_is_one_part(spark, tmp_path):
    """Whatever number of files the events and the late strangers come in."""
    seen = {}
    stream = retail.event_stream(spark, "/root/testdata/sf0.001", f"{tmp_path}/stream",
                                 late_strangers=True)
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check")
     .foreachBatch(lambda rows, n: seen.update({n: [r.event_id for r in rows.collect()]}))
     .start().awaitTermination())
    last = max(max(ids) for ids in seen.values())
    parts = [{i * 3 // (last + 1) for i in seen[n]} for n in sorted(seen)]
    assert parts == [{0}, {1}, {2}]
    assert len({i for ids in seen.values() for i in ids}) == last + 1


def test_events_of_very_few_rows_come_in_order(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("event_id").limit(1)
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, None)], "event_id bigint")
    ids.crossJoin(source).write.parquet(f"{tmp_path}/events.parquet")
    seen = {}
    stream = retail.event_stream(spark, str(tmp_path), f"{tmp_path}/stream")
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check")
     .foreachBatch(lambda rows, n: seen.update({n: [r.event_id for r in rows.collect()]}))
     .start().awaitTermination())
    assert [seen[n] for n in sorted(seen)] == [[0], [1], [2], [None]]

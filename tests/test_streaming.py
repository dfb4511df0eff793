import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.plans import catalog
from quern.sources.tables import table
from quern.streaming import events
from tests.compare import SMALL


def test_stream_equals_batch(spark, tmp_path):
    source = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).parquet(f"{SMALL}/events*.parquet")
    kept = source.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.drain(spark, kept, str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() == table(spark, SMALL, "events").where("event_type = 'error'").count()
    assert events.drain(spark, kept, str(tmp_path / "out"), str(tmp_path / "state")).count() == out.count()


def test_windows_are_read_from_a_table_of_the_shared_folder(spark):
    """Not from the driver's memory."""
    files = catalog.stream_events_windowed(spark, SMALL).inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)


def test_counts_add_up_over_batches(spark, tmp_path):
    """Events that come days late, and a restart without new ones."""
    rows = table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_id") % 2 == 0
    for part in (rows.where(~late), rows.where(late), rows.limit(0)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = events.drain_counts(spark, source, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, events.rate_counts(rows).drop("limited").collect()))


def closed(rows, idle, cap, until):
    """Runs (key, start, last, n) of rows (key, second) by plain loops; those whose end the watermark has passed."""
    out, now = [], {}
    for key, t in sorted(rows):
        run = now.get(key)
        end = run and min(run[0] + cap, run[1] + idle if idle else run[0] + cap)
        if run and t < end:
            run[1], run[2] = t, run[2] + 1
        else:
            now[key] = [t, t, 1]
            out.append((key, now[key]))
    ends = lambda r: min(r[0] + cap, r[1] + idle if idle else r[0] + cap)
    return sorted((k, *r) for k, r in out if ends(r) <= until)


@pytest.mark.parametrize("idle, cap", [(None, 900), (7200, 30_000)])
def test_runs_of_a_stream_equal_loops(spark, tmp_path, idle, cap):
    """Events in four parts, out of order within the delay, some without a user or time; each part is a start from the checkpoint."""
    rng = random.Random(idle or 1)
    rows = sorted((rng.randrange(40_000), rng.randrange(3)) for _ in range(300))
    parts = [[(u, t) for t, u in rows if low <= t + rng.randrange(-250, 250) < high] for low, high in ((-999, 12_000), (12_000, 20_000), (20_000, 33_000), (33_000, 99_999))]
    kept = [x for p in parts for x in p]
    schema = "user_id long, ts timestamp"
    for part in parts:
        values = [(u, datetime.fromtimestamp(t, timezone.utc)) for u, t in part] + [(None, None)]
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = events.stream_runs(spark, source, str(tmp_path / "out"), str(tmp_path / "state"), idle, cap)
    until = max(t for _, t in kept) - 600
    assert sorted(map(tuple, out.collect())) == closed(kept, idle, cap, until)


def test_failed_batches_are_taken_again(spark, tmp_path):
    """A batch that fails before its table is written is repeated on the next start, and those before aren't."""
    schema = "doc_id long, text string"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folders = str(tmp_path / "table"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame([(k, f"text {k} " * 200)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bad = source().withColumn("text", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        events.ingest(bad, *folders)
    got = events.ingest(source(), *folders)
    want = chunking.chunk_table(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    key = lambda rows: sorted((r.doc_id, r.ord, r.sha) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_arrivals(spark, tmp_path):
    files = {"a.txt": b"words", "b.pdf": b"%PDF", "c.DOCX": b"PK", "d.mp4": b"v" * 50, "e.md": b"\xff\xfe", "f.txt": b" \n", "g.txt": b"x" * 101, "h": "grüße".encode()}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = events.arrivals(spark, str(tmp_path / "in"), most=100)
    got = {r.name: r for r in events.drain(spark, found, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    assert {n: (r.kind, r.status) for n, r in got.items()} == {
        "a.txt": ("text", "parsed"), "b.pdf": ("pdf", "pending"), "c.DOCX": ("office", "pending"), "d.mp4": ("video", "pending"), "e.md": ("text", "not_utf8"), "f.txt": ("text", "empty"), "g.txt": ("text", "too_large"), "h": ("text", "parsed")}
    assert got["h"].text == "grüße" and got["b.pdf"].text is None and got["a.txt"].bytes == 5
    (tmp_path / "in" / "new.txt").write_bytes(b"later")
    assert events.drain(spark, events.arrivals(spark, str(tmp_path / "in"), most=100), str(tmp_path / "out"), str(tmp_path / "state")).count() == 9

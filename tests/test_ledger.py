import pytest
from pyspark.sql import functions as F

from readlog.sources import store
from readlog.sources.ledger import AlreadyCommitted, Ledger, latest, overlaid

EVENT = "id string, series_id string, chapter_label string, source_url string, source_domain string, read_at timestamp"


def events(spark, *rows):
    frame = spark.createDataFrame([(i, "s", label, "u", "d", at) for i, label, at in rows], EVENT.replace("timestamp", "string"))
    return frame.withColumn("read_at", F.to_timestamp("read_at"))


def test_one_id_on_two_days_is_one_event(spark, tmp_path):
    folder = str(tmp_path)
    store.append_events(events(spark, ("e1", "first", "2024-01-01"), ("e1", "later", "2024-01-02"), (None, "x", "2024-01-01")), folder)
    store.append_events(events(spark, ("e1", "again", "2024-01-02"), ("e2", "new", "2024-01-02"), ("e3", "no time", None)), folder)
    store.append_events(events(spark, ("e3", "no time", "2024-01-05"), ("e2", "new", None)), folder)
    got = {r.id: r.chapter_label for r in store.read_log(spark, folder).collect()}
    assert got == {"e1": "first", "e2": "new", "e3": "no time"} and store.read_log(spark, folder).count() == 3


def test_append_reads_the_index_and_not_the_log(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(3):
        store.append_events(events(spark, *[(f"e{i}", "x", f"2024-01-{i + 1:02d}") for i in range(n, n + 5)]), folder)
    new = store.unknown_ids(store.conform(events(spark, ("e1", "x", "2024-02-01"), ("e9", "x", "2024-02-01")), store.schemas.EVENTS), folder)
    plan = new._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan and "read_date" not in plan
    assert not any(f.endswith("parquet") and "/ids/" not in f for f in new.inputFiles())
    assert [r.id for r in new.collect()] == ["e9"]
    assert store.read_log(spark, folder).count() == 7


def test_segments_fold_and_stay_few(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), fan=2)
    merges = {"rows": lambda df: latest(df, "k")}
    counts = []
    for n in range(9):
        ledger.commit(n, {"rows": spark.createDataFrame([("same", n), (f"k{n}", n)], "k string, v long")})
        while ledger.fold(merges):
            pass
        counts.append(len(ledger.segments()))
        assert {r.k: r.v for r in latest(ledger.read("rows"), "k").collect()} == {"same": n} | {f"k{i}": i for i in range(n + 1)}
    assert counts == [1, 1, 2, 1, 2, 2, 3, 1, 2]
    assert ledger.read("rows").filter("k = 'same'").count() == 2  # folded rows are one
    assert len([p for p in tmp_path.iterdir() if p.name != "_done"]) <= 4  # replaced folders go


def test_a_number_is_committed_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1)], "k string, v long")
    assert ledger.read("rows") is None and ledger.next_batch() == 0 and not ledger.has(0)
    ledger.commit(0, {"rows": rows})
    with pytest.raises(AlreadyCommitted):
        ledger.commit(0, {"rows": rows})
    assert ledger.has(0) and ledger.next_batch() == 1 and ledger.read("rows").count() == 1
    base = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long")
    assert sorted(map(tuple, overlaid(base, ledger.read("rows"), "k").collect())) == [("a", 1), ("b", 0)]
    assert overlaid(base, None, "k") is base

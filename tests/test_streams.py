"""Stateful streams over small files, one micro-batch per file."""

import datetime as dt

from pyspark.sql import functions as F

from shelfspark.streaming.changes import freshness_sessions, freshness_stream, ordered_price_changes, price_changes_stream


def _source(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def _run(stream, name, tmp_path):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None


def _at(hour, day=1):
    return dt.datetime(2026, 1, day, hour)


def test_price_changes(spark, tmp_path):
    schema = "offer_id STRING, price DECIMAL(14,2), seen_at TIMESTAMP"
    from decimal import Decimal as D
    batches = [[("a", D("10.00"), _at(3)), ("a", D("9.00"), _at(1)), ("b", D("5.00"), _at(1))],
               [("a", D("10.00"), _at(4)), ("a", D("8.00"), _at(2)), ("b", D("6.00"), _at(2))]]
    _run(price_changes_stream(_source(spark, str(tmp_path / "in"), batches, schema)), "changes", tmp_path)
    got = sorted((r.offer_id, r.price, r.seen_at) for r in spark.table("changes").collect())
    assert got == [("a", "10.00", _at(3)), ("a", "9.00", _at(1)), ("b", "5.00", _at(1)), ("b", "6.00", _at(2))]


def test_freshness_goes_stale_and_returns(spark, tmp_path):
    schema = "offer_id STRING, seen_at TIMESTAMP"
    batches = [[("a", _at(0)), ("b", _at(0))], [("b", _at(0, 3))], [("a", _at(0, 5))], [("a", _at(1, 5))]]
    _run(freshness_stream(_source(spark, str(tmp_path / "in"), batches, schema), raw_hours=24, watermark="0 seconds"), "fresh", tmp_path)
    rows = spark.table("fresh").orderBy("offer_id", "at", F.col("state")).collect()
    got = [(r.offer_id, r.state, r.at) for r in rows]
    assert got[:3] == [("a", "FRESH", _at(0)), ("a", "STALE", _at(0, 2)), ("a", "FRESH", _at(0, 5))]
    assert ("b", "STALE", _at(0, 2)) in got and ("b", "STALE", _at(0, 4)) in got


def test_ordered_price_changes(spark, tmp_path):
    """Late rows inside the watermark are put in order, across micro-batches, and a hot offer goes chunk by chunk."""
    from decimal import Decimal as D
    schema = "offer_id STRING, price DECIMAL(14,2), seen_at TIMESTAMP"
    hot = [("hot", D(i % 7 // 2), _at(0) + dt.timedelta(seconds=i)) for i in range(3000)]
    batches = [[("a", D("10.00"), _at(3)), ("a", D("9.00"), _at(1)), ("b", D("5.00"), _at(1)), *hot[::2]],
               [("a", D("8.00"), _at(2)), ("a", D("8.00"), _at(2)), ("b", D("5.00"), _at(4)), ("a", None, _at(2)), *hot[1::2]],
               [("z", D("1.00"), _at(0, 9))]]
    _run(ordered_price_changes(_source(spark, str(tmp_path / "in"), batches, schema), "6 hours"), "ordered", tmp_path)
    got = sorted((r.offer_id, r.seen_at, r.price) for r in spark.table("ordered").collect() if r.offer_id != "z")
    want, last = [], {}
    for key, price, seen in sorted({r for b in batches for r in b if r[1] is not None and r[0] != "z"}, key=lambda r: (r[0], r[2], r[1])):
        if last.get(key) != price:
            want.append((key, seen, str(price.quantize(D("0.01")))))
        last[key] = price
    assert got == want


def test_common_offers_wait_in_one_value():
    """The rows of a common offer take a handful of state accesses, whatever their number; few and many give the same."""
    import pandas as pd

    from shelfspark.streaming import changes

    class Held:
        def __init__(self):
            self.values, self.timers, self.calls = {}, set(), 0

        def touch(self):
            self.calls += 1

        def registerTimer(self, ms):
            self.touch()
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.touch()
            self.timers.discard(ms)

        def getValueState(self, name, _schema):
            return Cell(self, name)

        getMapState = lambda self, name, _k, _v: Cell(self, name)

    class Cell:
        def __init__(self, held, name):
            self.held, self.name = held, name

        def _key(self, key=None):
            self.held.touch()
            return self.name, key

        def exists(self): return self._key() in self.held.values
        def get(self): return self.held.values.get(self._key())
        def update(self, value): self.held.values[self._key()] = value
        def clear(self): self.held.values.pop(self._key(), None)
        def containsKey(self, key): return self._key(key) in self.held.values
        def getValue(self, key): return self.held.values[self._key(key)]
        def updateValue(self, key, value): self.held.values[self._key(key)] = value
        def removeKey(self, key): self.held.values.pop(self._key(key), None)

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms
        def getExpiryTimeInMs(self): return self.ms

    def run(few):
        held, offer, out = Held(), changes._OrderedChanges(), []
        kept, changes._FEW = changes._FEW, few
        try:
            offer.init(held)
            for part in (range(0, 400, 2), range(1, 400, 2)):
                us = [i * 60_000_000 for i in part]
                list(offer.handleInputRows(("a",), iter([pd.DataFrame({"us": us, "ms": [u // 1000 for u in us], "price": [str(i // 3) for i in part]})]), Now(0)))
            for passed in (6_000_000, 60_000_000):
                while held.timers and min(held.timers) <= passed:
                    due = min(held.timers)
                    held.timers.discard(due)
                    out += [tuple(r) for frame in offer.handleExpiredTimer(("a",), Now(passed), Now(due)) for r in frame.itertuples(index=False)]
        finally:
            changes._FEW = kept
        return out, held.calls

    common, calls = run(512)
    many, many_calls = run(10)
    assert common == many and len(common) == 134 and calls < 40 < many_calls


def test_freshness_sessions(spark, tmp_path):
    schema = "offer_id STRING, seen_at TIMESTAMP"
    batches = [[("a", _at(0, 2)), ("b", _at(0))], [("a", _at(0)), ("b", _at(0, 3))], [("a", _at(0, 1)), ("c", _at(0, 20))], [("c", _at(0, 21))]]
    _run(freshness_sessions(_source(spark, str(tmp_path / "in"), batches, schema), raw_hours=24, watermark="10 days"), "spans", tmp_path)
    got = sorted(tuple(r) for r in spark.table("spans").collect())
    # Exactly one window apart is still fresh; the last span is open.
    assert got == [("a", _at(0), _at(0, 3), 3), ("b", _at(0), _at(0, 2), 1), ("b", _at(0, 3), _at(0, 4), 1)]


def test_redelivered_observations_vanish(spark, tmp_path):
    import json
    import os

    from shelfspark.plans.importing import Importer
    from shelfspark.streaming.ingest import ingest_stream
    from test_import import LINES

    stores = spark.createDataFrame([("s1", "maximum"), ("s2", "darwin")], "store_id STRING, slug STRING")
    (tmp_path / "in").mkdir()
    parts = [LINES[:2] + LINES[:1], LINES[1:], LINES]
    importer = Importer(spark, str(tmp_path / "db"), stores)

    def deliver(numbers, stop=False):
        for i in numbers:
            name = tmp_path / "in" / f"{i}.json"
            name.write_text("\n".join(map(json.dumps, parts[i])) + "\n{broken\n")
            os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
        query = ingest_stream(spark, str(tmp_path / "in"), importer, str(tmp_path / "ck"), files_per_batch=1, available_now=True)
        if stop:
            query.stop()
        query.awaitTermination(300)
        assert query.exception() is None

    deliver([0])
    deliver([1], stop=True)  # killed anywhere, then started again
    deliver([2])
    counts = {r.batch_id: (r.imported, r.failed) for r in importer.log.rows().select("batch_id", "imported", "failed").distinct().collect()}
    assert sum(i for i, _ in counts.values()) == 3 and sum(f for _, f in counts.values()) == 3
    assert importer.read("offers").count() == 2 and importer.read("history").count() == 3


def test_offers_wait_in_groups(spark, tmp_path):
    """Many offers share a key: few and many rows of a group give the same, each offer in its own order, whatever its id."""
    from decimal import Decimal as D

    from shelfspark.streaming import changes

    names = [None, "", "None", "two words", "a\nb", "a\\nb", "back\\", *(f"o{i}" for i in range(20))]
    rows = [(n, D(i * 7 % 5 + 1), _at(0) + dt.timedelta(seconds=(i * 37 + j) % 60)) for i in range(60) for j, n in enumerate(names)]
    schema = "offer_id STRING, price DECIMAL(14,2), seen_at TIMESTAMP"
    want, last = [], {}
    for key, price, seen in sorted(set(rows), key=lambda r: (repr(r[0]), r[2], r[1])):
        if last.get(key) != price:
            want.append((repr(key), seen, str(price.quantize(D("0.01")))))
        last[key] = price
    for few in (None, 3):
        source = _source(spark, str(tmp_path / f"in{few}"), [rows[::2], rows[1::2], [("z", D(1), _at(0, 9))]], schema)
        (tmp_path / f"t{few}").mkdir()
        _run(changes.ordered_price_changes(source, "6 hours", few=few), f"grouped{few}", tmp_path / f"t{few}")
        got = sorted(((repr(r.offer_id), r.seen_at, r.price) for r in spark.table(f"grouped{few}").collect() if r.offer_id != "z"))
        assert got == sorted(want)


def test_a_group_of_offers_takes_few_state_accesses():
    import pandas as pd

    from shelfspark.streaming import changes

    values, calls, timers = {}, [], []

    class State:
        def __init__(self, name): self.name = name
        def __getattr__(self, call):
            def access(key=None, value=None):
                calls.append(call)
                if call in ("update", "updateValue"):
                    values[self.name, None if call == "update" else key] = key if call == "update" else value
                return {"exists": (self.name, None) in values, "containsKey": (self.name, key) in values}.get(call, values.get((self.name, key)))
            return access

    class Handle:
        getValueState = staticmethod(lambda name, _: State(name))
        getMapState = staticmethod(lambda name, _k, _v: State(name))
        registerTimer = staticmethod(timers.append)

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 10_000)

    group = changes._OrderedChanges()
    group.init(Handle())
    frame = pd.DataFrame({"offer_id": [f"o{i % 500}" for i in range(5000)], "us": [i * 1000 for i in range(5000)], "price": [str(i) for i in range(5000)]})
    list(group.handleInputRows((1,), iter([frame]), Now()))
    out = pd.concat(group.handleExpiredTimer((1,), Now(), None))
    assert len(out) == 5000 and timers == [0] and len(calls) < 80

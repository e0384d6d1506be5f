"""Keyed stream state: price changes and freshness transitions.

Both need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

import datetime as dt
import re
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.functions.clock import max_age_hours

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LAST_PRICE = T.StructType([T.StructField("price", T.StringType()), T.StructField("seen_at", T.TimestampType()),
                            T.StructField("late", T.LongType())])
CHANGES = T.StructType([
    T.StructField("offer_id", T.StringType()), T.StructField("price", T.StringType()), T.StructField("seen_at", T.TimestampType()),
    T.StructField("late_rows", T.LongType())])
ORDERED = T.StructType([T.StructField("offer_id", T.StringType()), T.StructField("price", T.StringType()), T.StructField("seen_at", T.TimestampType())])


_MOMENT = T.StructType([T.StructField("ms", T.LongType())])
_PRICES = T.StructType([T.StructField("prices", T.StringType())])
_WAITING = T.StructType([T.StructField("prices", T.StringType()), T.StructField("due", T.LongType())])
_SHELF = T.StructType([T.StructField("shelf", T.IntegerType())])
# Rows of a group that wait together in one value; ``due`` of a group whose rows wait by moment.
_FEW = 65_536
_MANY = -1
# Offers are dealt into groups by hash, and the last prices of a group into values; neither may change under a checkpoint.
_GROUPS = 16_384
_SHELVES = 8


def _ms(entry: str) -> int:
    return int(entry.split(" ", 1)[0]) // 1000


def _name(offer: str | None) -> str:
    """An offer's id on one line, told apart from no id."""
    if offer is None:
        return ""
    return "=" + (offer.replace("\\", "\\\\").replace("\n", "\\n") if "\n" in offer or "\\" in offer else offer)


def _offer(name: str) -> str | None:
    if not name:
        return None
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name[1:]) if "\\" in name else name[1:]


class _OrderedChanges(StatefulProcessor):
    """Waits until the watermark has passed a moment, then takes its prices in order.

    Every key and every access to the state store costs round trips, so a key is a group of offers.  The few
    rows of a common group wait in one value with one timer, at the first of them.  Those of a hot
    group, or of one with a hot offer, lie under their millisecond, each with a timer; timers fire in order of time.  So no group takes
    more memory than a chunk of rows.  Rows without ``offer_id`` are of the one offer that the key names.
    """

    def __init__(self, few: int | None = None):
        self.most = few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", _SHELF, _PRICES)
        self.few = handle.getValueState("few", _WAITING)
        self.waiting = handle.getMapState("waiting", _MOMENT, _PRICES)

    def _wait_by_moment(self, entries: set[str]) -> None:
        moments: dict[int, set[str]] = {}
        for entry in entries:
            moments.setdefault(_ms(entry), set()).add(entry)
        for ms, found in moments.items():
            if self.waiting.containsKey((ms,)):
                found |= set(self.waiting.getValue((ms,))[0].split("\n"))
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), ("\n".join(found),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, due = self.few.get() if self.few.exists() else ("", None)
        found = set(held.split("\n")) if held else set()
        many = due == _MANY
        for chunk in rows:
            names = map(_name, chunk["offer_id"] if "offer_id" in chunk else [key[0]] * len(chunk))
            found |= {f"{us:020d} {price} {name}" for us, price, name in zip(chunk["us"], chunk["price"], names)}
            if not many and len(found) > (self.most or _FEW):
                if due is not None:
                    self.handle.deleteTimer(due)
                self.few.update(("", _MANY))
                many = True
            if many:
                self._wait_by_moment(found)
                found = set()
        if found:
            first = _ms(min(found))
            if first != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
            self.few.update(("\n".join(found), first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due = self.few.get() if self.few.exists() else ("", None)
        if due == _MANY:
            moment = (int(expiredTimerInfo.getExpiryTimeInMs()),)
            ready = self.waiting.getValue(moment)[0].split("\n")
            self.waiting.removeKey(moment)
        else:
            passed, ready, later = timerValues.getCurrentWatermarkInMs(), [], []
            for entry in held.split("\n") if held else []:
                (ready if _ms(entry) <= passed else later).append(entry)
            if later:
                first = _ms(min(later))
                self.handle.registerTimer(first)
                self.few.update(("\n".join(later), first))
            else:
                self.few.clear()
        shelves: dict[int, dict[str, list[tuple[str, str]]]] = {}
        for us, new, name in (e.split(" ", 2) for e in ready):
            shelves.setdefault(zlib.crc32(name.encode()) % _SHELVES, {}).setdefault(name, []).append((us, new))
        offers, prices, times = [], [], []
        for shelf, found in shelves.items():
            last = {}
            if self.last.containsKey((shelf,)):
                last = dict(line.split(" ", 1)[::-1] for line in self.last.getValue((shelf,))[0].split("\n"))
            for name, seen in found.items():
                price, offer = last.get(name), _offer(name)
                for us, new in sorted(seen, key=lambda e: (e[0], Decimal(e[1]))):
                    if new != price:
                        offers.append(offer)
                        prices.append(new)
                        times.append(int(us))
                    price = new
                last[name] = price
            self.last.updateValue((shelf,), ("\n".join(f"{price} {name}" for name, price in last.items()),))
        yield pd.DataFrame({"offer_id": offers, "price": prices, "seen_at": np.array(times, "int64").astype("datetime64[us]")})

    def close(self) -> None:
        pass


def ordered_price_changes(obs: DataFrame, watermark: str = "1 hour", few: int | None = None) -> DataFrame:
    """First price and every change per offer in event-time order, once the watermark has passed it.

    Rows that arrive out of order inside the watermark are put in order; later ones are dropped.
    Rows of one moment count by price.  ``obs``: offer_id STRING, price DECIMAL, seen_at TIMESTAMP (1970 or later).
    ``few``: rows of a group of offers that wait in one value.
    """
    rows = obs.selectExpr("offer_id", "CAST(price AS STRING) AS price", "CAST(seen_at AS TIMESTAMP) AS seen_at").filter(
        "price IS NOT NULL").withWatermark("seen_at", watermark)
    rows = rows.selectExpr(f"CAST(pmod(xxhash64(offer_id), {_GROUPS}) AS INT) AS offers", "offer_id", "price", "seen_at", "unix_micros(seen_at) AS us")
    return rows.groupBy("offers").transformWithStateInPandas(
        statefulProcessor=_OrderedChanges(few), outputStructType=ORDERED, outputMode="Append", timeMode="EventTime")


class _PriceChanges(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST_PRICE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of one offer in one micro-batch; the trigger size bounds them.
        batch = pd.concat([r[["price", "seen_at"]] for r in rows]).sort_values("seen_at", kind="stable")
        price, seen, late = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for new_price, new_seen in zip(batch["price"], batch["seen_at"]):
            if seen is not None and new_seen < pd.Timestamp(seen):
                late += 1
                continue
            if new_price != price:
                out.append((key[0], new_price, new_seen, late))
            price, seen = new_price, new_seen.to_pydatetime()
        self.last.update((price, seen, late))
        yield pd.DataFrame(out, columns=["offer_id", "price", "seen_at", "late_rows"])

    def close(self) -> None:
        pass


def price_changes_stream(obs: DataFrame) -> DataFrame:
    """First price and every change per offer; rows older than the last seen one are dropped and counted.

    ``obs``: offer_id STRING, price DECIMAL, seen_at TIMESTAMP.
    """
    rows = obs.selectExpr("offer_id", "CAST(price AS STRING) AS price", "CAST(seen_at AS TIMESTAMP) AS seen_at")
    return rows.groupBy("offer_id").transformWithStateInPandas(
        statefulProcessor=_PriceChanges(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


_LAST_SEEN = T.StructType([T.StructField("seen_ms", T.LongType()), T.StructField("fresh", T.BooleanType())])
STATES = T.StructType([
    T.StructField("offer_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("at", T.TimestampType())])


def _utc(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)


class _Freshness(StatefulProcessor):
    def __init__(self, max_age_ms: int):
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST_SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([r["seen_ms"].to_numpy() for r in rows]))
        seen, fresh = self.last.get() if self.last.exists() else (None, False)
        first, out = seen, []
        for now in map(int, times):
            if seen is not None and now <= seen:
                continue
            # A gap longer than the window is reported even when both ends arrive together.
            if fresh and now > seen + self.max_age_ms:
                out.append((key[0], "STALE", _utc(seen + self.max_age_ms)))
                fresh = False
            if not fresh:
                out.append((key[0], "FRESH", _utc(now)))
            seen, fresh = now, True
        if seen != first:
            if first is not None:
                self.handle.deleteTimer(first + self.max_age_ms)
            self.handle.registerTimer(seen + self.max_age_ms)
            self.last.update((seen, fresh))
        yield pd.DataFrame(out, columns=["offer_id", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        seen, _ = self.last.get()
        self.last.update((seen, False))
        yield pd.DataFrame([(key[0], "STALE", _utc(due))], columns=["offer_id", "state", "at"])

    def close(self) -> None:
        pass


def freshness_stream(obs: DataFrame, raw_hours=None, watermark: str = "1 hour") -> DataFrame:
    """FRESH when an offer is (again) observed, STALE when the window passes without an observation.

    ``obs``: offer_id STRING, seen_at TIMESTAMP.  Event time drives the timers.
    """
    age = int(max_age_hours(raw_hours) * 3_600_000)
    rows = obs.selectExpr("offer_id", "CAST(seen_at AS TIMESTAMP) AS seen_at").withWatermark("seen_at", watermark)
    rows = rows.selectExpr("offer_id", "seen_at", "unix_millis(seen_at) AS seen_ms")
    return rows.groupBy("offer_id").transformWithStateInPandas(
        statefulProcessor=_Freshness(age), outputStructType=STATES, outputMode="Append", timeMode="EventTime")


def freshness_sessions(obs: DataFrame, raw_hours=None, watermark: str = "1 hour") -> DataFrame:
    """(offer_id, fresh_at, stale_at) of every span in which an offer was observed often enough to stay fresh.

    Built-in session windows: observations at most the freshness window apart are one span,
    merged per offer in the state store whatever their number and order; a span is given out when
    the watermark has passed its end.  ``obs``: offer_id STRING, seen_at TIMESTAMP.
    """
    # A session ends before the end of its gap, an offer is fresh up to it: one microsecond more.
    gap = f"{int(max_age_hours(raw_hours) * 3_600_000_000) + 1} microseconds"
    rows = obs.selectExpr("offer_id", "CAST(seen_at AS TIMESTAMP) AS seen_at").withWatermark("seen_at", watermark)
    spans = rows.groupBy("offer_id", F.session_window("seen_at", gap).alias("span")).agg(F.count("*").alias("seen"))
    return spans.select("offer_id", F.col("span.start").alias("fresh_at"), (F.col("span.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("stale_at"), "seen")

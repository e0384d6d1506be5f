"""Repeated byte strings across listing texts, by suffix arrays over shards that share an anchor."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import listing_texts
from shelfspark.llm.suffixes import permuted_lcp, suffix_array
from shelfspark.session import ensure_checkpoint_dir

LENGTH = 400
GRAM = 64
# Contexts of one anchor above which its windows are compared by 128-bit digest instead, spread over all tasks.
CROWD = 4096
# A worker holds some hundred bytes per byte of a piece or shard.
_SHARD_BYTES = 1 << 19
_PIECE = 1 << 19
_SLOT = np.uint64((1 << 22) - 1)
_TABLE = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Anchors:
    """The anchor of a window is its leftmost smallest gram; windows next to each other mostly share one."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up = self.down = np.zeros(0, np.uint64)

    def find(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        """(anchor digest, first window, last window) over the stretches [start, end) of ``data``."""
        n, gram, span = len(data), self.gram, self.length - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        total = np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * self.up[:n])
        grams = (total[gram - 1:] - np.r_[np.uint64(0), total[:-gram]]) * self.down[:n - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        place = (grams & ~_SLOT) | np.arange(len(grams), dtype=np.uint64)
        windows = n - self.length + 1
        padded = np.full(-(-len(place) // span) * span, np.uint64(_MASK))
        padded[:len(place)] = place
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
        mark = np.zeros(n + 1, np.int32)
        long = ends - starts >= self.length
        np.add.at(mark, starts[long], 1)
        np.add.at(mark, ends[long] - self.length + 1, -1)
        inside = np.flatnonzero(np.cumsum(mark)[:windows] > 0)
        if not len(inside):
            return none, none, none
        anchor = (least[inside] & _SLOT).astype(np.int64)
        cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(inside) != 1)]
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(inside)] - 1
        return grams[anchor[first]].view(np.int64), inside[first], inside[last]


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _Anchors(length, gram)

        def scan(pieces):
            data = b"".join(p for _, _, p in pieces)
            ends = np.cumsum([len(p) for _, _, p in pieces])
            starts = ends - [len(p) for _, _, p in pieces]
            digest, first, last = finder.find(data, starts, ends)
            if not len(digest):
                return None
            owner = np.searchsorted(starts, first, "right") - 1
            shift = np.array([offset for _, offset, _ in pieces])[owner] - starts[owner]
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a:b + length]) for a, b in zip(first.tolist(), last.tolist())), "<i8").reshape(-1, 2)
            return pd.DataFrame({"row": np.array([r for r, _, _ in pieces])[owner], "anchor": digest, "c1": ids[:, 0], "c2": ids[:, 1],
                                 "lo": first + shift, "hi": last + shift})

        for batch in batches:
            pieces, size = [], 0
            for row, body in zip(batch["row"], batch["body"]):
                body = body.encode()
                # A very long text goes through in pieces; together they hold each window once.
                for at in range(0, max(len(body) - length + 1, 0), _PIECE):
                    piece = body[at:at + _PIECE + length - 1]
                    if size + len(piece) > _PIECE + length and pieces:
                        if (found := scan(pieces)) is not None:
                            yield found
                        pieces, size = [], 0
                    pieces.append((row, at, piece))
                    size += len(piece)
            if pieces and (found := scan(pieces)) is not None:
                yield found

    return run


def _cut_contexts(length: int):
    def frame(out: list[tuple]) -> pd.DataFrame:
        names = ("row", "anchor", "lo", "copies")
        return pd.DataFrame({c: [r[i] for r in out] for i, c in enumerate(names)}
                            | {"context": pd.Series([r[-1] for r in out], dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for batch in batches:
            for row, body, spots in zip(batch["row"], batch["body"], batch["spots"]):
                body = body.encode()
                for s in spots:
                    out.append((row, s["anchor"], s["lo"], s["copies"], body[s["lo"]:s["hi"] + length]))
                    size += len(out[-1][-1])
                if size > _SHARD_BYTES:
                    yield frame(out)
                    out, size = [], 0
        if out:
            yield frame(out)

    return run


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur in another window of these contexts."""
    # 0xFF never occurs in UTF-8, so no common prefix runs over the end of a context.
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    size = np.array([len(c) for c in contexts])
    start = np.cumsum(size + 1) - size - 1
    own = np.zeros(len(text) + 1, np.int32)
    np.add.at(own, start, 1)
    np.add.at(own, start + size - length + 1, -1)
    own = np.cumsum(own)[:-1] > 0
    sa = suffix_array(text, 256)
    run = np.cumsum(permuted_lcp(text, sa)[sa] < length)
    members = np.bincount(run, own[sa])
    again = np.zeros(len(text), bool)
    again[sa] = members[run] >= 2
    again &= own
    return [again[a:a + n - length + 1] for a, n in zip(start.tolist(), size.tolist())]


def _search_shards(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def search(rows):
            out = {"row": [], "start": [], "end": []}
            for (row, lo, copies, _), again in zip(rows, repeated_windows([r[3] for r in rows], length)):
                if copies > 1:  # every window of it occurs again; it was here for the others
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, again, False]))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    out["row"].append(row)
                    out["start"].append(lo + a)
                    out["end"].append(lo + b - 1 + length)
            return pd.DataFrame(out, dtype="int64")

        anchor = None
        for batch in batches:
            for row, own, lo, copies, context in zip(*(batch[c] for c in ("row", "anchor", "lo", "copies", "context"))):
                if own != anchor and size > _SHARD_BYTES:
                    yield search(held)
                    held, size = [], 0
                anchor = own
                held.append((row, lo, copies, bytes(context)))
                size += len(context)
        if held:
            yield search(held)

    return run


def _digest_windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, lo, copies, context in zip(*(batch[c] for c in ("row", "lo", "copies", "context"))):
                n = len(context) - length + 1
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[i:i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"row": row, "start": lo + np.arange(n), "copies": copies, "w1": ids[:, 0], "w2": ids[:, 1]})

    return run


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"id": batch["id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
        for body, starts, ends in zip(batch["body"], batch["starts"], batch["ends"]):
            body, kept, spans = body.encode(), hashlib.sha256(), []
            if starts is not None:
                order = np.argsort(starts, kind="stable")
                a, b = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
                cut = np.r_[True, a[1:] > b[:-1]]
                first = np.flatnonzero(cut)
                spans = list(zip(a[first].tolist(), b[np.r_[first[1:], len(a)] - 1].tolist()))
            at = 0
            for a, b in spans:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            out["n_bytes"].append(len(body))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(kept.hexdigest())
            out["removed"].append([{"start": a, "end": b} for a, b in spans])
        yield pd.DataFrame(out | {c: pd.Series(out[c], dtype=object) for c in ("kept_sha256", "removed")})


def remove_repeats(observations: DataFrame, key: str = "observation_id", text: str = "description", length: int = LENGTH,
                   gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Cut out of every text all bytes covered by a string of ``length`` bytes that starts anywhere else too.

    Each window of ``length`` bytes has an anchor, its smallest gram of ``gram`` bytes, which
    depends on the window alone; so equal windows share an anchor, and only anchors met twice
    matter.  Windows with one anchor form a context.  Equal contexts (128-bit digest) need no
    order: all their windows repeat.  Different contexts with one anchor go to a shard, whose
    suffix array is built by induced sorting (leftmost-smaller substrings, recursively); runs of
    suffixes with permuted common prefixes of ``length`` bytes or more are the repeats.  An
    anchor with more than ``crowd`` different contexts would overload a shard; its windows are
    counted by 128-bit digest in a plain aggregation, which finds the same ones.

    Texts are UTF-8; matches never cross texts, count within one text, may overlap, and are
    judged on the input.  Result, one row per observation, repeated rows included (they repeat
    each other): ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and
    ``removed`` (array of start, end in bytes).  A null text is empty.  Other columns are
    ignored; an empty table gives no rows.  A very long text is read in pieces that lose no window;
    overlapping and touching runs are one span.  Rows are numbered, and the input is read several
    times: it must come in the same order each time, as a stored table does.
    """
    spark = observations.sparkSession
    if gram > length:
        raise ValueError("a gram must fit into a window")
    texts = listing_texts(observations, key, text).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("body"))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/anchors-{uuid.uuid4().hex}"
    texts.select("row", "body").mapInPandas(
        _find_anchors(length, gram), "row long, anchor long, c1 long, c2 long, lo long, hi long").write.parquet(folder)
    # Most anchors are met once and end here; the counts travel alone, so the wide rows are shuffled once.
    met = spark.read.parquet(folder)
    met.join(met.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchor", "left_semi").write.parquet(f"{folder}-again")
    anchors = spark.read.parquet(f"{folder}-again")

    contexts = anchors.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("row", "lo", "hi")).alias("one"))
    several = contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    whole = (anchors.join(contexts.filter("copies > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_semi")
             .select("row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")))

    def cut(wanted) -> DataFrame:
        spots = (contexts.join(several.filter(wanted), "anchor")
                 .select("one.row", F.struct("anchor", "one.lo", "one.hi", "copies").alias("spot"))
                 .groupBy("row").agg(F.collect_list("spot").alias("spots")))
        return texts.select("row", "id", "body").join(spots, "row").select("row", "body", "spots").mapInPandas(
            _cut_contexts(length), "row long, anchor long, lo long, copies long, context binary")

    shards = (cut(F.col("n") <= crowd).repartition("anchor").sortWithinPartitions("anchor")
              .mapInPandas(_search_shards(length), "row long, start long, end long"))
    windows = cut(F.col("n") > crowd).mapInPandas(_digest_windows(length), "row long, start long, copies long, w1 long, w2 long")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = (windows.filter("copies = 1").join(again, ["w1", "w2"], "left_semi")
               .select("row", "start", (F.col("start") + length).alias("end")))

    spans = (whole.unionAll(shards).unionAll(crowded)
             .groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    kind = observations.schema[key].dataType.simpleString()
    return (texts.join(spans, "row", "left").select("id", "body", "starts", "ends")
            .mapInPandas(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "removed array<struct<start: long, end: long>>")
            .withColumnRenamed("id", key))

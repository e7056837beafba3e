"""Incremental substring deduplication over a log-structured fingerprint index.

The index is a folder of immutable runs and numbered manifests that name them; whoever opens the
folder, in whatever session, goes on from its highest manifest. A run holds, for each owner (a range of
hashes), the sorted hashes of all windows of WINDOW words that one batch brought in. A new batch, whose ids count
as higher than those before it, is handled in one exchange:

- a sender (a slice of documents) hashes every window and sorts the hashes. A window that a lower
  id of the same slice has is settled there; of the rest it sends each owner one packed, sorted list.
- the owner merges the lists of all senders with its part of every run, range of hashes by range. A window is repeated if a
  run holds its hash or a lower id of the batch has it. It answers with the repeated places, and the
  hashes that no run held become the batch's run.
- compaction merges the runs into one once there are more than RUNS of them. It also splits owners whose part
  would outgrow OWNER_WINDOWS: their number follows the index, and memory does not.

Hashes are 56 bits; each window carries 32 bits of a second hash, which must agree too before a
window counts as repeated, so that chance agreement is verified away. The words of earlier batches are not
kept, so 88 bits in all stand for them: at 10^13 windows a wrong agreement has a chance of 1 in 6.

A passage in a third of all documents costs an entry per slice, not per document.

A whole table is taken in batches in order of id (BATCHES), against an index of its own, which goes
with the last one.

Cases: a null text has no words; texts shorter than a window keep all. A row without an id is left
whole, and nothing is removed because of it. Rows of one id remove nothing from each other. Ids may be of
any type that has an order. Repeated rows give a row each. Other columns are never read. An empty
table gives an empty result.
"""

from __future__ import annotations

import contextlib
import functools
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Files, new_path, partitions, passing, save, ship, write_table
from .text import hashes, release, slices, windows, words

WINDOW = 13
#: Shares of a whole table's ids at which its batches end.
BATCHES = (0.25, 0.5, 1.0)
#: Runs kept before they are merged, windows an owner has of a batch and of the index at most, text bytes of a sender's slice.
RUNS, OWNER_WINDOWS, SEND_BYTES = 1, 2_000_000, 6_000_000
#: Bits of a window's hash.
HASH_BITS = 56
#: Windows of a row at most (rows of megabytes cost a JVM several times their size), bytes of the rows that Python hands over at a time, windows that an owner sorts at a time.
ROW_WINDOWS, TABLE_BYTES, SORT_WINDOWS = 16_384, 2_000_000, 131_072
#: While an index is added to or compacted: rows that Spark reads at a time, bytes that it hands to Python at a time.
FEW = {"spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as gaps, byte plane by byte plane, without the planes that are all zero; a byte says how many are there."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return planes(gaps)


def planes(values: np.ndarray) -> bytes:
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    table = np.ascontiguousarray(values, values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return bytes([width]) + np.ascontiguousarray(table[:, :width].T).tobytes()


def from_planes(data: bytes, kind=np.uint64) -> np.ndarray:
    width = data[0]
    table = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((table.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = table.T
    return out.reshape(-1).view(kind)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def _cut_at(cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches between cuts, in pieces of ROW_WINDOWS at most."""
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for at in range(a, b, ROW_WINDOWS):
            yield at, min(b, at + ROW_WINDOWS)


def _tables(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of little more than TABLE_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= TABLE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


SENT = "owner int, hashes binary, checks binary, docs binary, places binary, ids binary, prints binary, settled boolean"


def _send(owner_bits: int, k: int):
    """Documents to rows for owners, and settled rows that pass through them: docs and places only."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        batch = batch.filter(batch.column("id").is_valid())
        batch = batch.take(pa.array(np.argsort(batch.column("id").to_numpy(), kind="stable"))) if batch.num_rows else batch
        counts, codes, distinct = words(batch.column("text"))
        if not len(codes):
            return
        ids, prints = batch.column("id").to_numpy().astype(np.int64), batch.column("print").to_numpy()
        h, doc, place = windows(hashes(distinct)[codes], counts, k)
        check = windows(hashes(distinct, 1)[codes], counts, k)[0]
        h, check = h >> np.uint64(64 - HASH_BITS), (check >> np.uint64(32)).astype(np.uint32)
        if not len(h):
            return
        order = np.lexsort((check, h))
        h, doc, place, check = h[order], doc[order], place[order], check[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = ids[doc] > ids[first]
        if later.any():
            settled_doc, settled_place = doc[later], place[later]
            for a, b in _cut_at(np.array([0, len(settled_doc)])):
                x = docs_of(settled_doc[a:b], settled_place[a:b], ids, prints)
                # Settled rows go to any owner, spread by their first id.
                yield int(np.frombuffer(x[2][:8], np.int64)[0] % (1 << owner_bits)), None, None, *x, True
        h, doc, place, check = h[~later], doc[~later], place[~later], check[~later]
        owner = (h >> np.uint64(HASH_BITS - owner_bits)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
        for a, b in _cut_at(cuts):
            yield int(owner[a]), pack(h[a:b]), check[a:b].tobytes(), *docs_of(doc[a:b], place[a:b], ids, prints), False

    def docs_of(doc: np.ndarray, place: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        used, at = np.unique(doc, return_inverse=True)
        low = ids[used]
        return planes(at.astype(np.uint32)), planes(place.astype(np.uint32)), low[:1].tobytes() + planes(np.diff(low, prepend=low[:1]).astype(np.uint64)), planes(prints[used].astype(np.uint32))

    names = ["owner", "hashes", "checks", "docs", "places", "ids", "prints", "settled"]
    kinds = [pa.int32(), *[pa.binary()] * 6, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEND_BYTES):
            yield from _tables(rows(batch), names, kinds)

    return run


#: Buckets of documents that owners address their answers to, and places that a bucket gets at most.
BUCKETS, BUCKET_PLACES = 64, 5_000_000
#: An answer (kind 0, place: a bucket) or a part of a run (kind 1, place: an owner).
ANSWER = "kind int, place int, ids binary, prints binary, counts binary, data binary, checks binary"
RUN = "owner int, data binary, checks binary"
_NAMES = ["kind", "place", "ids", "prints", "counts", "data", "checks"]
_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _table(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_batches(_tables(rows, names, kinds), pa.schema(list(zip(names, kinds))))


def _answer(ids: np.ndarray, prints: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> list[tuple]:
    """Repeated places, a packed row for each bucket of documents."""
    bucket = ids[doc] % buckets
    order = np.lexsort((place, doc, bucket))
    bucket, doc, place = bucket[order], doc[order], place[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(doc)]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        starts = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1])))
        of = doc[a:b][starts]
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        out.append((0, int(bucket[a]), ids[of].tobytes(), planes(prints[of].astype(np.uint32)), planes(counts), planes(place[a:b].astype(np.uint32)), None))
    return out


def _ranges(parts: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Parts (sorted hashes, and arrays beside them) range of hashes by range, about `most` windows in each; equal hashes are in one."""
    low, high = min(int(x[0][0]) for x in parts), max(int(x[0][-1]) for x in parts)
    n = 1 + sum(len(x[0]) for x in parts) // most
    edges = np.array([low + (high - low) * i // n for i in range(1, n)], np.uint64)
    cuts = [[0, *np.searchsorted(x[0], edges).tolist(), len(x[0])] for x in parts]
    for i in range(n):
        yield [tuple(y[c[i] : c[i + 1]] for y in x) for x, c in zip(parts, cuts) if c[i] < c[i + 1]]


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of runs (sorted hashes, checks) as one, sorted by hash."""
    h, check = map(np.concatenate, zip(*sorted(parts, key=lambda x: x[0][0])))
    if (h[1:] < h[:-1]).any():  # of several runs
        order = np.argsort(h, kind="stable")
        h, check = h[order], check[order]
    return h, check


def _own(keep_run: bool, buckets: int):
    def rows(sent: pa.Table, runs: pa.Table) -> Iterator[tuple]:
        parts, ids, prints, base = [], [], [], 0
        owner = None
        for row in (r for b in sent.to_batches(max_chunksize=16) for r in b.to_pylist()):
            owner = row["owner"]
            d, p = from_planes(row["docs"], np.uint32), from_planes(row["places"], np.uint32)
            i = np.frombuffer(row["ids"][:8], np.int64) + np.cumsum(from_planes(row["ids"][8:]).astype(np.int64))
            q = from_planes(row["prints"], np.uint32)
            if row["settled"]:
                yield from _answer(i, q, d, p, buckets)
                continue
            parts.append((unpack(row["hashes"]), np.frombuffer(row["checks"], np.uint32), d + np.uint32(base), p))
            ids.append(i)
            prints.append(q)
            base += len(i)
        if not parts:
            return
        ids, prints = np.concatenate(ids), np.concatenate(prints)
        run = sorted(((unpack(r["data"]), np.frombuffer(r["checks"], np.uint32)) for b in runs.to_batches(max_chunksize=16) for r in b.to_pylist()), key=lambda x: x[0][0])
        found, fresh = [], []
        for part in _ranges(parts, SORT_WINDOWS):
            if not part:
                continue
            h, check, doc, place = map(np.concatenate, zip(*part))
            order = np.lexsort((check, h))
            h, check, doc, place = h[order], check[order], doc[order], place[order]
            held = np.zeros(len(h), bool)
            within = [(x[a:b], y[a:b]) for x, y in run if x[0] <= h[-1] and x[-1] >= h[0] for a, b in [(np.searchsorted(x, h[0]), np.searchsorted(x, h[-1], "right"))] if a < b]
            if within:
                held = holds(*_joined(within), h, check)
            starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
            who = ids[doc]
            lowest = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(h))))
            repeated = held | (who > lowest)
            found.append((doc[repeated], place[repeated]))
            if keep_run:
                starts = starts[~held[starts]]
                fresh.append((h[starts], check[starts]))
        del parts, run
        doc, place = map(np.concatenate, zip(*found))
        if len(doc):
            yield from _answer(ids, prints, doc, place, buckets)
        if keep_run:
            h, check = map(np.concatenate, zip(*fresh))
            for a, b in _cut_at(np.array([0, len(h)])):
                yield 1, owner, None, None, None, pack(h[a:b]), check[a:b].tobytes()

    def run(sent: pa.Table, runs: pa.Table) -> pa.Table:
        try:
            return _table(rows(sent, runs), _NAMES, _KINDS)
        finally:
            release()

    return run


def _gather(part: pa.Table) -> pa.Table:
    """A bucket's answers from all owners: a row for each document, with its places in order."""
    ids, prints, counts, place = [], [], [], []
    for row in part.to_pylist():
        ids.append(np.frombuffer(row["ids"], np.int64))
        prints.append(from_planes(row["prints"], np.uint32))
        counts.append(from_planes(row["counts"], np.uint32))
        place.append(from_planes(row["data"], np.uint32))
    ids, prints, counts, place = map(np.concatenate, (ids, prints, counts, place))
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((place, prints[doc], ids[doc]))
    doc, place = doc[order], place[order]
    who, print_ = ids[doc], prints[doc]
    cuts = np.concatenate(([0], np.flatnonzero((np.diff(who) != 0) | (np.diff(print_) != 0)) + 1, [len(doc)]))
    rows = [(int(who[a]), int(print_[a]), planes(place[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    return _table(rows, ["id", "print", "data"], [pa.int64(), pa.int64(), pa.binary()])


def holds(run: np.ndarray, run_check: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which (hash, second hash) pairs a sorted run holds: a merge join by binary search."""
    out, at = np.zeros(len(h), bool), np.searchsorted(run, h)
    look = np.arange(len(h))
    while len(look):
        look = look[at[look] < len(run)]
        look = look[run[at[look]] == h[look]]
        same = run_check[at[look]] == check[look]
        out[look[same]] = True
        look = look[~same]  # one hash of two contents: see the run's next entry
        at[look] += 1
    return out


def _merge(owner_bits: int):
    """An owner's parts of all runs as one, without repetition, dealt to owners of so many bits."""

    def rows(part: pa.Table) -> Iterator[tuple]:
        parts = [(unpack(r["data"]), np.frombuffer(r["checks"], np.uint32)) for b in part.to_batches(max_chunksize=16) for r in b.to_pylist()]
        for piece in _ranges(parts, SORT_WINDOWS):
            if not piece:
                continue
            h, check = map(np.concatenate, zip(*piece))
            order = np.lexsort((check, h))
            h, check = h[order], check[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
            h, check = h[new], check[new]
            owner = (h >> np.uint64(HASH_BITS - owner_bits)).astype(np.int64)
            for a, b in _cut_at(np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))):
                yield int(owner[a]), pack(h[a:b]), check[a:b].tobytes()

    def run(part: pa.Table) -> pa.Table:
        try:
            return _table(rows(part), ["owner", "data", "checks"], [pa.int32(), pa.binary(), pa.binary()])
        finally:
            release()

    return run


@contextlib.contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """While rows of an index are read and handed over: as few at a time as FEW says."""
    before = {key: spark.conf.get(key) for key in FEW}
    for key, value in FEW.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class FingerprintIndex:
    """Window hashes of all batches so far, in a folder that all executors share; None: one that goes when the driver ends."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, runs: int | None = None):
        self.spark, self.path, self.most_runs = ship(spark), path or new_path(spark, "substring-index"), RUNS if runs is None else runs
        self.files = Files(spark, self.path)
        self.version, self.state = 0, {"window": window, "owner_bits": max(0, (partitions(spark) - 1).bit_length()), "n_windows": 0, "runs": []}
        for name in self.files.names():
            if name.startswith("manifest-") and int(name[9:]) > self.version:
                self.version = int(name[9:])
        if self.version:
            self.state = json.loads(self.files.read(f"manifest-{self.version}"))
            if self.state["window"] != window:
                raise ValueError(f"the index at {self.path} has windows of {self.state['window']} words")

    def _commit(self, **state) -> None:
        """The next manifest; what it no longer names is deleted."""
        gone = set(self.state["runs"]) - set(state.get("runs", self.state["runs"]))
        self.state, self.version = self.state | state, self.version + 1
        self.files.write(f"manifest-{self.version}", json.dumps(self.state))
        for name in [*gone, f"manifest-{self.version - 1}"]:
            self.files.delete(name)

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")

    def _held(self) -> DataFrame:
        """All runs' parts."""
        return functools.reduce(DataFrame.union, map(self._run, self.state["runs"])) if self.state["runs"] else self.spark.createDataFrame([], RUN)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        with _few_rows(self.spark):
            save(rows, f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Answers (packed places of repeated windows, by bucket) to a batch of columns id (long), print, text.

        last: no batch follows, so the batch's own run is not kept.
        """
        n_windows = (docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // 4
        bits = max(self.state["owner_bits"], (max(self.state["n_windows"], n_windows) // OWNER_WINDOWS).bit_length())
        if bits > self.state["owner_bits"]:
            self.compact(bits)
        buckets = max(BUCKETS, n_windows // BUCKET_PLACES)
        sent = docs.select("id", "print", "text").mapInArrow(_send(bits, self.state["window"]), SENT)
        out = sent.groupBy("owner").cogroup(self._held().groupBy("owner")).applyInArrow(_own(not last, buckets), ANSWER)
        name = uuid.uuid4().hex
        batch = passing(self.spark, f"{self.path}/batch-{name}")
        with _few_rows(self.spark):
            save(out.withColumnRenamed("place", "owner"), batch, by="kind")
        if not last:
            runs = [f"run-{name}"] if self.files.move(f"batch-{name}/kind=1", f"run-{name}") else []
            self._commit(runs=[*self.state["runs"], *runs], n_windows=self.state["n_windows"] + n_windows)
            if len(self.state["runs"]) > self.most_runs:
                self.compact()
        schema = "owner int, ids binary, prints binary, counts binary, data binary"
        found = self.spark.read.schema(schema).parquet(f"{batch}/kind=0") if "kind=0" in Files(self.spark, batch).names() else self.spark.createDataFrame([], schema)
        return found.withColumnRenamed("owner", "place")

    def clear(self) -> None:
        """An index without runs; answers given so far stay."""
        self._commit(runs=[], n_windows=0)

    @staticmethod
    def places(answers: DataFrame) -> DataFrame:
        """id, print, data (packed places), a row for each document that has any."""
        return answers.groupBy("place").applyInArrow(_gather, "id long, print long, data binary")

    def compact(self, owner_bits: int | None = None) -> None:
        """One run in place of all, sorted and without repetition, for owners of so many bits."""
        bits = self.state["owner_bits"] if owner_bits is None else owner_bits
        merged = [self._write(self._held().groupBy("owner").applyInArrow(_merge(bits), RUN))] if self.state["runs"] else []
        self._commit(runs=merged, owner_bits=bits)


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("data").to_pylist()):
                w = (text or "").encode().split()
                n_words.append(len(w))
                if places:
                    marks = np.zeros(len(w) + 1, np.int32)
                    starts = from_planes(places, np.uint32).astype(np.int64)
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + k, -1)
                    stays = np.cumsum(marks)[:-1] == 0
                    w = [x for x, s in zip(w, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def _numbered(keys: DataFrame) -> DataFrame:
    """key, number: numbers rise as keys do."""
    ordered = keys.select("key").dropna().distinct().orderBy("key")
    return write_table(ordered.select(F.col("key").alias("key_"), F.monotonically_increasing_id().alias("id")), "substring-ids")


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: tuple[float, ...] = BATCHES, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_text (kept words joined by one space).

    index: docs are a new batch for it, later than all that it holds, and stay in it; without one, docs
    are all there is.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("print"))
    kind = dict(rows.dtypes)["key"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("id", F.col("key").cast("long"))
    else:
        rows = rows.join(_numbered(rows), F.col("key") == F.col("key_"), "left").select("key", "text", "print", "id")
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id IS NOT NULL AND n > 1").limit(1).count():
        # 32 bits of the text's hash tell rows of one id apart.
        rows = rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)))
    batch = rows.filter(F.col("id").isNotNull())
    if index:
        answers = index.add(batch)
    else:
        cuts = sorted(set(rows.agg(F.percentile_approx("id", list(batches[:-1]), 10_000).alias("cuts")).first().cuts or []) if len(batches) > 1 else [])
        own, found = FingerprintIndex(spark, window=window), []
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = batch.filter(F.col("id") > low) if low is not None else batch
            part = part.filter(F.col("id") <= high) if high is not None else part
            found.append(own.add(part, last=high is None))
        own.clear()
        answers = functools.reduce(DataFrame.union, found)
    gathered = FingerprintIndex.places(answers).select(F.col("id").alias("id_"), F.col("print").alias("print_"), "data")
    joined = rows.join(gathered, (F.col("id") == F.col("id_")) & (F.col("print") == F.col("print_")), "left").select(F.col("key").alias("id"), "text", "data")
    return joined.mapInArrow(_cut(index.state["window"] if index else window), f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w),
each AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS content FROM starts),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS low FROM each) WHERE low < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS places FROM repeated, (SELECT unnest(range(0, 13)) AS j) GROUP BY doc_id),
kept AS (SELECT doc_id, words, list_filter(words, lambda x, i: NOT list_contains(coalesce(places, []), i)) AS stay FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(stay) AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
"""

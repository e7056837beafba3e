"""Exact deduplication by a Golomb-coded fingerprint exchange.

Each sender (a partition, in chunks) sorts the distinct 64-bit fingerprints of its texts, splits
them by owner (a fingerprint range) and sends each owner one Golomb-Rice coded list. An owner
answers every list with a bitmap: which of its fingerprints some other list holds too. Only
suspects, texts whose fingerprint came back marked or that repeat inside their sender, are
shuffled as texts; grouping them by digest and bytes verifies equality before rows are dropped.

Groups that hold more than a thousandth of all rows are few, so their answers go to every task and no
task gets all rows of one. A sender sends a fingerprint once however often it holds it, so a text that makes up a third of
all rows costs one code per sender and no owner gets more than one per sender of it.

Cases: a null text counts as empty, and empty texts equal each other. A null id is lower than any
other; ids may be of any type that has an order. Of rows that share text and id, exactly one is kept. An empty table gives an empty result.
Other columns of the input are never read. Should two texts of one SHA-256 ever differ, the query
raises instead of dropping one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop_table, hot_join, partitions, ship, write_table

#: Rows that a sender gathers before it sends: bounds its memory.
CHUNK_ROWS = 1_000_000
#: Fingerprints an owner should get at most: sets how many owners there are.
OWNER_ROWS = 2_000_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted 64-bit values as Golomb codes with a power of two as divisor: its exponent, quotients in unary, remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values)
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    bits = np.empty((len(values), k), np.uint8)
    for j in range(k):
        bits[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(bits.reshape(-1)).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
    for j in range(k):
        gaps += bits[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


SENT = "owner int, sender long, n int, k int, quotients binary, remainders binary, again binary, counts binary, uids binary"


def _send(owner_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, uids, rows = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            fp, uid = np.concatenate(prints), np.concatenate(uids)
            sender = int(uid.min())
            order = np.argsort(fp, kind="stable")
            fp, uid = fp[order], uid[order]
            first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
            counts = np.diff(np.append(first, len(fp)))
            distinct = fp[first]
            owner = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                o = int(owner[a])
                k, quotients, rest = rice_encode(distinct[a:b] - (np.uint64(o) << np.uint64(64 - owner_bits)) if owner_bits else distinct[a:b])
                rows_ = slice(first[a], first[b] if b < len(first) else len(fp))
                out.append((o, sender, int(b - a), k, quotients, rest, np.packbits(counts[a:b] > 1).tobytes(), counts[a:b].astype(np.int32).tobytes(), uid[rows_].tobytes()))
            names = ["owner", "sender", "n", "k", "quotients", "remainders", "again", "counts", "uids"]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            if batch.num_rows:
                prints.append(batch.column("fp").to_numpy().view(np.uint64))
                uids.append(batch.column("uid").to_numpy())
                rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from flush()
                prints, uids, rows = [], [], 0
        if rows:
            yield from flush()

    return run


def _answer(sent: pa.Table) -> pa.Table:
    """An owner: for each list it got, a bitmap of the fingerprints that another list holds too."""
    lists = [rice_decode(*x) for x in zip(*(sent.column(c).to_pylist() for c in ("n", "k", "quotients", "remainders")))]
    values, place, seen = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    marks = seen[place] > 1
    ends = np.cumsum([len(x) for x in lists])
    bitmaps = [np.packbits(marks[e - len(x) : e]).tobytes() for x, e in zip(lists, ends)]
    return sent.select(["owner", "sender"]).append_column("bitmap", pa.array(bitmaps, pa.binary()))


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender again: row numbers of the texts that its own list or an owner's bitmap marks."""
    for batch in batches:
        for n, again, bitmap, counts, uids in zip(*(batch.column(c).to_pylist() for c in ("n", "again", "bitmap", "counts", "uids"))):
            marks = np.unpackbits(np.frombuffer(again, np.uint8) | np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
            uid = np.frombuffer(uids, np.int64)[np.repeat(marks, np.frombuffer(counts, np.int32))]
            if len(uid):
                yield pa.RecordBatch.from_arrays([pa.array(uid)], ["uid"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id stays."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    digest = F.unhex(F.sha2("text", 256)).alias("sha")
    base = write_table(rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.xxhash64("text").alias("fp"), digest), "exact-base")
    total = base.count()
    owner_bits = max(partitions(spark) - 1, total // OWNER_ROWS).bit_length()
    sent = write_table(base.select("uid", "fp").mapInArrow(_send(owner_bits), SENT), "exact-sent")
    bitmaps = sent.select("owner", "sender", "n", "k", "quotients", "remainders").groupBy("owner").applyInArrow(_answer, "owner int, sender long, bitmap binary")
    marked = sent.select("owner", "sender", "n", "again", "counts", "uids").join(bitmaps, ["owner", "sender"]).mapInArrow(_suspects, "uid long")
    suspects = write_table(base.join(marked, "uid").select("uid", "id", "sha"), "exact-suspects")
    drop_table(sent)

    ids = suspects.select(F.col("id").alias("suspect")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("suspect")), "left_semi").groupBy(digest, "text").agg(F.lit(1).alias("one"))
    verified = texts.groupBy("sha").agg(F.count("one").alias("n_texts"))
    groups = suspects.groupBy("sha").agg(F.max(F.struct("id", "uid")).alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    sound = F.when(F.col("n_texts") == 1, F.col("keep")).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ")).cast(f"struct<id:{kind},uid:long>"))
    groups = write_table(groups.join(verified, "sha").select("sha", sound.alias("keep"), "size"), "exact-groups")
    return hot_join(base.drop("fp"), groups, "sha", "size", total, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("uid") == F.col("keep.uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

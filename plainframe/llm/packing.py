"""Best-fit packing of token sequences by linear grouping.

Texts are cut into pieces of at most the capacity. Only the histogram of piece lengths, bounded by
the capacity, goes to the driver. There the plan is made:

1. Linear grouping: large lengths, sorted, fall into GROUPS groups of equal cardinality, and each
   is rounded up to the largest of its group, so that few sizes are left.
2. Configurations of these few sizes are optimised one after another: the largest size left and
   the fullest set of sizes beside it (a bounded subset-sum), used as often as the groups allow.
3. Actual lengths take the rounded places, largest first; what rounding left open is free again.
4. Small lengths, longest first, go where they fit best, into new sequences where nowhere.

A plan is a list of runs: as many sequences with the same lengths in the same order. Its size follows
from the capacity and GROUPS, not from the data, so it is broadcast. Pieces find their places by
their rank among pieces of one length. Ranks are counted in salted parts, as many as keep a part under
PART_PIECES were all pieces of one length, whose offsets are sums over the parts' counts; so a length that a
third of all pieces share is spread.

A tokenizer that lower-cases, drops white space and cuts letters from marks (read from its file)
gives a word ids that do not depend on its neighbours across ASCII white space, nor those of its letters on
the marks behind them. Such units are encoded once, through a cache in each worker, and texts are
put together from them. Any other tokenizer gets whole texts.

Cases: a null or empty text is its end token alone; repeated rows and null ids give pieces each;
ids may be of any type; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import partitions, ship, write_table
from .text import slices, words

CAPACITY, END = 2048, 0
#: Groups of large lengths, and the share of the capacity over which a length is large.
GROUPS, LARGE = 512, 4
PART_PIECES = 1_000_000
SLICE_BYTES, CACHE_WORDS, CACHE_UNITS = 6_000_000, 1_200_000, 700_000
#: How a tokenizer's file says that it lower-cases and cuts words into runs of letters, digits and marks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: A word of plain letters, then marks: the tokenizer lower-cases it and cuts it between the two, so both parts have ids of their own.
PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[.,;:!?|*&%#$]*)$"

_worker: dict = {}


class _Vocabulary:
    """Ids of the units seen so far, in one growing buffer, and each unit's place in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # For units, which are lower-cased and cut already: the same merges without the normaliser and the cutting.
        self.units_only = Tokenizer(self.model.model)
        self.units_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.by_units = spec.get("normalizer") == NORMALIZER and cuts[0] == SPLIT and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in cuts[1:])
        self.by_units = self.by_units and spec["post_processor"] is None and not any(c in x["content"] for x in spec["added_tokens"] for c in " \t\n\v\f\r")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.ids, self.starts = array.array("I", [END]), array.array("q", [0, 0, 1])  # unit 0 is empty, unit 1 the end token
        self.words, self.units = pa.array([], pa.string()), np.empty((0, 2), np.int32)

    def unit_places(self, units: pa.Array, model) -> np.ndarray:
        """The places of units, those that are new being encoded by model."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [u for u in distinct if u not in self.place]
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            ids = [e.ids for e in model.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.place.update(zip(part, range(len(self.starts) - 1, len(self.starts) - 1 + len(part))))
            self.starts.frombytes((len(self.ids) + np.cumsum(sizes)).tobytes())
            self.ids.frombytes(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, sizes.sum()).tobytes())
        of = np.fromiter(map(self.place.__getitem__, distinct), np.int32, len(distinct))
        return of[coded.indices.to_numpy(zero_copy_only=False)]

    def learn(self, words: pa.Array) -> np.ndarray:
        """The places of the two units of words that are new."""
        cut = pc.extract_regex(words, PLAIN)  # null where a word is not plain: then it is one unit
        letters, marks = pc.struct_field(cut, "letters"), pc.struct_field(cut, "marks")
        plain = cut.is_valid()
        out = np.zeros((len(words), 2), np.int32)  # place 0 is the empty unit
        at = plain.to_numpy(zero_copy_only=False)
        out[~at, 0] = self.unit_places(words.filter(pc.invert(plain)), self.model)
        out[at, 0] = self.unit_places(pc.utf8_lower(letters.filter(plain)), self.units_only)
        out[at, 1] = self.unit_places(marks.filter(plain), self.units_only)
        return out

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The places of each word's two units."""
        if len(self.words) + len(distinct) > CACHE_WORDS or len(self.place) + len(distinct) > CACHE_UNITS:
            self.clear()
        at = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(pc.is_null(at))
        if len(new):
            self.units = np.concatenate((self.units, self.learn(new)))
            self.words = pa.concat_arrays([self.words, new])
            place = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            at = pc.fill_null(at, 0).to_numpy().copy()
            at[place] = len(self.words) - len(new) + np.arange(len(new))
        else:
            at = at.to_numpy()
        return self.units[at]


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, each text with the end token, and the ends of the texts."""
    if _worker.get("path") != path:
        _worker.update(path=path, vocabulary=_Vocabulary(path))
    known: _Vocabulary = _worker["vocabulary"]
    if not known.by_units:
        all_ids = [[*known.model.encode(x or "", add_special_tokens=False).ids, END] for x in texts.to_pylist()]
        return np.array([i for ids in all_ids for i in ids], np.uint32), np.cumsum([len(ids) for ids in all_ids], dtype=np.int64)
    counts, codes, distinct = words(texts)
    units = known.places(distinct)
    flat, starts = np.array(known.ids, np.uint32), np.array(known.starts, np.int64)
    # Two units for every word of a text, then its end token.
    ends = np.cumsum(2 * counts + 1)
    order = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    of_words = np.ones(len(order), bool)
    of_words[ends - 1] = False
    order[of_words] = units[codes].reshape(-1)
    n = starts[order + 1] - starts[order]
    total = np.cumsum(n)
    at = np.repeat(starts[order] - (total - n), n)
    at += np.arange(len(at))
    return flat[at], total[ends - 1] if len(ends) else total


PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, ends = token_ids(path, batch.column("text"))
            lengths = np.diff(ends, prepend=0)
            many = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(ends)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            size = np.minimum(capacity, lengths[doc] - start)
            base = (ends - lengths)[doc] + start
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            parts = [raw[4 * a : 4 * b] for a, b in zip(base.tolist(), (base + size).tolist())]
            crc = [zlib.crc32(x) for x in parts]
            out = [batch.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([bytes(x) for x in parts] if with_ids else [None] * len(parts), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, cut into groups of equal cardinality."""
    total = sum(n for _, n in large)
    out, current, room = [], [], 0
    bounds = [total * (k + 1) // groups - total * k // groups for k in range(groups)]
    sizes = iter([b for b in bounds if b])
    room = next(sizes, 0)
    for length, n in large:
        while n:
            take = min(n, room)
            current.append([length, take])
            n, room = n - take, room - take
            if not room:
                out.append(current)
                current, room = [], next(sizes, 0)
    return out


def _fullest(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How often to use each size so that their sum, at most room, is the largest; large sizes first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for g, (size, n) in enumerate(zip(sizes, counts)):
        for _ in range(min(n, room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((g, reach))
            reach = more
    at, used = reach.bit_length() - 1, {}
    for g, before in reversed(steps):
        if not before >> at & 1:
            used[g] = used.get(g, 0) + 1
            at -= sizes[g]
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in order, sequences) that use every piece of the histogram once."""
    runs = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    large = [(x, n) for x, n in sorted(histogram.items(), reverse=True) if capacity > x > capacity // LARGE]
    grouped = _groups(large, groups)
    sizes, counts = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    filled: list[tuple[tuple[int, ...], int]] = []
    while any(counts):
        first = next(g for g, n in enumerate(counts) if n)
        left = [n - (g == first) for g, n in enumerate(counts)]
        used = _fullest(sizes, left, capacity - sizes[first])
        used[first] = used.get(first, 0) + 1
        times = min(counts[g] // k for g, k in used.items())
        places = [g for g, k in sorted(used.items()) for _ in range(k)]
        # Actual lengths in place of rounded ones: runs of sequences whose lengths are all the same.
        taken = []
        for g in places:
            need, mine = times, []
            while need:
                length, n = grouped[g][0]
                mine.append([length, min(n, need)])
                need -= mine[-1][1]
                grouped[g][0][1] -= mine[-1][1]
                if not grouped[g][0][1]:
                    grouped[g].pop(0)
            taken.append(mine)
            counts[g] -= times
        while taken[0]:
            n = min(mine[0][1] for mine in taken)
            filled.append((tuple(mine[0][0] for mine in taken), n))
            for mine in taken:
                mine[0][1] -= n
                if not mine[0][1]:
                    mine.pop(0)
    room: list[list] = [[] for _ in range(capacity + 1)]
    for lengths, n in filled:
        room[capacity - sum(lengths)].append((lengths, n))
    for length, n in sorted(((x, n) for x, n in histogram.items() if x <= capacity // LARGE), reverse=True):
        for free in range(length, capacity + 1):
            fits = free // length
            while n and room[free]:
                lengths, bins = room[free].pop()
                full = min(bins, n // fits)
                if full:
                    room[free - fits * length].append((lengths + (length,) * fits, full))
                    n -= full * fits
                if full < bins:
                    if n:
                        room[free - n * length].append((lengths + (length,) * n, 1))
                        full, n = full + 1, 0
                    if full < bins:
                        room[free].append((lengths, bins - full))
            if not n:
                break
        fits = capacity // length
        if n // fits:
            room[capacity - fits * length].append(((length,) * fits, n // fits))
        if n % fits:
            room[capacity - n % fits * length].append(((length,) * (n % fits), 1))
    return runs + [run for at in room for run in at]


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and rank among its pieces the sequence and the offset there, as sorted intervals."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            rows.append((x, rank, base, offset))
            taken[x] = rank + n
            offset += x
        base += n
    rows.sort()
    length, rank, sequence, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4
    return {"length": length, "rank": rank, "sequence": sequence, "offset": offset}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table["length"] << 48) + table["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(table["offset"][at])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids (binary, little-endian unsigned 32-bit)."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    pieces = write_table(rows.mapInArrow(_pieces(tokenizer, capacity, with_ids), f"id {kind}, {PIECES}"), "pieces", even=False)
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(max(partitions(spark), -(-pieces.count() // PART_PIECES)))).alias("salt")
    counts = pieces.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # bounded by the capacity
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("salt")
    offsets = counts.select(F.col("length").alias("length_"), F.col("salt").alias("salt_"), (F.sum("n").over(before) - F.col("n")).alias("before"))
    part = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.select("*", salt).withColumn("k", F.row_number().over(part))
    ranked = ranked.join(offsets, (F.col("length") == F.col("length_")) & (F.col("salt") == F.col("salt_")))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("before") + F.col("k") - 1).alias("rank"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if with_ids else ''}sequence_id long, offset long"
    return ranked.mapInArrow(_place(shared), schema).withColumnRenamed("id", id_col)

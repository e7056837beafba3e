"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped edges.

Texts of one shingle set are one class, found by a 128-bit digest of the whole set, so copies cost
one row from there on. A class is signed by one-permutation hashing: a shingle's hash falls into one
of BINS bins by its top bits and a bin keeps its minimum; an empty bin takes the value of the first
filled bin in a random sequence of its own (optimal densification), the same sequence for all sets.
BANDS bands of ROWS bins name buckets. Sets of Jaccard 0.8 share no bucket with probability
(1 - 0.8^6)^42, about 3 in a million, and other pairs are confirmed or refused on their full sets.

Within a bucket, edges go from one centre, its smallest class, to the others: as many as the bucket
has members. Confirmed edges make components. The buckets of FIRST_BANDS bands come first, since copies
share most of their buckets, then all buckets. A bucket whose members are all in one component is
done, since more edges could not change anything. In the others the next centre is taken, against
members of other components. Once no more edges are left than a round of stars may have, one a member and band
(FINISH), every member is a centre: the edges left are looked at inside one join by sketches, BITS bits
of each bin, of which those count whose estimate is less than DEVIATIONS standard deviations below the
threshold (a chance of some 3 in 10 million to lose one), and by bitmaps that bound their
intersection. Those that pass are confirmed or refused like all others. So the edges of any round are
bounded by members and bands, and no group's pairs are all emitted.

Keys that many rows share are split: a class of many copies, a component of many classes and a node of many links by
shared.hot_join, a centre's full set by a copy of it for every STAR edges. Buckets' own rows are a few numbers
each, and adaptive execution splits the join of a hot one.

Cases: ids may be of any type that has an order; a text without words has an empty set, and is linked with nothing; one of fewer words than a
shingle is one shingle as a whole. Null ids come after all others. Rows that share id and text are
copies of which one is kept. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import drop_table, hot_join, ship, write_table
from .text import M1, hashes, mix, slices, windows, words

#: Bins of a signature (a power of two), bins in a band, bands.
BINS, ROWS, BANDS = 256, 6, 42
#: Bands whose buckets give the first edges; the others only see classes that these left apart.
FIRST_BANDS = 6
#: Edges left, for each member of a bucket, at which every member is a centre.
FINISH = BANDS
#: Edges of a centre that meet one copy of its set.
STAR = 256
#: Bits of each bin in a sketch, and standard deviations of its estimate by which a pair may look less similar than it must be.
BITS, DEVIATIONS = 4, 5
#: Bits of the bitmap of a set's hashes that bounds intersections (a power of two).
MARKS = 2048
#: Fixed probe sequences of the densification: for each bin an order of all bins.
PROBES = np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1).T.copy()
SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, letters A-Z lower-cased."""
    counts, codes, distinct = words(pc.ascii_lower(pc.fill_null(texts, "")))
    of_word = hashes(distinct)[codes] if len(distinct) else np.empty(0, np.uint64)
    h, owner, _ = windows(of_word, counts, k)
    ends = np.searchsorted(owner, np.arange(len(counts) + 1))
    starts = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            x = np.sort(h[ends[i] : ends[i + 1]])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            short = of_word[starts[i] : starts[i] + n]
            out.append(windows(short, np.array([n]), int(n))[0] ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set; sets are sorted and not empty."""
    sig, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, x in enumerate(sets):
        bins = (x >> SHIFT).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        sig[i, bins[first]], filled[i, bins[first]] = x[first], True
    row, bin_ = np.nonzero(~filled)
    for probe in PROBES:
        if not len(row):
            break
        source = probe[bin_]
        found = filled[row, source]
        sig[row[found], bin_[found]] = sig[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket's name for each set and band."""
    parts = sig[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS)
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for j in range(ROWS):
        h = mix(h * M1 + parts[:, :, j])
    return h


def sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each bin, bit plane by bit plane, as 64-bit words."""
    planes = [np.packbits(((sig >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1) for j in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def looks_alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sketches differ in no more bins than those of sets at the threshold may."""
    words = BINS // 64
    differ = F.lit(0)
    for w in range(words):
        any_plane = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        for j in range(1, BITS):
            any_plane = any_plane.bitwiseOR(F.get(a, F.lit(j * words + w)).bitwiseXOR(F.get(b, F.lit(j * words + w))))
        differ = differ + F.bit_count(any_plane)
    mean = BINS * (1 - percent / 100) * (1 - 0.5**BITS)
    return differ <= mean + DEVIATIONS * math.sqrt(mean * (1 - mean / BINS))


def may_link(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether two sets of n and m members can reach the threshold, by bitmaps of their hashes.

    A bit that only one set has stands for a member at least that the other lacks, so this never
    refuses a pair that links.
    """
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    inter = F.least(n - only(a, b), m - only(b, a))
    return 100 * inter >= percent * (n + m - inter)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            full = [i for i, x in enumerate(sets) if len(x)]
            sig = signatures([sets[i] for i in full])
            keys, marks = bands(sig).view(np.int64), sketches(sig)
            sizes = np.array([len(x) for x in sets], np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, x.shape[1], 0)))).astype(np.int32)), pa.array(x.reshape(-1)))
            digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            arrays = [*(batch.column(c) for c in ("uid", "id", "print")), pa.array(sizes), pa.array(digest, pa.binary()), lists(keys), lists(marks)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "id", "print", "n", "digest", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [x.view(np.int64) for x in shingle_sets(batch.column("text"), k)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            marks = np.zeros((len(sets), MARKS), np.uint8)
            for i, x in enumerate(sets):
                marks[i, x & (MARKS - 1)] = 1
            marks = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(marks, axis=1).reshape(-1).view(np.int64)), MARKS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets))), marks], ["cid", "members", "marks"])

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the smallest node that links (a, b) lead to. Labels of neighbours, then labels of labels, until none changes."""
    both = write_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"), F.count(F.lit(1)).alias("links")), name)
    n_links, n_nodes = both.count(), labels.count()
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"), "links")
        near = hot_join(both, of_b, "b", "links", n_links).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = write_table(labels.join(near, "node").select("node", "links", "label", F.least("label", "near").alias("next")), name)
        of_label = labels.select(F.col("node").alias("next"), F.col("label").alias("far")).join(stepped.groupBy("next").agg(F.count(F.lit(1)).alias("n")), "next")
        far = hot_join(stepped, write_table(of_label, f"{name}-far"), "next", "n", n_nodes)
        jumped = write_table(far.select("node", "links", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), name)
        moved = jumped.filter("moved").limit(1).count()
        drop_table(labels)
        drop_table(stepped)
        labels = jumped.drop("moved")
        labels._plainframe_path = jumped._plainframe_path
        if not moved:
            drop_table(both)
            return labels


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable), kept, print (xxhash64 of the text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = dict(rows.dtypes)["id"]
    signed = rows.select(F.monotonically_increasing_id().alias("uid"), "*").mapInArrow(_sign(shingle), f"uid long, id {kind}, print long, n long, digest binary, bands array<long>, sketch array<long>")
    signed = write_table(signed, "near-signed", even=False)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "uid")
    # One row for a class: copies meet in partial minima before the shuffle.
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies")).select("digest", "best", "copies", F.col("best.uid").alias("cid"))
    classes = write_table(classes, "near-classes")
    keyed = signed.join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi")
    keys = keyed.select(F.col("uid").alias("cid"), "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = write_table(keys.join(shared, "key").select("key", "band", "cid", "n"), "near-members")

    # The full sets of the classes that share a bucket, from the texts of one row each.
    needed = signed.join(members.select(F.col("cid").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("cid"), F.col("id").alias("id_"), F.col("print").alias("print_"))
    texts = rows.join(needed, (F.col("print") == F.col("print_")) & F.col("id").eqNullSafe(F.col("id_"))).select("cid", "text")
    sets = write_table(texts.mapInArrow(_sets(shingle), "cid long, members array<long>, marks array<long>"), "near-sets", even=False)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = write_table(pairs.select("a", "b").distinct(), "near-pairs")
        stars = write_table(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("edges")), "near-stars")
        copies = F.ceil(F.col("edges") / STAR).cast("int")
        dealt = hot_join(pairs, stars, "a", "edges", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("copy"))
        set_b = sets.select(F.col("cid").alias("b"), F.col("members").alias("set_b"))
        set_a = sets.join(stars, sets.cid == stars.a).select("a", F.col("members").alias("set_a"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
        both = dealt.join(set_b, "b").join(set_a, ["a", "copy"])
        both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("inter"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sum"))
        return both.filter(100 * F.col("inter") >= percent * (F.col("sum") - F.col("inter"))).select("a", "b").distinct()

    near_size = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    def apart(open_: DataFrame) -> DataFrame:
        """Members with the labels known by now, of buckets that hold several."""
        known = labels.select(F.col("node").alias("cid"), F.col("label").alias("new"))
        labelled = open_.join(known, "cid", "left").select("key", "cid", "n", F.coalesce("new", "cid").alias("label"))
        undone = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
        return write_table(labelled.join(undone, "key", "left_semi"), "near-open")

    def starred(open_: DataFrame) -> DataFrame:
        """Members of other components than their bucket's centre, which is its smallest member."""
        centre = open_.groupBy("key").agg(F.min(F.struct("cid", "n", "label")).alias("c"))
        return open_.join(centre, "key").filter((F.col("cid") > F.col("c.cid")))

    def star_pairs(stars: DataFrame) -> DataFrame:
        near = (F.col("label") != F.col("c.label")) & near_size(F.col("n"), F.col("c.n"))
        return stars.filter(near).select(F.col("c.cid").alias("a"), F.col("cid").alias("b"))

    def last_pairs(open_: DataFrame) -> DataFrame:
        """Pairs of different components that look alike, every member being a centre."""
        marked = signed.select(F.col("uid").alias("cid"), "sketch").join(sets.select("cid", "marks"), "cid").join(open_.select("cid").distinct(), "cid", "left_semi")
        b = open_.join(marked, "cid")
        a = b.select("key", *(F.col(c).alias(f"{c}_a") for c in ("cid", "n", "label", "sketch", "marks")))
        apart_ = (F.col("label") != F.col("label_a")) & (F.col("cid") > F.col("cid_a")) & near_size(F.col("n"), F.col("n_a"))
        alike = looks_alike(F.col("sketch"), F.col("sketch_a"), percent) & may_link(F.col("n"), F.col("n_a"), F.col("marks"), F.col("marks_a"), percent)
        return b.join(a, "key").filter(apart_ & alike).select(F.col("cid_a").alias("a"), F.col("cid").alias("b"))

    links = labels = None
    many = FINISH * members.count()
    open_ = members.filter(F.col("band") < FIRST_BANDS).select("key", "cid", "n", F.col("cid").alias("label"))
    first = True
    while True:
        stars = starred(open_)
        sides = open_.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
        left = (sides.agg(F.sum("pairs").alias("pairs")).first().pairs or 0) / 2
        last = not first and left <= many
        if left:
            found = confirmed(last_pairs(open_) if last else star_pairs(stars))
            links = write_table(found if links is None else links.union(found), "near-links")
            labels = components(links)
        if first and labels is not None:
            open_ = apart(members)
        elif first:
            open_ = members.select("key", "cid", "n", F.col("cid").alias("label"))
        elif last:
            break
        else:
            # A centre was tried against all the others of its bucket, so it leaves.
            open_ = apart(stars.select("key", "cid", "n"))
        first = False

    if labels is None:
        best = classes.select("digest", "best", "copies")
    else:
        grouped = write_table(classes.join(labels, classes.cid == labels.node, "left").select("digest", "best", "copies", F.coalesce("label", "cid").alias("label")), "near-grouped")
        tops = write_table(grouped.groupBy("label").agg(F.min("best").alias("top"), F.count(F.lit(1)).alias("classes")), "near-tops")
        best = write_table(hot_join(grouped, tops, "label", "classes", classes.count()).select("digest", F.col("top").alias("best"), "copies"), "near-best")
    out = hot_join(signed.select("uid", "id", "n", "digest", "print"), best, "digest", "copies", signed.filter("n > 0").count(), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("uid") == F.col("best.uid"))).alias("kept"),
        F.col("print"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of docs that near_dedup keeps: one of each component."""
    kept = near_dedup(docs, id_col=id_col, text_col=text_col, **how).filter("kept")
    key = lambda c: [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    kept = kept.select(key(id_col)[0].alias("_pf_null"), key(id_col)[1].alias("_pf_id"), F.col("print").alias("_pf_print")).distinct()
    keyed = docs.withColumns({"_pf_null": key(id_col)[0], "_pf_id": key(id_col)[1], "_pf_print": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    # Rows that share id and text are copies of which one stays; texts without words are no copies of each other.
    same = Window.partitionBy("_pf_null", "_pf_id", "_pf_print").orderBy(F.lit(1))
    out = keyed.join(kept, ["_pf_null", "_pf_id", "_pf_print"], "left_semi").withColumn("_pf_k", F.row_number().over(same))
    return out.filter((F.col("_pf_k") == 1) | (F.length(F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\u000b\f\r", "")) == 0)).select(*(f"`{c}`" for c in docs.columns))

"""Toxicity by the nearest labelled examples, found by exact TF-IDF cosine over block-max inverted indexes.

Terms are a text's lower-cased runs of letters and digits, whole, and their first PREFIXES letters,
so that forms of one stem meet. Every term of the examples is in the index, whatever its number. A
text's weights are (1 + log count) x idf x relevance^2, normalised to length one. idf is over all
documents, counted in one pass. Relevance is the relevance frequency of supervised term weighting,
log2(2 + a / c): a is the share of the label's examples that have the term, c that of the others,
one example of them at least. Plain TF-IDF found 60 % of held-out toxic rows where invented words outweigh
everything; this weighting finds all but a few (README). A term that no example has is shared with none and
has no weight.

The examples are at most POSITIVE + NEGATIVE labelled rows, those whose id hashes lowest; this
bounded sample is the fitted classifier, and negatives get the weight that restores their share.
Examples of equal weights are one entry, which votes with the weights of all of them. Entries lie in
blocks of BLOCK, like with like. For each term and each block that has it the index has the postings
and their highest weight. The lists of terms that one in HEAD entries has are a dense matrix, by which a
batch of queries is multiplied: the NEAREST-th best of these partial cosines is a floor for the
final one. A block's bound is its best partial cosine and the sum of the query's other weights times
their highest there; only blocks whose bound reaches the floor are searched. Entries that come
within rounding of the NEAREST best have their cosines taken anew in full precision, so neighbours are exact.
Of entries equally near (to PLACES decimals), the first in the index counts; their order goes by
weights alone, never by label or id.

Neighbours vote by similarity / (1.05 - similarity). Votes become probabilities by isotonic
regression over the examples' own votes, each without itself. The neighbours are the evidence.

Scoring is one map over the scan, with no shuffle; the index is broadcast and its size bounded by
the sample's rows. Texts of equal weights are looked up once in a slice.

Cases: a null or empty text, or one without a known term, scores as the share of the label among
examples; without examples of both labels every score is that share, 0 without any. Labels that are
null are not used; of rows that share a labelled id, one whose text hashes lowest is the example, and so
for labels that repeat an id (the highest label counts). Repeated rows and null ids give a row each. Ids may
be of any type. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import give_back, ship
from .text import expand, release, slices

#: Labelled rows the classifier is fitted on at most, by label.
POSITIVE, NEGATIVE = 2_000, 4_000
#: Text bytes handled at a time.
SLICE_BYTES = 4_000_000
#: Letters of a word's beginnings that are terms beside the word.
PREFIXES = (4, 5)
#: Neighbours that vote, entries in a block, neighbours given as evidence, decimals of similarities.
NEAREST, BLOCK, EVIDENCE, PLACES = 15, 256, 3, 6
#: Share of the entries (one in so many) from which a term's list is dense, queries multiplied at a time, and what rounding may hide.
HEAD, BATCH, SLACK = 32, 256, 1e-5
#: Bytes of the dense lists at most; with longer texts the most frequent terms are dense. Neighbours are the same whatever is.
HEAD_BYTES = 64_000_000


def word_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, the code of each word, and for each kind of term the codes' places and the names of the distinct ones."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    ends = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
    coded = flat.filter(real).dictionary_encode()
    distinct, kinds = coded.dictionary, []
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    for k in (0, *PREFIXES):
        cut = distinct if not k else pc.utf8_slice_codeunits(distinct, 0, k)
        of = cut.dictionary_encode()
        names = np.fromiter((xxhash.xxh3_64_intdigest(x, k) for x in of.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(of.dictionary))
        place = of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds.append((np.where(length > k, place, -1), names))
    return np.diff(ends[offsets]), coded.indices.to_numpy(zero_copy_only=False), kinds


def count_terms(texts: pa.Array, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all texts: the names (sorted; given ones, or all that occur), then for each text's cut terms, by place among the names, and their counts."""
    counts, codes, kinds = word_terms(texts)
    if names is None:
        names = np.unique(np.concatenate([x for _, x in kinds]))
    table = np.full((len(kinds[0][0]), len(kinds)), -1, np.int64)
    if len(names):
        for j, (place, of) in enumerate(kinds):
            at = np.minimum(np.searchsorted(names, of), len(names) - 1)
            known = np.where(names[at] == of, at, -1)
            table[:, j] = np.where(place >= 0, known[place] if len(known) else -1, -1)
    many = max(1, len(names))
    kind = np.int32 if many * len(counts) < 2**31 else np.int64  # short keys sort faster
    doc = np.repeat(np.arange(len(counts), dtype=kind) * kind(many), counts)
    term = table.astype(kind)[codes]
    key = (doc[:, None] + term)[term >= 0]
    key, n = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(counts) + 1) * many)
    return names, cuts, (key % many).astype(np.int64), n


@dataclass
class Index:
    """The fitted classifier: vocabulary, examples as an inverted index in blocks, calibration."""

    names: np.ndarray
    weight: np.ndarray
    prior: float
    ids: list = field(default_factory=list)
    share: np.ndarray = field(default_factory=lambda: np.empty(0))
    mass: np.ndarray = field(default_factory=lambda: np.empty(0))
    ends: np.ndarray | None = None
    terms: np.ndarray | None = None
    values: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights, of length one."""
        if not len(terms):
            return terms, np.empty(0)
        weight = (1 + np.log(counts)) * self.weight[terms]
        return terms, weight / math.sqrt(float(weight @ weight))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The entries' vectors one after another."""
        self.ends = np.cumsum([len(t) for t, _ in vectors]).astype(np.int64)
        self.terms = np.concatenate([t.astype(np.int32) for t, _ in vectors])
        self.values = np.concatenate([w.astype(np.float32) for _, w in vectors])

    def invert(self) -> None:
        """The dense lists of frequent terms, and for the others a list for each term and block that has it; done once in each process."""
        n, n_terms = len(self.ids), len(self.names)
        df = np.bincount(self.terms, minlength=n_terms)
        frequent = np.flatnonzero(df * HEAD >= n)
        frequent = np.sort(frequent[np.argsort(-df[frequent], kind="stable")[: HEAD_BYTES // (4 * n)]])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.head = np.zeros((n, len(frequent)), np.float32)
        for row, (terms, weights) in zip(self.head, self.vectors()):
            c = self.column[terms]
            row[c[c >= 0]] = weights[c >= 0]
        at = np.flatnonzero(self.column[self.terms] < 0)
        at = at[np.argsort(self.terms[at], kind="stable")]
        term, self.places, self.weights = self.terms[at], np.searchsorted(self.ends, at, side="right"), self.values[at]
        block = self.places // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0))))[: len(term)]
        self.blocks, self.starts = block[first], np.append(first, len(term))
        self.highest = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0, np.float32)
        self.lists = np.searchsorted(term[first], np.arange(n_terms + 1))

    def vectors(self, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries' terms and weights."""
        starts = np.concatenate(([0], self.ends))
        for a, b in zip(starts[first:last].tolist(), self.ends[first:last].tolist()):
            yield self.terms[a:b], self.values[a:b]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], most: int = NEAREST) -> Iterator[list[tuple[float, int]]]:
        """For each query the nearest entries: similarity and place, the nearest first, the first in the index of equals."""
        if "head" not in self.__dict__:
            self.invert()
        n = len(self.ids)
        block_starts = np.arange(0, n, BLOCK)
        for a in range(0, len(vectors), BATCH):
            part = vectors[a : a + BATCH]
            q = np.zeros((len(part), self.head.shape[1]))
            for row, (terms, weights) in zip(q, part):
                c = self.column[terms]
                row[c[c >= 0]] = weights[c >= 0]
            partial = q.astype(np.float32) @ self.head.T
            best = np.maximum.reduceat(partial, block_starts, axis=1)
            floor = np.partition(partial, n - most, axis=1)[:, n - most] if n > most else np.zeros(len(part))
            for (terms, weights), row, sims, top, least in zip(part, q, partial, best, floor):
                rare = self.column[terms] < 0
                many = self.lists[terms[rare] + 1] - self.lists[terms[rare]]
                at, w = expand(self.lists[terms[rare]], many), np.repeat(weights[rare], many)
                block = self.blocks[at]
                visit = np.bincount(block, w * self.highest[at], minlength=len(top)) + top + SLACK >= least
                mine = visit[block]
                e = at[mine]
                length = self.starts[e + 1] - self.starts[e]
                here = expand(self.starts[e], length)
                rest = np.bincount(self.places[here], np.repeat(w[mine], length) * self.weights[here], minlength=n)
                sims = sims + rest
                least = np.partition(sims, n - most)[n - most] if n > most else 0.0
                found = np.flatnonzero((sims >= least - SLACK) & (sims > 0))
                s = np.round(self.head[found].astype(np.float64) @ row + rest[found], PLACES)
                order = np.lexsort((found, -s))[:most]
                yield [x for x in zip(s[order].tolist(), found[order].tolist()) if x[0] > 0]

    def vote(self, near: list[tuple[float, int]], without: tuple[int, float, float] | None = None) -> float:
        """The label's share among neighbours. without: an entry, and mass and share of the example there that has no vote."""
        if not near:
            return self.prior
        s, p = np.minimum([x for x, _ in near], 1.0), np.array([x for _, x in near])
        mass, yes = self.mass[p], self.mass[p] * self.share[p]
        if without:
            own = p == without[0]
            mass, yes = mass - own * without[1], yes - own * without[1] * without[2]
        w = s / (1.05 - s)
        total = float(w @ mass)
        return float(w @ yes) / total if total > 1e-12 else self.prior

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, masses: np.ndarray) -> None:
        """Isotonic regression of labels on votes, as the knots of a rising line."""
        order = np.lexsort((labels, votes))
        pools: list[list[float]] = []
        for v, y, w in zip(votes[order], labels[order], masses[order]):
            pools.append([v * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        # A little of the prior keeps pools of few examples off 0 and 1.
        self.knots = np.array([v / w for v, _, w in pools]), np.array([(y + self.prior) / (w + 1) for _, y, w in pools])

    def score(self, vote: float) -> float:
        """Mostly the calibrated vote; the vote itself orders what one pool holds."""
        if self.knots is None:
            return self.prior
        return min(1.0, max(0.0, 0.95 * float(np.interp(vote, *self.knots)) + 0.05 * vote))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's terms by name, and their counts, as bytes."""
    for batch in slices(batches, "text", SLICE_BYTES):
        names, cuts, term, n = count_terms(batch.column("text"))
        parts = list(zip(cuts[:-1], cuts[1:]))
        columns = [batch.column("id"), batch.column("label"), pa.array([names[term[a:b]].tobytes() for a, b in parts], pa.binary()), pa.array([n[a:b].astype(np.int32).tobytes() for a, b in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "terms", "counts"])


def _documents(shared):
    """Documents that have each term: a row of packed counts for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = shared.value, 0
        df = np.zeros(len(names), np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            df += np.bincount(count_terms(batch.column("text"), names)[2], minlength=len(names))
            rows += batch.num_rows
        seen = np.flatnonzero(df)
        for i in range(0, max(1, len(seen)), 10_000):
            part = seen[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(part, -1).astype(np.int32)), pa.array(np.append(df[part], rows if not i else 0))], ["term", "df"])

    return run


def relevance(with_label: np.ndarray, without: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Relevance frequency of terms that so many examples of either side have."""
    return np.log2(2 + with_label / positives * negatives / np.maximum(1, without))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn_from=None) -> Index:
    """The classifier. learn_from: a Column over labels, true where a row may be learned from."""
    spark = ship(docs.sparkSession)
    usable = labels.filter(learn_from) if learn_from is not None else labels
    usable = usable.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().filter("label IN (0, 1)").groupBy("id_").agg(F.max("label").alias("label"))
    total = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    lowest = lambda y, n: usable.filter(F.col("label") == y).orderBy(F.xxhash64("id_"), "id_").limit(n)
    some = lowest(1, POSITIVE).union(lowest(0, NEGATIVE))
    # Bounded by POSITIVE + NEGATIVE rows of two numbers, so every task can have them.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), F.col("id") == F.col("id_"))
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(_terms, f"id {dict(rows.dtypes)['id']}, label int, terms binary, counts binary").toArrow()  # bounded by the sample
    label, ids = np.array(got.column("label").to_pylist(), int), got.column("id").to_pylist()
    p, n_all = int(label.sum()), len(label)
    if not p or p == n_all:
        return Index(np.empty(0, np.uint64), np.empty(0), prior)

    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("terms")]
    names = np.unique(np.concatenate(raw))
    terms = [np.searchsorted(names, x).astype(np.int32) for x in raw]
    counts = [np.frombuffer(x.as_py(), np.int32) for x in got.column("counts")]
    del got, raw
    # Rows of a task and term, summed; the terms are bounded by the sample.
    shared = spark.sparkContext.broadcast(names)
    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_documents(shared), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    shared.destroy()
    df, term = np.zeros(len(names) + 1), counted["term"].to_numpy()
    df[np.where(term < 0, len(names), term)] = counted["df"].to_numpy()
    having = lambda y: np.bincount(np.concatenate([t for t, x in zip(terms, label) if x == y]), minlength=len(names))
    labelled, others = having(1), having(0)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    index = Index(names, idf * relevance(labelled, others, p, n_all - p) ** 2, prior)

    # Examples of equal weights are one entry; like lies with like, by the heaviest of the terms that many have.
    same: dict[bytes, list[int]] = {}
    for i, (t, n) in enumerate(zip(terms, counts)):
        same.setdefault(xxhash.xxh3_128_digest(t.tobytes() + n.tobytes()), []).append(i)
    common = (labelled + others) * 30 >= n_all

    def like(x):
        (t, w), key, _ = x
        t, w = t[common[t]], w[common[t]]
        return (int(t[w.argmax()]), -float(w.max()), key) if len(t) else (-1, 0.0, key)

    def entries():
        for key, rows in same.items():
            t, w = index.vector(terms[rows[0]], counts[rows[0]])
            yield (t, w.astype(np.float32)), key, rows

    found = sorted(entries(), key=like)
    vote_of = {1: total.get(1, p) / p, 0: total.get(0, 1) / (n_all - p)}
    one = {y: v / min(vote_of.values()) for y, v in vote_of.items()}  # an example's weight, by label
    mass = np.array([one[y] for y in label.tolist()])
    index.mass = np.array([mass[rows].sum() for _, _, rows in found])
    index.share = np.array([(mass[rows] * label[rows]).sum() / mass[rows].sum() for _, _, rows in found])
    index.ids = [min((ids[i] for i in rows), key=str) for _, _, rows in found]
    index.build([v for v, _, _ in found])
    del terms, counts, same, found
    shared, n = spark.sparkContext.broadcast(index), len(index.ids)
    voted = spark.range(0, n, 1, max(1, n // 500)).mapInArrow(_votes(shared, one), "vote double, label int, mass double").toArrow()  # bounded by the sample
    shared.destroy()
    index.calibrate(*(voted.column(c).to_numpy().astype(float) for c in ("vote", "label", "mass")))
    give_back(spark)
    return index


def _votes(shared, one: dict[int, float]):
    """The examples' votes, each without itself: a row for each entry and label there. one: an example's weight, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            places, out = batch.column("id").to_pylist(), []
            for i, near in zip(places, index.nearest([v for k in places for v in index.vectors(k, k + 1)], NEAREST + 1)):
                yes = float(index.mass[i] * index.share[i])
                for y, mass in ((1, yes), (0, float(index.mass[i]) - yes)):
                    if mass > one[y] / 2:
                        out.append((index.vote(near, (i, one[y], y)), y, mass))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.float64(), pa.int32(), pa.float64()))], ["vote", "label", "mass"])
        index.__dict__ = index.__getstate__()
        release()

    return run


class Lookup:
    """Scores and nearest examples of texts; equal terms are looked up once for each call."""

    def __init__(self, index: Index):
        self.index = index

    def __call__(self, texts: pa.Array) -> list[tuple[float, list[tuple[float, int]]]]:
        index, known = self.index, {}
        _, cuts, term, n = count_terms(texts, index.names)
        keys = [(term[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for key, a, b in zip(keys, cuts[:-1].tolist(), cuts[1:].tolist()):
            if key not in known:
                known[key] = index.vector(term[a:b], n[a:b])
        if index.ends is None:
            return [(index.score(index.prior), [])] * len(keys)
        for key, near in zip(list(known), index.nearest(list(known.values()))):
            known[key] = index.score(index.vote(near)), near
        return [known[key] for key in keys]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        look = Lookup(index)
        for batch in slices(batches, "text", SLICE_BYTES):
            found = look(batch.column("text"))
            near = [x[:EVIDENCE] for _, x in found]
            place = np.array([p for x in near for _, p in x], np.int64)
            ids = pa.array(index.ids, batch.column("id").type).take(pa.array(place)) if len(index.ids) else pa.nulls(0, batch.column("id").type)
            label = pa.array((index.share[place] >= 0.5).astype(np.int32)) if len(place) else pa.nulls(0, pa.int32())
            why = pa.StructArray.from_arrays([ids, pa.array([s for x in near for s, _ in x], pa.float64()), label], ["id", "similarity", "label"])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in near]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), why)], ["id", "score", "evidence"])

    return run


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, score, predicted, evidence (the nearest examples: id, similarity, label)."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(_score(spark.sparkContext.broadcast(index)), f"id {kind}, score double, evidence array<struct<id:{kind},similarity:double,label:int>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _keep(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value)
        for batch in slices(batches, text_col, SLICE_BYTES):
            yield batch.filter(pa.array([score < 0.5 or not near for score, near in look(batch.column(text_col))], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose score is under 0.5, or that no neighbour speaks against."""
    spark = ship(docs.sparkSession)
    return docs.mapInArrow(_keep(spark.sparkContext.broadcast(index), text_col), docs.schema)

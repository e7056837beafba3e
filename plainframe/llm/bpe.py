"""Byte-level BPE by DuckDB: recursive queries encode, ordered aggregation decodes, both per slice of a partition.

Words are the matches of the split pattern. The distinct words of a slice that neither the rank
table nor the worker's cache holds become token-position rows, a row per byte. Each step of the
recursive query joins neighbouring tokens with the merge table and contracts every word's leftmost
pair of minimum rank, until no word has a pair left. A word of n bytes makes n^2 / 2 rows at most
over all steps, and a query takes words while these sums stay under QUERY_ROWS, which bounds its memory.

Words longer than LONG_BYTES are cut where two neighbouring bytes stand side by side in no token, so
that no contraction could cross; the pieces go through the same query. A piece that is still longer
would need as many steps as it has bytes, each over all of them, so a heap does the same
contractions on it, in the same order.

Decoding joins a slice's ids with the tokens' bytes and aggregates them by text in order of place,
DECODE_TOKENS at a time; a longer text is decoded in parts.

Cases: a null or empty text has no ids and decodes to nothing; repeated rows and null ids give a
row each; ids may be of any type; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import ship
from .text import slices

#: Longest piece, in bytes, that the recursive query takes, and rows over all steps of one query at most.
LONG_BYTES, QUERY_ROWS = 256, 2_500_000
#: Stands for the token after a word's last one; no token has it.
NONE = 1 << 30
#: Words a worker's cache holds beside those of the slice, bytes of the longest it keeps, text bytes of a slice, ids decoded at a time.
CACHE_WORDS, CACHE_BYTES, SLICE_BYTES, DECODE_TOKENS = 500_000, 256, 12_000_000, 1_000_000

#: A row knows its token, the place and token after it (j, after), and the rank r of that pair. A step takes each word's lowest
#: (r, i), drops the row at j, and gives its neighbours to the pair's row.
CONTRACT = """
WITH RECURSIVE state AS (
  SELECT 0 AS step, x.w, x.i, x.j, x.tok, x.after, g.r
  FROM seed x LEFT JOIN merges g ON g.pair = x.tok::BIGINT * 4294967296 + x.after
  UNION ALL
  SELECT x.step, x.w, x.i, x.j, x.tok, x.after, g.r
  FROM (
    SELECT s.step + 1 AS step, s.w, s.i,
      CASE WHEN s.i = c.i THEN c.j ELSE s.j END AS j,
      CASE WHEN s.i = c.i THEN c.r ELSE s.tok END AS tok,
      CASE WHEN s.i = c.i THEN c.after WHEN s.j = c.i THEN c.r ELSE s.after END AS after
    FROM state s JOIN (
      SELECT k.w, (k.low >> 32)::INT AS r, ((k.low >> 16) & 65535)::INT AS i, gone.i AS gone, gone.j, gone.after
      FROM (SELECT w, min(r::BIGINT * 4294967296 + i * 65536 + j) AS low FROM state WHERE r IS NOT NULL GROUP BY w) k
      JOIN state gone ON gone.w = k.w AND gone.i = (k.low & 65535)
    ) c ON s.w = c.w
    WHERE s.i <> c.gone
  ) x LEFT JOIN merges g ON g.pair = x.tok::BIGINT * 4294967296 + x.after
), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT s.w, list(s.tok ORDER BY s.i) AS ids FROM state s JOIN last USING (w, step) GROUP BY s.w ORDER BY s.w
"""
DECODE = "SELECT part, list(bytes ORDER BY i) AS bytes FROM ids JOIN tokens USING (id) GROUP BY part ORDER BY part"

_worker: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The ranks, the merge table in an in-memory DuckDB, and the cache of one process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks, self.words, self.cache = read_ranks(path), regex.compile(pattern), {}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.pairs, inner = {}, np.zeros(1 << 16, bool)
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                inner[token[k - 1] << 8 | token[k]] = True
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = r
        self.inner = inner
        self.fill("merges", pa.table({"pair": pa.array(self.pairs, pa.int64()), "r": pa.array(self.pairs.values(), pa.int32())}))
        self.fill("tokens", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary())}))

    def fill(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows_", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_")
        self.con.unregister("rows_")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, packed."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        after = np.append(tok[1:], 0).astype(np.int32)
        after[ends - 1] = NONE
        i = np.arange(len(tok)) - np.repeat(ends - sizes, sizes)
        seed = {"w": np.repeat(np.arange(len(words)), sizes), "i": i, "j": i + 1, "tok": tok, "after": after}
        self.con.register("seed", pa.table({k: pa.array(v, pa.int32()) for k, v in seed.items()}))
        out = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("seed")
        ids = out.column("ids").combine_chunks()
        ends, data = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def cut(self, word: bytes) -> list[bytes]:
        """A long word's pieces: no token holds the two bytes beside a cut."""
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        ends = np.flatnonzero(~self.inner[b[:-1] << 8 | b[1:]]) + 1
        return [word[i:j] for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(word)])]

    def contract_long(self, word: bytes) -> bytes:
        """The same contractions, from a heap: the pair of minimum rank first, of those the leftmost."""
        n, pairs = len(word), self.pairs
        tok = array.array("q", self.of_byte[np.frombuffer(word, np.uint8)].tolist())
        after, before = array.array("q", range(1, n + 1)), array.array("q", range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := pairs.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & ((1 << 40) - 1)
            j = after[i]
            if tok[i] < 0 or j >= n or pairs.get(tok[i] << 32 | tok[j]) != r:
                continue
            tok[i], tok[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := pairs.get(tok[a] << 32 | tok[after[a]])) is not None:
                    heapq.heappush(heap, x << 40 | a)
        return np.array([x for x in tok if x >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, packed."""
        out, pieces, of = {}, {}, self.ranks.get
        todo: list[tuple[bytes, str | None]] = []
        for word in words:
            raw = word.encode()
            if (r := of(raw)) is not None:
                out[word] = r.to_bytes(4, "little")
            elif len(raw) <= LONG_BYTES:
                todo.append((raw, word))
            else:
                pieces[word] = self.cut(raw)
        known = {}
        for piece in {x for xs in pieces.values() for x in xs}:
            if len(piece) > LONG_BYTES:
                known[piece] = self.contract_long(piece)
            else:
                todo.append((piece, None))
        sizes = np.fromiter((len(raw) for raw, _ in todo), np.int64, len(todo))
        part = np.cumsum(sizes * (sizes + 1) // 2) // QUERY_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(todo)]
        for a, b in zip(cuts, cuts[1:]):
            for (raw, word), ids in zip(todo[a:b], self.contract([raw for raw, _ in todo[a:b]]) if b > a else ()):
                if word is None:
                    known[raw] = ids
                else:
                    out[word] = ids
        out |= ((word, b"".join(map(known.__getitem__, xs))) for word, xs in pieces.items())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        split = [self.words.findall(x) for x in texts]
        needed = set().union(*split)
        fresh = {x for x in needed if x not in self.cache}
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache = {x: self.cache[x] for x in needed if x in self.cache}  # what this slice shares with those before is frequent
        own = {}
        if fresh:
            found = self.learn(fresh)
            own = {x: ids for x, ids in found.items() if len(x) > CACHE_BYTES}
            self.cache |= found if not own else {x: ids for x, ids in found.items() if x not in own}
        if own:
            return [b"".join(own[w] if w in own else self.cache[w] for w in x) for x in split]
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's packed ids."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        text = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        out: list[list[bytes]] = [[] for _ in ids]
        for a in range(0, len(flat), DECODE_TOKENS):
            part = pa.table({"part": text[a : a + DECODE_TOKENS], "i": np.arange(min(DECODE_TOKENS, len(flat) - a)), "id": flat[a : a + DECODE_TOKENS]})
            self.con.register("ids", part)
            got = self.con.sql(DECODE).to_arrow_table().combine_chunks()
            self.con.unregister("ids")
            for k, lists in zip(got.column("part").to_pylist(), got.column("bytes").chunks[0]):
                at = lists.values  # an array of bytes; its values lie side by side
                ends, data = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1], at.buffers()[2]
                out[k].append(data[int(ends[0]) : int(ends[-1])].to_pybytes())
        return [b"".join(x) for x in out]


def codec(path: str, pattern: str) -> Codec:
    if _worker.get("key") != (path, pattern):
        _worker.update(key=(path, pattern), codec=Codec(path, pattern))
    return _worker["codec"]


def _run(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = tool.encode([x or "" for x in batch.column("text").to_pylist()])
            back = tool.decode(ids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids (binary, little-endian unsigned 32-bit), decoded (bytes)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_run(ranks, pattern), f"id {dict(rows.dtypes)['id']}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

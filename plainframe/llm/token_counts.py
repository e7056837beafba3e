"""Token counts by a map-side lookup in two tiers.

A text is cut into pre-tokens, an optional single space and a run of other characters, or white
space; the tokenizer never merges across such a cut. Tier one is a broadcast table of the lengths
of frequent pre-tokens, learned from a bounded sample of rows (SAMPLE_ROWS, TABLE_ENTRIES): it only
makes the lookup faster, whatever it holds the counts are the same. Tier two is a cache in each
worker, filled by encoding the misses with the tokenizer. No pre-token is ever shuffled.

A text that holds the string of a special token goes to the tokenizer whole, since it is cut there.

Cases: ids may be of any type; a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids give a row each;
other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import ship
from .text import slices

#: Rows at most, on average, that the frequent table is learned from, and pre-tokens it holds.
SAMPLE_ROWS, TABLE_ENTRIES, TABLE_CHARS = 2_000, 50_000, 64
#: Pre-tokens a worker's cache holds beside those of a slice, the longest one it keeps, and text bytes of a slice.
CACHE_ENTRIES, CACHE_CHARS, SLICE_BYTES = 500_000, 64, 6_000_000
#: The code points of Unicode's White_Space, by which the tokenizers split.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

_worker: dict = {}


def load(path: str) -> dict:
    """The tokenizer of this process, its special strings and its cache; path ends in .json or .model."""
    if _worker.get("path") != path:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _worker.update(encode=lambda xs: [len(x) for x in model.encode(xs, num_threads=1)], whole=True, special=None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            strings = [x["content"] for x in spec["added_tokens"]]
            by_bytes = (spec.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec.get("normalizer")
            model.no_truncation()
            model.no_padding()
            _worker.update(encode=lambda xs: [len(x) for x in model.encode_batch_fast(xs, add_special_tokens=False)], whole=not by_bytes, special=re.compile("|".join(map(re.escape, strings))) if strings else None)
        _worker.update(path=path, cache={}, frequent=None)
    return _worker


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(x for x in PRETOKEN.findall(text or "") if len(x) <= TABLE_CHARS)
        if len(counts) > 4 * TABLE_ENTRIES:
            counts = Counter(dict(counts.most_common(TABLE_ENTRIES)))
    top = counts.most_common(TABLE_ENTRIES)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The frequent table: TABLE_ENTRIES pre-tokens at most, out of about SAMPLE_ROWS rows."""
    n = docs.count()
    if load(path)["whole"]:
        return {}
    some = docs.select("text").sample(fraction=min(1.0, SAMPLE_ROWS / max(n, 1)), seed=1)
    counts: Counter = Counter()
    for row in some.mapInArrow(_frequent, "piece string, n long").toLocalIterator():  # bounded by the sample, whatever the tasks
        counts[row.piece] += row.n
    pieces = sorted(x for x, _ in counts.most_common(TABLE_ENTRIES))
    return dict(zip(pieces, load(path)["encode"](pieces))) if pieces else {}


def _count(path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(path)
        encode, special = tool["encode"], tool["special"]
        if tool["frequent"] != table.value.get("key"):
            tool["table"] = dict(zip(table.value["pieces"].to_pylist(), table.value["lengths"].tolist()))
            tool["cache"], tool["frequent"] = dict(tool["table"]), table.value["key"]
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            if tool["whole"]:
                counts = encode(texts)
            else:
                whole = [bool(special and special.search(x)) for x in texts]
                split = [() if w else PRETOKEN.findall(x) for x, w in zip(texts, whole)]
                get = _lengths(tool, set().union(*split)).__getitem__
                counts = [encode([x])[0] if w else sum(map(get, xs)) for x, w, xs in zip(texts, whole, split)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _lengths(tool: dict, needed: set[str]) -> dict[str, int]:
    """The lengths of a slice's pre-tokens, and more: the worker's cache, or a part of it beside pieces too long to keep."""
    misses = [x for x in needed if x not in tool["cache"]]
    if len(tool["cache"]) + len(misses) > CACHE_ENTRIES + len(tool["table"]):
        # What this slice shares with those before it is frequent.
        tool["cache"] = tool["table"] | {x: tool["cache"][x] for x in needed if x in tool["cache"]}
    cache = tool["cache"]
    found = dict(zip(misses, tool["encode"](misses)))
    long = {x: n for x, n in found.items() if len(x) > CACHE_CHARS}
    if not long:
        cache.update(found)
        return cache
    cache.update((x, n) for x, n in found.items() if x not in long)
    return {x: long[x] if x in long else cache[x] for x in needed}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes (UTF-8), n_tokens, over_limit. tokenizer: a file's path."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lengths = frequent_lengths(rows, tokenizer)
    # Two arrays, the strings side by side in one buffer; each worker makes its lookup of them.
    table = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "pieces": pa.array(lengths, pa.string()), "lengths": np.fromiter(lengths.values(), np.int32, len(lengths))})
    out = rows.mapInArrow(_count(tokenizer, table), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

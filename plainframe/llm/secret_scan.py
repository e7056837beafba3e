"""Secret scans judged by corpus-wide ownership frequency.

Every text is searched for the base kinds (assign, access, hex) and for further kinds: whole private
keys, JSON web tokens, credentials in URLs, and opaque tokens of mixed characters. Of each match
the secret's own value is hashed, and for every value the corpus says in how many owners and
repositories it stands. A value in WIDE_OWNERS owners or WIDE_REPOS repositories or more is an
example that people copy; one that few own and whose characters look random is taken to be live.
Base matches are always reported, further kinds only where they are live.

The counts are summed by value, owner and repository, then by value and owner, then by value, with partial sums on the
map side, so a value in a third of all rows costs a row per task. Values that hold more than a
thousandth of all matches are few, and their counts go to every task, so that no task gets all matches of one.
Only matches are ever shuffled.

Cases: a null text counts as empty; null owners and repositories count as one of their own;
repeated rows and null ids give a row each; ids may be of any type; other columns are never read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import hot_join, ship, write_table
from .text import slices

#: A value that stands in as many owners or repositories is an example.
WIDE_OWNERS, WIDE_REPOS = 3, 20
#: Live spans and texts that have them that are broadcast at most, some 60 bytes each; beyond, texts and spans are joined by id.
BROADCAST_SPANS = 200_000
#: Bits of entropy a character that a live-looking value has at least.
LIVE_BITS = 2.5
#: The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
FURTHER = {
    "pem": re.compile(
        r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
        r"(?:((?:(?!-----).)*)-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"  # up to its END, or else headers and what lines are base64
        r"|((?:(?:\s|\\[rn])*[A-Z][A-Za-z-]+: [^\n\\]*)*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=]))*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]+={1,2}(?![A-Za-z0-9+/=]))?))",
        re.S,
    ),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "url": re.compile(r"://[^\s/:@]+:([^\s/:@]{8,})@"),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"),
}
KINDS = [*BASE, *FURTHER]
_HINT = re.compile(r"pass|secret|token|api", re.I)
_DIGIT = re.compile(r"[0-9]")
#: White space in a key, also as escapes.
_BREAK = re.compile(r"\s|\\[rn]")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base matches and further ones: start, kind's place, end, value."""
    base = []
    if _HINT.search(text):
        base += [(m.start(), 0, m.end(), m[2]) for m in BASE["assign"].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), m[0]) for m in BASE["access"].finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end(), m[0]) for m in BASE["hex"].finditer(text)]
    more = []
    if "PRIVATE KEY" in text:
        more += [(m.start(), 3, m.end(), _BREAK.sub("", m[1] or m[2] or "") or m[0]) for m in FURTHER["pem"].finditer(text)]
    if "eyJ" in text:
        more += [(m.start(), 4, m.end(), m[0]) for m in FURTHER["jwt"].finditer(text)]
    if "://" in text and "@" in text:
        more += [(m.start(1), 5, m.end(1), m[1]) for m in FURTHER["url"].finditer(text)]
    taken = [(a, b) for a, _, b, _ in base + more]
    for m in FURTHER["opaque"].finditer(text) if _DIGIT.search(text) else ():
        v = m[0]
        mixed = any(c.islower() for c in v) and any(c.isupper() for c in v) and sum(c.isdigit() for c in v) >= 2
        if mixed and entropy(v) >= 3.5 and not any(a < m.end() and m.start() < b for a, b in taken):
            more.append((m.start(), 6, m.end(), v))
    return sorted(base), sorted(more)


def joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in found)


FOUND = "array<struct<start:int,kind:int,`end`:int,value:long,random:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())])
    for batch in slices(batches, "text"):
        counts, digests, rows = [], [], []
        for text in batch.column("text").to_pylist():
            base, more = find(text or "")
            counts.append([sum(x[1] == k for x in base) for k in range(3)])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows.append([{"start": a, "kind": k, "end": b, "value": xxhash.xxh3_64_intdigest(v) - 2**63, "random": entropy(v) >= LIVE_BITS} for a, k, b, v in sorted(base + more)])
        columns = [batch.column(c) for c in ("uid", "id", "owner", "repo")]
        columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)] + [pa.array(digests), pa.array(rows, pa.list_(item))]
        yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def secret_scan(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_assign, n_access, n_hex, base_sha256, spans (all reported, joined), found (array of start, kind, end, n_owners, n_repos, live)."""
    ship(docs.sparkSession)
    of = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), of(id_col).alias("id"), F.xxhash64(of(owner_col)).alias("owner"), F.xxhash64(of(repo_col)).alias("repo"), of(text_col).alias("text"))
    schema = f"uid long, id {dict(rows.dtypes)['id']}, owner long, repo long, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"
    scanned = write_table(rows.mapInArrow(_scan, schema), "secrets")
    each = scanned.filter(F.size("found") > 0).select("uid", "owner", "repo", F.explode("found").alias("x")).select("uid", "owner", "repo", "x.*")
    # A repository stands once for a value and owner: its rows first, then sums, all with partial sums.
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n_rows"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))
    owned = write_table(by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"), F.sum("n_rows").alias("n_rows")), "secrets-owned")
    live = F.col("random") & (F.col("n_owners") < WIDE_OWNERS) & (F.col("n_repos") < WIDE_REPOS)
    total = owned.agg(F.sum("n_rows").alias("n")).first().n or 0
    judged = hot_join(each, owned, "value", "n_rows", total).select("uid", F.struct("start", "kind", "end", "n_owners", "n_repos", live.alias("live")).alias("x")).filter((F.col("x.kind") < len(BASE)) | F.col("x.live"))
    spans = judged.groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = scanned.drop("found").join(spans, "uid", "left")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,`end`:int,n_owners:long,n_repos:long,live:boolean>>")).alias("found"))


def redact(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, live secrets in texts replaced by their kind in brackets; examples that people copy stay."""
    keyed = docs.withColumns({"_pf_print": F.xxhash64(text_col), "_pf_null": F.col(id_col).isNull(), "_pf_id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    scan = secret_scan(keyed.select(id_col, owner_col, repo_col, text_col, F.struct("_pf_null", "_pf_id", "_pf_print").alias("_pf_key")), owner_col, repo_col, "_pf_key", text_col)
    live = scan.select("_pf_key.*", F.filter("found", lambda x: x["live"]).alias("_pf_spans")).filter(F.size("_pf_spans") > 0)
    live = write_table(live.dropDuplicates(["_pf_null", "_pf_id", "_pf_print"]), "secrets-live")
    if (live.agg(F.sum(F.size("_pf_spans") + 1).alias("n")).first().n or 0) <= BROADCAST_SPANS:  # then texts need no shuffle
        live = F.broadcast(live)
    names, text = F.array(*map(F.lit, KINDS)), F.col(text_col)

    def cut(done, x):
        put = F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit("["), F.get(names, x["kind"]), F.lit(" removed]"))
        return F.struct(F.when(x["start"] >= done["at"], put).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    done = F.aggregate("_pf_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    out = keyed.join(live, ["_pf_null", "_pf_id", "_pf_print"], "left")
    return out.select(*(F.when(F.col("_pf_spans").isNotNull(), done).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))

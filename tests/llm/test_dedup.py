"""Exact, near, substring and line deduplication against brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from plainframe.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose, row, sha


def rice(values):
    k, quotients, rest = exact_dedup.rice_encode(values)
    return exact_dedup.rice_decode(len(values), k, quotients, rest)


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_golomb_codes_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    assert (rice(values) == values).all()
    assert (rice(np.array([0], np.uint64)) == [0]).all() and (rice(np.array([0, 2**64 - 1], np.uint64)) == [0, 2**64 - 1]).all()


def test_exact(odd, odd_rows):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in odd_rows:
        groups[r[1] or ""].append(r[0])
    low = lambda x: (x is not None, x or 0)
    expected = sorted(str((i, max(v, key=low), len(v), sha(t))) for t, v in groups.items() for i in v)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_of_many_copies(spark):
    rows = [row(i, "copy" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got.filter("kept").count() == 1001 and got.filter("group_size = 2000 AND keep_id = 2999").count() == 2000


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(rows, k, percent=80):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                root[max(find(a), find(b))] = min(find(a), find(b))
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    best = {g: rows[min(m, key=order)][0] for g, m in groups.items()}
    return sorted(str((rows[i][0], len(sets[i]), best[find(i)])) for i in range(len(rows))), len(groups)


@pytest.mark.parametrize("k", [4, 5])
def test_near(odd, odd_rows, k):
    got = near_dedup.near_dedup(odd, shingle=k).collect()
    expected, groups = linked(odd_rows, k)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == expected
    assert sum(r.kept for r in got) == groups


def chain(seed, n, words, change):
    """Texts that each differ a little from the one before: links far from any centre."""
    import random

    r, text, out = random.Random(seed), prose(seed, words).split(), []
    for _ in range(n):
        out.append(" ".join(text))
        for _ in range(change):
            text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("finish", [0, near_dedup.FINISH])
def test_near_follows_chains_and_clusters(spark, monkeypatch, finish):
    monkeypatch.setattr(near_dedup, "FINISH", finish)
    monkeypatch.setattr(near_dedup, "STAR", 5)
    long, short = (40, 30) if finish else (12, 9)  # with centres alone, a round for each text of a chain
    texts = chain(1, long, 120, 3) + chain(2, short, 60, 2) + chain(3, 20, 200, 9) + [prose(4, 100)] * 30 + [prose(100 + i, 80) for i in range(30)]
    rows = [row((i * 37) % 1000, t) for i, t in enumerate(texts)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), shingle=4).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == linked(rows, 4)[0]


def test_signatures_of_small_sets_agree_with_jaccard():
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 2**63, 10).astype(np.uint64) * np.uint64(2))
    sig = near_dedup.signatures([a, a[:9], a[:1]])
    assert abs((sig[0] == sig[1]).mean() - 0.9) < 0.12 and len(set(sig[2])) == 1


def test_keep_one(odd, odd_rows):
    got = near_dedup.keep_one(odd, shingle=5).collect()
    assert got[0].__fields__ == odd.columns
    words = [r for r in got if (r.text or "").split()]
    assert len(got) == linked(odd_rows, 5)[1] and len({r.text for r in words}) == len(words)


def brute_substring(rows, k=13):
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        if r[0] is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = set()
        if r[0] is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < r[0]:
                    gone |= set(range(i, i + k))
        out.append(str((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())))
    return sorted(out)


@pytest.mark.parametrize("batches,runs", [((1.0,), 4), ((0.5, 1.0), 4), ((0.2, 0.4, 0.6, 0.8, 1.0), 1)])
def test_substring(odd, odd_rows, monkeypatch, batches, runs):
    monkeypatch.setattr(substring_dedup, "RUNS", runs)
    monkeypatch.setattr(substring_dedup, "SEND_BYTES", 4000)
    got = substring_dedup.substring_dedup(odd, batches=batches).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_substring(odd_rows)


def test_substring_index_over_batches_and_compaction(spark, tmp_path):
    texts = [prose(1, 50), prose(2, 40) + " " + prose(1, 50), prose(3, 30), prose(3, 30) + " tail " + prose(2, 40)]
    seen, path = [], (tmp_path / "index").as_uri()
    for i, t in enumerate(texts):
        index = substring_dedup.FingerprintIndex(spark, path, runs=4)  # opened anew for every batch
        batch = spark.createDataFrame([(i, 0, t)], "id long, print long, text string")
        seen.append(sorted({int(p) for r in index.places(index.add(batch)).collect() for p in substring_dedup.from_planes(r.data, np.uint32)}))
        if i == 1:
            before, bits = len(index.state["runs"]), index.state["owner_bits"]
            index.compact(bits + 2)
            assert (before, len(index.state["runs"]), index.state["owner_bits"]) == (2, 1, bits + 2)
    assert [len(x) for x in seen] == [0, 38, 0, 18 + 28]
    left = sorted(x.name for x in (tmp_path / "index").iterdir() if not x.name.startswith("."))
    assert len([x for x in left if x.startswith("run-")]) == 3 and [x for x in left if x.startswith("manifest-")] == [f"manifest-{index.version}"]
    with pytest.raises(ValueError, match="13 words"):
        substring_dedup.FingerprintIndex(spark, path, window=5)


def test_a_batch_in_a_new_session_meets_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "OWNER_WINDOWS", 20)  # so that owners are split as the index grows
    path = (tmp_path / "index").as_uri()
    first = [row(i, prose(i, 60)) for i in range(30)]
    later = [row(100 + i, prose(i, 60) if i % 3 == 0 else prose(500 + i, 60)) for i in range(30)]
    for session, rows in ((spark, first), (spark.newSession(), later)):
        index = substring_dedup.FingerprintIndex(session, path)
        got = substring_dedup.substring_dedup(session.createDataFrame(rows, SCHEMA), index=index).collect()
    assert sorted(str(tuple(r)) for r in got) == [x for x in brute_substring(first + later) if int(x[1:].split(",")[0]) >= 100]


def test_compaction_runs_in_the_query(spark, monkeypatch):
    rows, done = [row(i, prose(i % 30, 60)) for i in range(40)], []
    compact = substring_dedup.FingerprintIndex.compact
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self, *a: (compact(self, *a), done.append(len(self.state["runs"]))))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert done == [1] and sorted(str(tuple(r)) for r in got) == brute_substring(rows)


def handed_on(docs, run):
    """One owner's rows of a batch, what it makes of them and of a run, and the bytes it takes for each window at most."""
    batch = pa.RecordBatch.from_pylist([{"id": i, "print": 0, "text": t} for i, t in docs])
    sent = list(substring_dedup._send(0, 13)(iter([batch])))
    whole = pa.Table.from_batches(sent)
    own = substring_dedup._own(True, 64)
    tracemalloc.start()
    out = own(whole, run)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    new = out.filter(pc.equal(out.column("kind"), 1))
    made = pa.table({"owner": new.column("place"), "data": new.column("data"), "checks": new.column("checks")})
    found = substring_dedup._gather(out.filter(pc.equal(out.column("kind"), 0))).to_pylist() if len(out) > len(new) else []
    return sent, out, made, {(r["id"], int(p)) for r in found for p in substring_dedup.from_planes(r["data"], np.uint32)}, most / sum(len(x) // 4 for x in whole.column("checks").to_pylist() if x)


NO_RUN = pa.table({"owner": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "checks": pa.array([], pa.binary())})


def test_rows_and_sorts_of_large_owners_are_bounded():
    r = random.Random(3)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100_000))) for i in range(4)]
    sent, out, run, found, most = handed_on(docs, NO_RUN)
    assert found == set() and most < 70
    for batches in (sent, out.to_batches(), substring_dedup._merge(1)(run).to_batches()):
        assert len(batches) > 1 and max(b.nbytes for b in batches) < 3_000_000
        assert max(len(x) // 4 for b in batches for x in b.column("checks").to_pylist() if x) < 20_000


@pytest.mark.parametrize("row_windows,sort_windows", [(1, 1), (3, 10), (16, 1000)])
def test_cut_rows_and_sorts_give_the_same(monkeypatch, row_windows, sort_windows):
    first = [(i, prose(i % 5, 60) + " " + prose(50 + i, 20)) for i in range(12)]
    later = [(100 + i, prose(i % 7, 60) + " " + prose(70 + i % 3, 30)) for i in range(12)]
    want = [{(d, i) for d, i in repeats(first)}, {(d, i) for d, i in repeats(first + later) if d >= 100}]
    merged = substring_dedup._merge(2)
    plain = merged(pa.concat_tables([(run := handed_on(first, NO_RUN)[2]), handed_on(later, run)[2], run]))
    for name, value in (("ROW_WINDOWS", row_windows), ("SORT_WINDOWS", sort_windows), ("TABLE_BYTES", 100)):
        monkeypatch.setattr(substring_dedup, name, value)
    *_, run, found, _ = handed_on(first, NO_RUN)
    *_, more, found_later, _ = handed_on(later, run)
    assert [found, found_later] == want and all(want)
    # of several runs, with windows that both hold
    assert handed_on(later, pa.concat_tables([more, run, run]))[3] == {(d, i) for d, t in later for i in range(len(t.split()) - 12)}
    assert contents(merged(pa.concat_tables([run, more, run]))) == contents(plain)


def repeats(docs, k=13):
    places = [(d, i, tuple(t.split()[i : i + k])) for d, t in docs for i in range(len(t.split()) - k + 1)]
    low = {}
    for d, _, w in places:
        low[w] = min(low.get(w, d), d)
    return [(d, i) for d, i, w in places if low[w] < d]


def contents(run):
    return sorted((r["owner"], int(h), int(c)) for r in run.to_pylist() for h, c in zip(substring_dedup.unpack(r["data"]), np.frombuffer(r["checks"], np.uint32)))


def test_planes_round_trip():
    for values in (np.array([0], np.uint64), np.array([1, 2**40, 2**63], np.uint64), np.empty(0, np.uint64)):
        assert (substring_dedup.unpack(substring_dedup.pack(values)) == values).all()


def brute_lines(rows, ratio, least):
    bare = lambda x: x.strip(" \t\r")
    pages = Counter(r[3] for r in rows)
    have = Counter((r[3], x) for r in rows for x in {bare(x) for x in (r[1] or "").split("\n")} if x)
    over = lambda h, x: x and pages[h] >= least and have[h, x] > 1 and have[h, x] > ratio * pages[h]
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [x for x in lines if over(r[3], bare(x))]
        out.append(str((r[0], None if r[1] is None else "\n".join(x for x in lines if not over(r[3], bare(x))), sum(bare(x) != "" for x in lines), len(gone))))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_lines(spark, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rows = odd_rows + [row(100 + i, f"All rights reserved\n{prose(i, 12)}\n \t\nAll rights reserved " + (f"\n{prose(1000, 9)}" if i % 30 == 0 else ""), "big" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = line_dedup.line_dedup(df, "source", ratio=0.3, min_pages=20, report=True)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == brute_lines(rows, 0.3, 20)
    assert got.filter("n_dropped > 0").count() == 90


def test_small_hosts_go_by_the_ratio(spark):
    df = spark.createDataFrame([row(i, f"All rights reserved\n{prose(i, 12)}", f"s{i // 4}") for i in range(20)], SCHEMA)
    assert [r.text for r in line_dedup.line_dedup(df, "source").orderBy("doc_id").collect()] == [prose(i, 12) for i in range(20)]


def test_lines_agree_with_the_sql_where_lines_are_dropped(spark):
    import duckdb

    df = spark.createDataFrame([row(i, f"All rights reserved\n{prose(i, 12)}", f"s{i % 2}" if i < 50 else f"small{i % 5}") for i in range(60)], SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = line_dedup.line_dedup(df, "source", report=True)
    assert got.filter("n_dropped = 1").count() == 60
    assert sorted(map(str, con.execute(line_dedup.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect())


def test_lines_use_no_python(odd):
    plan = line_dedup.line_dedup(odd, "source")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert line_dedup.line_dedup(none, "source").count() == 0


def test_null_host_is_one_host(spark):
    df = spark.createDataFrame([row(i, "same line", None) for i in range(30)], SCHEMA)
    assert line_dedup.line_dedup(df, "source").filter(F.col("text") == "").count() == 30


def test_bitmaps_never_refuse_a_link(spark):
    rng = np.random.default_rng(7)
    pairs = []
    for n in (3, 40, 150, 900, 5000):
        base = rng.integers(0, 2**62, n)
        for share in (0.95, 0.9, 0.89, 0.6, 0.1):
            other = np.concatenate((base[: int(n * share)], rng.integers(0, 2**62, n - int(n * share))))
            pairs.append((base, other))
    rows = []
    for a, b in pairs:
        marks = []
        for x in (a, b):
            bits = np.zeros(near_dedup.MARKS, np.uint8)
            bits[x & (near_dedup.MARKS - 1)] = 1
            marks.append(np.packbits(bits).view(np.int64).tolist())
        inter = len(set(a.tolist()) & set(b.tolist()))
        rows.append((len(a), len(b), *marks, 100 * inter >= 80 * (len(a) + len(b) - inter)))
    df = spark.createDataFrame(rows, "n long, m long, a array<long>, b array<long>, links boolean")
    got = df.withColumn("may", near_dedup.may_link(F.col("n"), F.col("m"), F.col("a"), F.col("b"), 80))
    assert got.filter("links AND NOT may").count() == 0
    assert got.filter("n <= 150 AND NOT links AND may").count() <= 2

"""Nearest examples against brute force, held-out accuracy, and cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plainframe.llm import toxicity

from .conftest import SCHEMA, prose, row

BAD = ["moronic", "worthless", "pathetic", "disgusting"]


def documents(n):
    out = []
    for i in range(n):
        r = random.Random(i)
        w = prose(i, r.randint(30, 90)).split()
        if i % 6 == 0:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ".", "***"]))
        out.append(row(i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(documents(900), SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1 if i % 6 == 0 else 0) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels, learn_from=~toxicity.held_out())


def test_held_out_accuracy(spark, fitted):
    docs, _, index = fitted
    got = toxicity.score(docs, index).filter(toxicity.held_out()).collect()
    assert len(got) > 100
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in got]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(toxicity_held(x.id) for r in got for x in r.evidence)


def toxicity_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_labels_of_held_out_rows_are_never_learned(fitted):
    assert fitted[2].ids and not any(toxicity_held(i) for i in fitted[2].ids)


def brute_vector(text, weight_of):
    """Weights of a text's terms, from the text itself."""
    n = Counter()
    for w in re.findall(r"[^\W_]+", text.lower()):
        n[w, 0] += 1
        for k in toxicity.PREFIXES:
            if len(w) > k:
                n[w[:k], k] += 1
    v = {t: (1 + math.log(c)) * weight_of[t] for t, c in n.items() if t in weight_of}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / length for t, x in v.items()}


def test_neighbours_are_exact(spark, fitted):
    """Weights, cosines, neighbours and votes from raw texts, without the index."""
    docs, labels, index = fitted
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.dropna().collect()}
    examples = [i for i in text if not toxicity_held(i)]
    assert len(examples) == sum(len([j for j in examples if text[j] == text[i]]) for i in index.ids) and len(examples) < toxicity.NEGATIVE
    terms = {i: {x for w in re.findall(r"[^\W_]+", t.lower()) for x in [(w, 0), *((w[:k], k) for k in toxicity.PREFIXES if len(w) > k)]} for i, t in text.items()}
    df = Counter(x for ts in terms.values() for x in ts)
    yes = Counter(x for i in examples if label[i] for x in terms[i])
    no = Counter(x for i in examples if not label[i] for x in terms[i])
    p = sum(label[i] for i in examples)
    weight = {x: (math.log((len(text) + 1) / (df[x] + 1)) + 1) * math.log2(2 + yes[x] / p * (len(examples) - p) / max(1, no[x])) ** 2 for x in set(yes) | set(no)}
    vectors = {i: brute_vector(text[i], weight) for i in index.ids}
    place = {i: k for k, i in enumerate(index.ids)}
    some = [i for i in text if i % 7 == 0] + [i for i in text if toxicity_held(i)][:40]
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    for i in some:
        q = brute_vector(text[i], weight)
        sims = sorted(((-round(sum(x * v.get(t, 0) for t, x in q.items()), toxicity.PLACES), place[j]) for j, v in vectors.items()))[: toxicity.NEAREST]
        near = [(-s, k) for s, k in sims if s]
        assert np.allclose([x.similarity for x in got[i].evidence], [s for s, _ in near[:3]], atol=3e-6)
        clear = all(a[0] - b[0] > 1e-5 for a, b in zip(near[:4], near[1:4]))
        assert not clear or [x.id for x in got[i].evidence] == [index.ids[k] for _, k in near[:3]]
        assert abs(got[i].score - index.score(index.vote(near))) < 0.02


@pytest.mark.parametrize("head,size,block", [(1, 96_000_000, 64), (10**9, 96_000_000, 7), (32, 4000 * 3, 1)])
def test_neighbours_do_not_depend_on_what_is_dense(fitted, monkeypatch, head, size, block):
    docs, _, index = fitted
    texts = pa.array([r.text for r in docs.orderBy("doc_id").limit(150).collect()])
    want = toxicity.Lookup(index)(texts)
    monkeypatch.setattr(toxicity, "HEAD", head)
    monkeypatch.setattr(toxicity, "HEAD_BYTES", size)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    other = toxicity.Index(**index.__getstate__())
    got = toxicity.Lookup(other)(texts)
    assert [[round(s, 5) for s, _ in near] for _, near in got] == [[round(s, 5) for s, _ in near] for _, near in want]
    assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-4)


def test_equal_examples_vote_together_and_order_ignores_labels_and_ids(spark):
    texts = [(i, prose(i % 20, 40) + (" moronic worthless" if i % 20 < 5 else "")) for i in range(200)]
    one = [(i, t, int(i % 20 < 5)) for i, t in texts]
    two = [(1000 - i, t, y) for i, t, y in one]
    found = []
    for rows in (one, two):
        df = spark.createDataFrame(rows, "doc_id string, text string, toxic int").repartition(3)
        index = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        assert len(index.ids) == 20 and abs(index.mass.sum() - sum(r[2] or 1 for r in rows)) < 1
        got = toxicity.score(df, index).collect()
        found.append(sorted({(r.score, tuple(x.similarity for x in r.evidence)) for r in got}))
    assert found[0] == found[1]


def test_votes_are_calibrated_upwards(fitted):
    x, y = fitted[2].knots
    assert (np.diff(x) >= 0).all() and fitted[2].score(1.0) > 0.9 and fitted[2].score(0.0) < 0.1


def test_odd_rows(odd, odd_rows, fitted):
    got = toxicity.score(odd, fitted[2]).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None and not math.isnan(r.score) for r in got)
    assert toxicity.drop_toxic(odd, fitted[2]).columns == odd.columns
    by_text = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(((x[0], x[1]) for x in odd_rows), key=lambda x: str(x[0]))):
        assert r.doc_id == i
        by_text.setdefault(i, set()).add(r.score)
    assert len(by_text[0]) == 1


def test_drop_toxic(fitted):
    docs, _, index = fitted
    left = toxicity.drop_toxic(docs, index)
    assert left.filter("doc_id % 6 = 0").count() <= 3 and left.filter("doc_id % 6 != 0").count() >= 745


def test_a_copy_of_any_example_is_nearest_to_it(spark, fitted):
    _, _, index = fitted
    rows = [r for r in documents(900) if r[0] in set(index.ids)][:120]
    assert any(r[0] % 6 for r in rows)  # also examples without any insult
    copies = spark.createDataFrame([(10_000 + r[0], *r[1:]) for r in rows], SCHEMA)
    for r in toxicity.score(copies, index).collect():
        assert r.evidence[0].id == r.doc_id - 10_000 and r.evidence[0].similarity > 0.999999


def test_without_labels(spark, odd, none):
    index = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, index).collect()} == {0.0}
    one = toxicity.fit(odd, spark.createDataFrame([(0, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, one).collect()} == {1.0}
    assert toxicity.score(none, index).count() == 0

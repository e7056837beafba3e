"""What the driver holds between the steps of an operator."""

import time

import pytest
from plainframe.llm import near_dedup, shared

from .conftest import SCHEMA, prose, row


@pytest.fixture
def rested(monkeypatch):
    """As if the driver had never given memory back, so that it is time for it."""
    monkeypatch.setattr(shared, "_gave", {"at": 0.0, "took": 0.0})


def collections(spark) -> int:
    """Full collections of the driver's heap so far, those that were asked for."""
    return max(x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in x.getName() and "Concurrent" not in x.getName())


def test_steps_give_memory_back(spark, rested):
    docs = spark.createDataFrame([row(i, prose(i % 3, 40)) for i in range(9)], SCHEMA)
    before = collections(spark)
    assert near_dedup.keep_one(docs).count() == 3
    assert collections(spark) > before and shared._gave["took"] > 0


def test_memory_is_given_back_now_and_then(spark, rested, monkeypatch):
    assert shared.give_back(spark)
    monkeypatch.setattr(shared, "_gave", {"at": time.monotonic(), "took": 60.0})
    before = collections(spark)
    assert not shared.give_back(spark) and collections(spark) == before


def test_trim_reaches_the_jvm(spark):
    assert shared.trim(spark).startswith("Trim native heap")

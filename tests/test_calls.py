import threading
import time

import pytest
from pyspark.sql import functions as F

from sourcelens.plans.calls import Call, Calls, Cancelled, DeadlineExceeded
from sourcelens.plans.context import Engine


def slow(spark):
    """A job of hours, if nothing ends it."""
    return spark.range(10**13, numPartitions=4).agg(F.sum(F.xxhash64("id") % 7)).collect()


def test_deadline(spark):
    t = time.time()
    with pytest.raises(DeadlineExceeded), Call(spark, 1.0):
        slow(spark)
    assert time.time() - t < 20
    assert spark.range(3).count() == 3  # later jobs carry no tag of the call


def test_cancel_while_running(spark):
    call = Call(spark)
    threading.Timer(1.0, call.cancel).start()
    with pytest.raises(Cancelled), call:
        slow(spark)
    assert call.state == "cancelled" and not call.commit() and not call.cancel()


def test_ends_between_jobs(spark):
    """A call that ended while no job ran raises all the same, and one that was committed stays answered."""
    call = Call(spark)
    with pytest.raises(Cancelled), call:
        assert call.cancel()
    with pytest.raises(Cancelled), call:
        pytest.fail("a cancelled call isn't entered")
    with Call(spark, 0.3) as answered:
        assert answered.commit() and not answered.cancel()
        time.sleep(0.6)
    assert answered.state == "committed"


def test_own_errors_stay(spark):
    with pytest.raises(ZeroDivisionError), Call(spark, 60):
        1 / 0  # noqa: B018


def test_registry(spark):
    calls = Calls()
    first = calls.begin(spark, "r1")
    with pytest.raises(ValueError, match="in flight"):
        calls.begin(spark, "r1")
    assert calls.cancel("r1") and not calls.cancel("r1") and not calls.cancel("none")
    calls.end(first)
    assert not calls.cancel("r1") and calls.begin(spark, "r1").state == "running"


def test_late_calls_are_not_remembered(spark):
    engine = Engine(spark, spark.createDataFrame([("src/a.rs", "fn token() {}")], "path string, text string"))
    with pytest.raises(DeadlineExceeded):
        engine.context("token", session_id="s", agent_id="a", seconds=0.001)
    assert engine.seq == 0 and engine.memory.count() == 0
    assert engine.context("token", session_id="s", agent_id="a", request="r", seconds=600).hits
    assert engine.seq == 1 and engine.memory.count() == 1 and not engine.cancel("r")

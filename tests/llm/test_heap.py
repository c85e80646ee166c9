"""What the pipeline's stages leave in the executors' heaps."""

import corpus_pipeline
import pytest

from vellum.llm import common


def test_executors_give_garbage_back(spark):
    gateway = spark.sparkContext._gateway
    runtime = gateway.jvm.java.lang.Runtime.getRuntime()
    held = gateway.new_array(gateway.jvm.long, 25_000_000)
    before = runtime.totalMemory() - runtime.freeMemory()
    gateway.detach(held)
    common.collected(spark)  # in tests the driver's JVM is the executor's
    assert runtime.totalMemory() - runtime.freeMemory() < before - 150_000_000


def test_each_stage_begins_without_the_garbage_of_the_last(monkeypatch):
    class Asked(Exception):
        pass

    def ask(spark):
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "collected", ask)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Asked):
            stage(None, None, "")

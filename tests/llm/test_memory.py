"""Python workers do not keep what a task needed: executors have several, and they wait for more tasks."""

import ctypes
import re
from pathlib import Path

import pytest

import corpus_pipeline as pipeline

STATUS = Path("/proc/self/smaps_rollup")
trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def anonymous() -> float:
    """MB of this process that no file has."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", STATUS.read_text())[1]) / 1024


@pytest.mark.skipif(trim is None or not STATUS.exists(), reason="needs glibc and Linux's proc")
def test_workers_give_memory_back(spark, sf_dir, monkeypatch):
    calls, frame = [], type(spark.range(0))
    map_in_arrow = frame.mapInArrow

    def noted(self, func, schema, *args, **more):
        calls.append((func, self))
        return map_in_arrow(self, func, schema, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:2]:
        stage(spark, docs, sf_dir)
    assert len(calls) >= 7
    kept = {}
    for func, rows in calls:
        batches = rows.toArrow().combine_chunks().to_batches()
        trim(0)
        for _ in func(iter(batches)):
            pass
        held = anonymous()
        trim(0)
        kept[f"{len(kept)} {func.__qualname__}"] = round(held - anonymous(), 1)
    assert max(kept.values()) < 4, kept

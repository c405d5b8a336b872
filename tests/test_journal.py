"""The index of seen ids, and journals over many batches."""

import pytest
from pyspark.sql import functions as F

from tapewright.streaming import observe, seen


def ids_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ingest_id string")


def test_a_repeat_in_a_batch_freezes(spark, tmp_path):
    j = observe.Journal(str(tmp_path / "j"))
    with pytest.raises(observe.Frozen, match="twice"):
        j.commit(ids_of(spark, "a", "b", "a"), 0)
    assert j.committed(spark) == []


def test_files_per_batch_do_not_grow(spark, tmp_path):
    j = observe.Journal(str(tmp_path / "j"))
    generations = []
    for k in range(17):
        assert j.commit(ids_of(spark, *[f"{k}-{i}" for i in range(20)]), k) == "committed"
        index = j.seen(spark)
        generations.append(len(index.generations()))
        index.any_of(index.hashed(ids_of(spark, f"new-{k}"), "ingest_id"))
        assert index.opened == []
    assert max(generations) <= 2 * (seen.MERGE - 1) + 1 and generations[15] == 1
    index = j.seen(spark)
    assert set(index.at.names()) == {"generations", *index.generations()}
    for old in ("0-0", "7-19", "16-3"):
        assert index.any_of(index.hashed(ids_of(spark, "other", old), "ingest_id")) and len(index.opened) == 1
    with pytest.raises(observe.Frozen, match="repeats"):
        j.commit(ids_of(spark, "fresh", "3-3"), 17)


def test_an_interrupted_commit_is_taken_up(spark, tmp_path, monkeypatch):
    j = observe.Journal(str(tmp_path / "j"))
    j.commit(ids_of(spark, "a"), 0)
    index = j.seen(spark)
    index.add("batch-1", index.hashed(ids_of(spark, "b"), "ingest_id"), 1)  # its mark was not written
    assert j.commit(ids_of(spark, "b", "c"), 1) == "committed"
    assert sorted(r.ingest_id for r in j.history(spark).collect()) == ["a", "b", "c"]


def test_parts_and_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "PART", 50)
    index = seen.Seen(spark, str(tmp_path / "s"))
    many = spark.range(1000).select(F.concat(F.lit("x"), F.col("id")).alias("ingest_id"))
    index.add("one", index.hashed(many, "ingest_id"), 1000)
    assert index.generations()["one"]["depth"] == 5
    for k in (0, 500, 999):
        assert index.any_of(index.hashed(ids_of(spark, f"x{k}"), "ingest_id")) and len(index.opened) == 1
    assert not index.any_of(index.hashed(spark.range(1000, 3000).select(F.concat(F.lit("x"), F.col("id")).alias("ingest_id")), "ingest_id"))
    assert len(index.opened) <= 3  # a filter lets four ids in 100,000 pass
    index.merge()
    assert index.any_of(index.hashed(ids_of(spark, "x3"), "ingest_id"))

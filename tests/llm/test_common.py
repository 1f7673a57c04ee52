import os
import time

from quern.llm.common import Scratch, lasting, release, shared_folder
from quern.llm.packing import pack
from quern.llm.sharding import shard_documents

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return [f for f in os.listdir(folder) if f.startswith("quern-")]


def test_released_results_leave_nothing_behind(spark, tmp_path):
    release(spark)
    before = set(tables(spark))
    docs = spark.createDataFrame([(k, "some words " * k, "s", "en", k) for k in range(9)], "doc_id long, text string, source string, lang string, n_chars long")
    packed = pack(docs)
    packed.write.parquet(str(tmp_path / "packed"))
    assert shard_documents(docs).count() == 9 and len(set(tables(spark)) - before) == 2
    assert release(spark) == 2 and release(spark) == 0
    assert set(tables(spark)) == before and spark.read.parquet(str(tmp_path / "packed")).count() == 9


def test_operators_that_overlap_leave_the_setting_as_it_was(spark):
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "4000")
    try:
        first, second = Scratch(spark), Scratch(spark)
        first.__enter__()
        second.__enter__()
        kept = second.keep(spark.range(3))
        assert spark.conf.get(BATCH) == "512" and kept.count() == 3
        first.__exit__(None, None, None)
        assert spark.conf.get(BATCH) == "512"
        second.__exit__(None, None, None)
        assert spark.conf.get(BATCH) == "4000"
    finally:
        spark.conf.set(BATCH, was)
    assert lasting(spark.range(2)).count() == 2 and release(spark) >= 1


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_what_a_step_shuffles_goes_when_it_is_written(spark):
    was, before = spark.conf.get(CLEAN), shuffled(spark)
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(50_000).repartition(3, "id"))
        until = time.time() + 20
        while shuffled(spark) - before and time.time() < until:  # the files are deleted in the background
            time.sleep(0.1)
        assert not shuffled(spark) - before
        assert kept.count() == kept.count() == 50_000
    assert spark.conf.get(CLEAN) == was
    spark.conf.set(CLEAN, "true")  # a session's own setting comes back
    with Scratch(spark) as scratch:
        scratch.keep(spark.range(3))
    assert spark.conf.get(CLEAN) == "true"
    spark.conf.set(CLEAN, was)

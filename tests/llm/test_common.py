from types import SimpleNamespace

import pytest

from vicinage.llm import common

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(master, found=None):
    conf = SimpleNamespace(get=lambda key, default=None: found)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))


def test_a_cluster_must_name_the_shared_folder():
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    assert common.shared_dir(session("local[4]")) == common.shared_dir(session("local[4]"))


def test_settings_are_put_back(spark):
    before = spark.conf.get(KEY)
    with common.text_batches(spark, 7):
        assert spark.conf.get(KEY) == "7"
    with pytest.raises(KeyError), common.text_batches(spark, 7):
        raise KeyError
    assert spark.conf.get(KEY) == before


def test_scratch_tables(spark, tmp_path):
    scratch = common.Scratch(spark, "t")
    a, b = scratch.save(spark.range(3)), scratch.save(spark.range(0))
    assert a.count() == 3 and b.count() == 0 and scratch.root.startswith(common.shared_dir(spark))
    scratch.drop(a)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(a._vicinage_path).count()
    assert b.count() == 0


def test_empty_columns_of_text():
    import pyarrow as pa

    a, offsets = common.text_bytes(pa.array([None, "é", "", None], pa.string()))
    assert a.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2, 2]
    assert common.text_bytes(pa.array([], pa.string()))[1].tolist() == [0]

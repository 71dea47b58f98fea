import os

import pyarrow as pa
import pytest

from epistride.llm import common


class Unset:
    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "local[4]"


def test_folder_is_the_cluster_s_and_ours_only_where_it_is_unset(spark, monkeypatch):
    assert common.shared_folder(Unset) == common.shared_folder(Unset) and common.shared_folder(Unset).startswith("file://")
    monkeypatch.setattr(Unset.sparkContext, "master", "local-cluster[3,2,3000]")
    with pytest.raises(ValueError):
        common.shared_folder(Unset)
    if spark.conf.get("spark.checkpoint.dir", None):
        assert common.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, "b" * 50, None, "c", "d" * 9])], ["text"])
    parts = [p.num_rows for p in common.by_bytes(batch, most=10)]
    assert sum(parts) == 5 and parts == [1, 1, 3]


def test_filter_never_misses(spark):
    some = spark.range(0, 5000, 7).union(spark.range(10**12, 10**12 + 10))
    hit, rest = common.maybe_in(spark.range(20000).union(spark.range(10**12, 10**12 + 10)), "id", some)
    assert rest.join(some, "id").count() == 0 and hit.join(some, "id").count() == some.count() and hit.count() < 1000
    assert hit.count() + rest.count() == 20010
    assert common.maybe_in(spark.range(5), "id", some.limit(0))[0].count() == 0


def test_scratch_tables_go(spark):
    with common.Scratch(spark, "some") as made:
        one = made.write(spark.range(5), "one")
        folder = made.folder.removeprefix("file:").replace("///", "/")
        assert one.count() == 5 and len(os.listdir(folder)) == 1
        two = made.write(one.where("id > 1"), "one")  # reads the older table, which then goes
        assert two.count() == 3 and len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)

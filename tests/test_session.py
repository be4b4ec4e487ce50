import os

from lexiloom.session import Scratch, scratch_scope


def test_scope_drops_its_tables(spark):
    with scratch_scope():
        s = Scratch(spark, "scoped")
        assert s.write(spark.range(5), "t").count() == 5
        with scratch_scope():
            inner = Scratch(spark, "inner")
            inner.write(spark.range(2), "t")
        assert not os.path.exists(inner.root.removeprefix("file://"))
        assert os.path.exists(s.root.removeprefix("file://"))
    assert not os.path.exists(s.root.removeprefix("file://"))
    kept = Scratch(spark, "kept")
    kept.write(spark.range(2), "t")
    assert os.path.exists(kept.root.removeprefix("file://"))
    kept.close()
    assert not os.path.exists(kept.root.removeprefix("file://"))

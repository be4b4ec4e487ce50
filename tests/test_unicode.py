import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import unicode as U

VALUES = ["ὄνομα", unicodedata.normalize("NFD", "ὄνομα"), "", None, "́a", "1́", "ΣΊΣΥΦΟΣ", "ß", "0", "1", "가", "ῷ‍ x"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("how", ["name", "expression"])
def test_normal_forms(df, how):
    c = "v" if how == "name" else F.concat(F.col("v"), F.lit(""))
    for form, f in (("NFC", U.nfc), ("NFD", U.nfd)):
        assert values(df, f(c)) == [None if v is None else unicodedata.normalize(form, v) for v in VALUES]
    assert values(df, U.casefold(c)) == [None if v is None else v.casefold() for v in VALUES]
    bare = lambda v: unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", v) if unicodedata.category(x) != "Mn"))
    assert values(df, U.strip_marks(c)) == [None if v is None else bare(v) for v in VALUES]
    assert values(df, U.letters_digits_key(c))[6:10] == ["σίσυφοσ", "ß", "0", "1"]


def test_below_aggregates_joins_and_windows(df):
    from pyspark.sql import Window

    key = U.nfc(F.concat(F.col("v"), F.lit("")))
    assert df.groupBy(key.alias("k")).count().where("k = 'ὄνομα'").first()["count"] == 2
    other = df.select(F.col("v").alias("w"))
    assert df.select("i", key.alias("k")).join(other, F.col("k") == F.col("w")).count() >= 10
    assert df.where(key.isNull()).count() == 1
    assert df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("i"))).where("n = 2").count() == 1
    assert df.orderBy(key).count() == len(VALUES)

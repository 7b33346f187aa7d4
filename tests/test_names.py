import pytest
from pyspark.sql import functions as F

from echofold.functions import names as N
from echofold.functions.hashes import fnv1a, signature


def one(spark, name, f):
    return spark.createDataFrame([(name,)], "n string").select(f(F.col("n")).alias("r")).first().r


@pytest.mark.parametrize("name", ["myFunction", "my_function", "MY_FUNCTION", "my$Function"])
def test_normalised(spark, name):
    assert one(spark, name, N.normalised) == "myfunction"


@pytest.mark.parametrize("name, words", [("parseHTMLString", ["parse", "html", "string"]), ("SCREAMING_CASE", ["screaming", "case"]), ("sha256Hash", ["sha", "256", "hash"]), ("", [])])
def test_words(spark, name, words):
    assert one(spark, name, N.name_words) == words


@pytest.mark.parametrize("name, stem", [("getUserName", ["user", "name"]), ("get", ["get"]), ("getSet", ["set"]), ("userGet", ["user"])])
def test_affixes(spark, name, stem):
    assert one(spark, name, lambda c: N.without_affixes(N.name_words(c))) == stem


def test_edits_and_jaccard(spark):
    r = spark.sql("select 'kitten' a, 'sitting' b, array(1,2) x, array(2,3) y, cast(array() as array<int>) e").select(N.within_edits(F.col("a"), F.col("b"), 2).alias("two"), N.within_edits(F.col("a"), F.col("b"), 3).alias("three"), N.jaccard(F.col("x"), F.col("y")).alias("j"), N.jaccard(F.col("e"), F.col("e")).alias("z")).first()
    assert (r.two, r.three, r.j, r.z) == (False, True, 1 / 3, 0.0)


def test_hashes():
    import numpy as np

    assert fnv1a("") == 0x811C9DC5
    assert fnv1a("a") == 0xE40C292C
    assert len(signature(np.array([1, 2, 3]))) == 64
    assert (signature(np.array([], np.int64)) == 0xFFFFFFFF).all()

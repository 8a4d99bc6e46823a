"""Lists as Columns by example."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import lists


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("members", "taken", "dropped"), [([3, 2, 1, 3], [3, 2], [1, 3]), ([1, 3], [], [1, 3]), ([2, 3], [2, 3], []), ([], [], []), ([2, None, 3], [2], [None, 3]), (None, None, None)])
def test_take_and_drop(spark, members, taken, dropped):
    x = F.lit(members).cast("array<int>") if members is not None else F.lit(None).cast("array<int>")
    assert first(spark, lists.take_while(x, lambda v: v > 1)) == taken
    assert first(spark, lists.drop_while(x, lambda v: v > 1)) == dropped


def test_last_by_key(spark):
    x = F.array(*[F.struct(F.lit(k).cast("string").alias("k"), F.lit(i).alias("i")) for i, k in enumerate(["a", "b", None, "a", None, "c"])])
    assert [(r.k, r.i) for r in first(spark, lists.last_by(x, lambda m: m["k"]))] == [("b", 1), ("a", 3), (None, 4), ("c", 5)]
    assert first(spark, lists.last_by(F.array().cast("array<int>"), lambda m: m)) == []


def test_text_of_markup(spark):
    cases = {"<p>a&amp;b<br>c</p>": "a&b c", "&lt;b&gt; &euro; &#8364;": "<b> € €", "": "", " <script>x</script> ": "", "a < b": "a < b"}
    assert {k: first(spark, lists.text_of(F.lit(k))) for k in cases} == cases
    assert first(spark, lists.text_of(F.lit(None).cast("string"))) is None

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import python_text as P


def test_functions_hold_a_few_rows_at_a_time(spark):
    """A value lives until the rows at once are made into Arrow, not until Spark's batch of 10,000 is."""

    def alive(x):
        import weakref

        class Held(str):
            pass

        global living
        living = globals().get("living") or weakref.WeakSet()
        made = Held(x)
        living.add(made)
        return [made, str(len(living))]

    held = P.batched_udf(alive, T.ArrayType(T.StringType()))
    got = spark.range(0, 9000, 1, 1).select(held(F.col("id").cast("string")).alias("x"), "id")
    assert got.filter("x[0] = id").count() == 9000
    assert got.agg(F.max(F.col("x")[1].cast("int"))).first()[0] <= 2 * P.ROWS_AT_ONCE


def test_values_of_every_kind_pass(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.IntegerType())]))), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    made = P.batched_udf(lambda k, m: None if k is None else ([("t", k), {"n": None}, None], {**dict(m), "k": k}), kind)
    rows = spark.createDataFrame([(1, {"a": 5}), (None, None)], "k int, m map<string,bigint>")
    got = [r.v for r in rows.select(made("k", "m").alias("v")).collect()]
    assert got[1] is None or got[0] is None
    v = next(x for x in got if x)
    assert [x and tuple(x) for x in v.a] == [("t", 1), (None, None), None] and v.m == {"a": 5, "k": 1}


def test_a_marked_place_costs_a_pass_over_the_lines(spark, tmp_path):
    from tessella.plans import catalog

    lines = [f"line {i}" for i in range(6000)]
    rows = [(0, "\n".join(lines)), (1, "a\nb\nc\nb\ne"), (2, "a\nb\nc\nd\n b "), (3, "a\nb\nc\nd\ne"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.h for r in catalog.QUERIES["edit12_splices_in_texts"](spark, str(tmp_path)).collect()}
    import hashlib

    sha = lambda x: hashlib.sha1("\n".join(x).encode()).hexdigest()
    assert got == {0: sha([*lines[:2], "  changed line", *lines[3:]]), 3: sha(["a", "b", "  changed line", "d", "e"])}

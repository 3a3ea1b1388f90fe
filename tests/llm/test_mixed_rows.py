"""Rows of a mix are named by their place in the files, or by numbers in a stored copy."""

import collections
import tempfile

from pyspark.sql import functions as F

from millrace.llm import mixing


def test_file_rows_and_numbered_rows_give_the_same_mix(spark):
    rows = [(i % 40, f"w{i} " * (1 + i % 7), "ab"[i % 5 == 0], f"u{i}") for i in range(90)] + [(None, "x y", None, "n"), (1, None, "a", "z"), (1, "", "b", "e")]
    made = spark.createDataFrame(rows * 2, "doc_id long, text string, source string, url string")
    path = tempfile.mkdtemp(prefix="millrace-mix-") + "/docs"
    made.repartition(6).write.parquet(path)
    read = spark.read.parquet(path)
    assert mixing._with_row(read).schema["__row"].dataType.simpleString() == "struct<file_path:string,row_index:bigint>"
    assert mixing._with_row(read).select("__row").distinct().count() == len(rows) * 2
    # A table made from the files may hold a row twice, so it is numbered.
    twice = read.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    assert mixing._with_row(twice).select("__row").distinct().count() == len(rows) * 4

    def counted(docs):
        got = mixing.materialise(docs)
        assert got.columns == docs.columns
        return [collections.Counter(len((r.text or "").split()) for r in got.collect() if r.source == s) for s in ("a", "b", None)]

    whole = [{k: v for k, v in c.items()} for c in counted(read)]
    words = [sum(k * v for k, v in c.items()) for c in whole]
    assert words == [sum(k * v for k, v in c.items()) for c in counted(made)]
    taken = mixing.mix(read).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r.source: r.n for r in taken} == dict(zip(("a", "b", None), words))

"""Inputs that the tests of all operators share."""

import zlib

import pyarrow.parquet as pq
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "a b"), (900005, "A B"), (None, "one two three four five six seven"),
    (900006, "word " * 30000), (900007, "x y z"), (900007, "x y z"), (None, None),
]


def documents():
    """The small table as (doc_id, text) pairs."""
    rows = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(rows["doc_id"], rows["text"]))


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def held(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k

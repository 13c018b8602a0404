"""Brute-force versions and edge-case tables shared by the tests."""

import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(ascii_lower(text))


def crc(value):
    return zlib.crc32(str(value).encode())


def docs(spark, rows):
    """Documents from (id, text) rows, with a hash-named extra column beside the usual ones."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def edge_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "no id here at all"), (5, long), (6, "tie tie tie tie tie"), (6, "tie tie tie tie tie"), (7, "Ünïcödé 😀 don't stop   x"), (8, "a" * 50_000)]

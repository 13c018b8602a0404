"""Contiguous shards of balanced bytes from global prefix sums.

Rows are put into one global order: by the MD5 of their text, then by id, so equal texts are neighbours
and at most one group of copies is cut at each of the shard borders. The order is range partitioned (a
hot text spreads over partitions by id) and materialised without the texts. Each partition's total of
rows and bytes is a row on the driver, at most one for each partition; the prefix sums of these totals
give every partition its place, a second pass adds the running sums inside the partition and cuts at
equal byte targets. Nothing is sorted or summed in one task.

Law: ``bytes``. A row's shard is that of its middle byte, so a shard differs from the mean by at most the
size of one row. Defined results: a null text has no bytes and counts as the overhead alone, with the
CRC of the empty text; null ids sort first; repeated rows are placed one by one; an empty table gives
no rows. A text is read where it stands and never moved; one larger than a shard leaves others short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import collect_bounded, materialise

SHARDS = 40
ROW_OVERHEAD = 16


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("h"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("crc"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = keyed.repartitionByRange(parts, F.col("h"), F.col("doc_id")).sortWithinPartitions("h", "doc_id", "crc")
    ordered = materialise(ordered.select("doc_id", "size", "crc", F.spark_partition_id().alias("pid")))

    totals = {r.pid: (r.n, r.s) for r in collect_bounded(ordered.groupBy("pid").agg(F.count("*").alias("n"), F.sum("size").alias("s")), 1 << 20, "partitions")}
    start, done = {}, 0
    for pid in sorted(totals):
        start[pid] = done
        done += totals[pid][1]
    total = max(done, 1)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for b in batches:
            if not b.num_rows:
                continue
            size = np.asarray(b.column(1))
            run = start[b.column(3)[0].as_py()] if run is None else run
            ends = run + np.cumsum(size)
            run = int(ends[-1])
            # twice the middle byte, in exact integers: (2 * end - size) * shards // (2 * total)
            shard = np.array([m * shards // (2 * total) for m in (2 * ends - size).tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], ["doc_id", "size", "crc", "pid", "shard"])

    cutted = ordered.mapInArrow(cut, f"doc_id {kind}, size long, crc long, pid int, shard int")
    counts = collect_bounded(cutted.groupBy("pid", "shard").count(), (1 << 20) + shards, "partitions and shards")
    first, filled = {}, {}
    for pid, shard, n in sorted((r.pid, r.shard, r["count"]) for r in counts):
        first[pid, shard] = filled.get(shard, 0)
        filled[shard] = first[pid, shard] + n

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            shard, slot, pid = np.asarray(b.column(4)), np.empty(b.num_rows, np.int64), b.column(3)[0].as_py()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                key = (pid, int(shard[x]))
                at = seen.get(key, first[key])
                slot[x:y] = np.arange(at, at + y - x)
                seen[key] = at + int(y - x)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2, 4)), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = cutted.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL for assign() over ``documents``; the CRC table is built from its polynomial.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS x, md5(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size FROM documents),
c AS (SELECT doc_id, h, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda p: CAST('0x' || p AS BIGINT))), lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1]))) AS crc FROM d, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, crc ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST((2 * e - size) * 40 // (2 * total) AS INT) AS shard FROM s)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, crc) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

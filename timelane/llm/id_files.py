"""Token id files of a corpus, in ascending key order, and their reader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.id_coder import BLOCK, BLOCKS, decode_frame, encode_frame
from timelane.llm.store import stored
from timelane.llm.tokens import encoder

c = F.col

END_ID = 0
_NULL = np.iinfo(np.int64).min


def write_id_files(
    records: DataFrame, path: str, vocabulary: str, *, key: str = "mix", text: str = "text", end_id: int = END_ID
) -> None:
    """Write the ids of whole texts below ``path``, which must not exist yet.

    ``records`` are saved mix files or any table with a whole-number key and a text. Each text is
    its ids and the end id; a null or empty one is the end id alone. Rows are dealt by ranges of
    the key and sorted in them, null keys first and equal keys next to each other. Every range
    is a segment, a file of frames (``segment``, ``frame``, ``ids`` long, ``payload`` binary), and no
    text spans two frames; an empty table gives files without frames.
    """
    full = BLOCK * BLOCKS

    def write(batches):
        tok, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        segment, frame, held, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packed():
            ids = np.frombuffer(b"".join(held), "<u4")
            payload = encode_frame(np.array(keys, np.int64), np.array([len(x) // 4 for x in held]), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([payload], pa.binary())], names=["segment", "frame", "ids", "payload"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.encode(t.as_py()) + end
                if held and size + len(ids) // 4 > full:
                    yield packed()
                    frame, held, keys, size = frame + 1, [], [], 0
                keys.append(_NULL if k is None else k)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield packed()

    rows = records.select(c(f"`{key}`").cast("bigint").alias("k"), c(f"`{text}`").cast("string").alias("t"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "k").sortWithinPartitions("k", F.xxhash64("t"))
    ordered.mapInArrow(write, "segment int, frame int, ids bigint, payload binary").write.parquet(path)


def read_id_files(spark: SparkSession, path: str, *, key: str = "mix") -> DataFrame:
    """The texts of id files: the key, ``start`` (ids of all texts before), ``length`` and ``ids``
    (little-endian unsigned 32-bit). A damaged block ends the job with an error."""
    files = spark.read.schema("segment int, frame int, ids bigint, payload binary").parquet(path)
    frames = stored(files.select("segment", "frame", "ids"))
    # Ids before a segment, and before a frame in its segment: numbers per segment and frame.
    segments = frames.groupBy("segment").agg(F.sum("ids").alias("n"))
    ahead = segments.select(
        c("segment").alias("_s"), (F.sum("n").over(Window.orderBy("segment")) - c("n")).alias("ahead"))
    inside = F.sum("ids").over(Window.partitionBy("segment").orderBy("frame")) - c("ids")
    before = frames.select("segment", c("frame").alias("_f"), inside.alias("inside")).join(
        ahead, c("segment") == c("_s")).select("_s", "_f", (c("ahead") + c("inside")).alias("before"))

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, lengths, ids = decode_frame(batch.column(2)[row].as_py())
                end = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[row].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column(1)[row].as_py(), np.int32)),
                        pa.array(keys, pa.int64(), mask=keys == _NULL), pa.array(end - lengths),
                        pa.array(lengths.astype(np.int64)),
                        pa.Array.from_buffers(pa.large_binary(), n, [
                            None, pa.py_buffer(np.concatenate([[0], 4 * end]).astype(np.int64).tobytes()), pa.py_buffer(raw),
                        ]).cast(pa.binary()),
                    ],
                    names=["segment", "frame", key, "place", "length", "ids"],
                )

    texts = files.select("segment", "frame", "payload").mapInArrow(
        read, f"segment int, frame int, `{key}` bigint, place bigint, length bigint, ids binary")
    return texts.join(before, (c("segment") == c("_s")) & (c("frame") == c("_f"))).select(
        key, (c("before") + c("place")).alias("start"), "length", "ids")

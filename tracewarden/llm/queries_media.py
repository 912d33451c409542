"""op2: every document stored as a GIF, read back and described."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .gif import decode, histogram, store_text

DIGEST = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("frames", T.IntegerType()), ("duration_ms", T.LongType()), ("mean_level", T.DoubleType()),
)])


def _digest(key, n_bytes, media):
    read, bins, frames, clock, level = [], np.zeros(24, np.int64), 0, 0, 0
    for f in decode(media):
        left, top, w, h = f.box
        grey = f.rgba[top : top + h, left : left + w, 0]  # the composed pixels; the palette is grey
        read.append(grey.tobytes())
        bins += histogram(f.rgba[top : top + h, left : left + w])
        level += int(grey.sum(dtype=np.int64))
        frames, clock = frames + 1, clock + f.delay_ms
    payload = b"".join(read)
    return (key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, bins[:8].tolist())), frames, clock, level / len(payload))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: the histogram of the grey levels in 8 bins."""
    stored = store_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64())
        for batch in batches:
            rows = [_digest(k.as_py(), n.as_py(), m.as_py()) for k, n, m in zip(batch.column("id"), batch.column("n_bytes"), batch.column("media"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=DIGEST.names)

    return stored.mapInArrow(run, DIGEST)


QUERIES = {"op2_gif_media": op2_gif_media}
#: A codec is no matter for SQL: tests hold it against exact round trips.
SQL: dict[str, str] = {}

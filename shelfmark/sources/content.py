"""Original files by path: read only where they still are what the catalogue says.

The folder is listed first, by the walker; of the files only those whose fingerprint (size and time) is the catalogue's
are opened. `chunks` reads files of any size, or ranges of them: a range is cut at multiples of the chunk's size, the cuts
are dealt over all tasks, and a task reads its cut from its place in the file; no row holds more than one. `contents` gives
a whole file as one row, for files that fit a row. A file that is gone or changes in between is left out: of `chunks` all
cuts that were read after that, so a reader that needs the whole adds up their lengths.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.sources import walker


#: Bytes of a row of `chunks` at most; of a whole file in one row.
CHUNK, WHOLE = 8 << 20, 1 << 30


def unchanged(spark, base: str, assets: DataFrame) -> DataFrame:
    """(id, relative_path, etag, source_fingerprint, size_bytes) of assets whose files below base have the recorded fingerprint."""
    found = walker.classified(walker.walk(spark, base)).filter("asset_kind is not null").select("relative_path", "source_fingerprint", F.col("size_bytes").alias("size"))
    return assets.join(found, ["relative_path", "source_fingerprint"]).select("id", "relative_path", X.content_etag(F.col("id"), F.col("source_fingerprint")).alias("etag"), "source_fingerprint", F.col("size").alias("size_bytes"))


def chunks(spark, root: str, assets: DataFrame, ranges: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """(id, etag, offset, content) of assets(id, relative_path, source_fingerprint, ...), whole or in ranges(id, start, end), both ends included, as byte_range gives them.

    Every range is given for itself, in cuts of `size` bytes at most; what lies behind the end of a file isn't there. Rows
    come in no order: (id, offset) order them.
    """
    base = root.removeprefix("file://").rstrip("/")
    same = unchanged(spark, base, assets)
    asked = same.withColumns({"start": F.lit(0).cast("long"), "end": F.col("size_bytes") - 1}) if ranges is None else same.join(ranges.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "id")
    asked = asked.withColumn("end", F.least("end", F.col("size_bytes") - 1)).filter("start >= 0 and start <= end")
    cut = asked.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    offset, behind = F.greatest("start", F.col("k") * size).cast("long"), F.least(F.col("end") + 1, (F.col("k") + 1) * size).cast("long")
    dealt = cut.select("id", "relative_path", "etag", "source_fingerprint", offset.alias("offset"), (behind - offset).alias("length"))

    def read(batches):
        for batch in batches:
            _, paths, _, prints, offsets, lengths = batch.columns
            for k in range(batch.num_rows):
                data = _part(os.path.join(base, paths[k].as_py()), prints[k].as_py(), offsets[k].as_py(), lengths[k].as_py())
                if data is not None:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), offsets.slice(k, 1), pa.array([data], pa.binary())], names=["id", "etag", "offset", "content"])

    return dealt.repartition("id", "offset").mapInArrow(read, "id long, etag string, offset long, content binary")


def _part(path: str, fingerprint: str, offset: int, length: int) -> bytes | None:
    """Bytes of a file that still has the fingerprint, before and after they are read."""
    try:
        with open(path, "rb", buffering=0) as f:
            parts, left = [], length
            for _ in range(2):
                at = os.fstat(f.fileno())
                if f"v1:{at.st_size}:{at.st_mtime_ns}" != fingerprint:
                    return None
                while left:
                    parts.append(os.pread(f.fileno(), left, offset + length - left))
                    if not parts[-1]:
                        return None
                    left -= len(parts[-1])
            return b"".join(parts)
    except OSError:
        return None


def contents(spark, root: str, assets: DataFrame, most: int = WHOLE) -> DataFrame:
    """(id, relative_path, etag, content) of assets(id, relative_path, source_fingerprint, ...) below root whose files have the recorded fingerprint; files over `most` bytes are for `chunks`, and are left out."""
    base = root.removeprefix("file://").rstrip("/")
    same = unchanged(spark, base, assets).filter(F.col("size_bytes") <= most).select("id", "relative_path", "etag", "source_fingerprint")

    def read(batches):
        for batch in batches:
            ids, paths, tags, prints = batch.columns
            for k in range(batch.num_rows):  # a file at a time: any may be large
                try:
                    with open(os.path.join(base, paths[k].as_py()), "rb") as f:
                        at = os.fstat(f.fileno())
                        data = f.read() if f"v1:{at.st_size}:{at.st_mtime_ns}" == prints[k].as_py() else None
                except OSError:
                    data = None
                if data is not None:
                    yield pa.RecordBatch.from_arrays([ids.slice(k, 1), paths.slice(k, 1), tags.slice(k, 1), pa.array([data], pa.binary())], names=["id", "relative_path", "etag", "content"])

    return same.mapInArrow(read, "id long, relative_path string, etag string, content binary")

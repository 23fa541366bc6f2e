"""What the operators share: the shared scratch folder, hot-aware joins, global positions, word hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
#: Rows of a table that may be broadcast after a count of it.
BROADCAST_ROWS = 500_000
#: Rows of a file of a stored table whose size is known.
FILE_ROWS = 500_000
#: Bytes of text that numpy works on at once.
SLICE = 2 << 20

_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        _roots[app] = f"{base.rstrip('/')}/edgeloom-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended before
        pass


#: Folders made by the steps that are under way, one list for each `only_result`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex[:8]}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def only_result(spark: SparkSession, what: str, build: Callable[[], tuple[DataFrame, int | None]]) -> DataFrame:
    """What `build` returns (and a bound of its rows, see `stored`), stored; the tables that it stored on the way are
    deleted."""
    token = _made.set([])
    try:
        (result, rows), made = build(), _made.get()
    finally:
        _made.reset(token)
    out = stored(result, what, rows)
    for path in made:
        _remove(spark, path)
    return out


def local_path(url: str) -> str:
    """The path of a folder that every machine mounts."""
    parsed = urlparse(url)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{url}: memory-mapped files need spark.checkpoint.dir on a mounted file system (file://)")
    return unquote(parsed.path)


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """df written to the scratch folder and read again: cuts the lineage and survives the loss of executors.

    rows: a bound of the rows of a narrow table, where one is known. Then the number of files follows it, not the
    partitions of the last shuffle.
    """
    if rows is not None:
        df = df.repartition(max(1, -(-rows // FILE_ROWS)))
    path, writer = new_folder(df.sparkSession, what), df.write
    if path.startswith("file:"):  # no checksum file beside each file, each of which starts a process to set its mode
        writer = writer.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def keep_keys(big: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """big joined with keys (unique in `on`): broadcast if a count shows that keys are few, else a shuffle join."""
    return big.join(F.broadcast(keys), on) if within_broadcast(keys) else big.join(keys, on)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with their group. Groups with over 1 / HOT_SHARE of all rows are broadcast (HOT_SHARE of them at most),
    so that no task gets a hot group; the rest meet in a shuffle join."""
    limit = max(total // HOT_SHARE, 1000)
    hot = F.col(size) > limit
    if total <= limit or groups.where(hot).limit(1).count() == 0:
        return rows.join(groups, on)
    flag = groups.where(hot).select(*on).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(flag), on, "left")
    cold = marked.where("_hot is null").drop("_hot").join(groups.where(~hot), on)
    warm = marked.where("_hot").drop("_hot").join(F.broadcast(groups.where(hot)), on)
    return cold.unionByName(warm)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition), 1)


def global_sorted(df: DataFrame, keys: list[str], rows: int, what: str, per_partition: int = 1_000_000) -> DataFrame:
    """df range-partitioned and sorted by keys and stored, with `_part` (range index) and `_row` (row within it)."""
    n = min(partitions_for(df.sparkSession, rows, per_partition), max(1, rows // 1000 + 1))
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out = out.withColumn("_id", at).withColumn("_part", F.shiftrightunsigned("_id", 33).cast("int"))
    out = out.withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    return stored(out, what)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and more columns, to go to Python in Arrow batches of a few MB: texts are long rows, and a batch is
    held several times over on either side."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    conf.set("spark.sql.parquet.columnarReaderBatchSize", "128")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns as `row`: no column's name can clash. select("row.*") unpacks."""
    return text_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def id_bucket(of: int):
    """crc32(doc_id as text) mod `of`: the folds of the contracts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound for speed; a miss is computed."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; split at space and 0x09-0x0D, as bytes.lower and bytes.split do."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h, k = word_hashes(words), min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _MIX[0] + h[i : n - k + 1 + i])
    return out


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), k)) if text else np.empty(0, np.uint64)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE):
    """(first row, bytes, offsets) of runs of whole texts of about `limit` bytes; null counts as empty."""
    arr = column(batch, name).cast(pa.binary()).fill_null(b"")
    n = len(arr)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; 0 for empty runs."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    """Whether str.isalpha holds for any character: marks such as a raised 2 are none."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))

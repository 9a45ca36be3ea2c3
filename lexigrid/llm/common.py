"""What the operators of this subpackage share: intermediate tables, batches, words and window hashes."""

import re
import tempfile
import uuid
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Entries that a Python worker's word cache may hold.
CACHE = 120_000
#: The same for results that take longer to make; and the longest key that a cache holds, so that its bytes are bounded too.
KEEP, LONG = 250_000, 64
#: Rows of an Arrow batch; with whole texts, a batch is a few MB.
BATCH_ROWS = 512

#: Paths that stash() wrote.
STASHED: list[str] = []
#: The folder that stands in for a shared one in local mode.
LOCAL: list[str] = []

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. In local mode, where one machine holds all, a new one stands in
    for it; a cluster must name one, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not LOCAL:
        LOCAL.append("file://" + tempfile.mkdtemp(prefix="lexigrid-"))
    return LOCAL[0]


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors,
    and gives later joins two plain exchanges, whose hot keys AQE can split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    STASHED.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stashed = path
    return found


def drop_stashes(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Removes what stash() wrote in this process, but for the paths in keep; results that aren't read yet need it, so call
    this after their last use."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [x for x in STASHED if x not in (keep or [])]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        STASHED.remove(name)


def remove(spark: SparkSession, name: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_some(spark: SparkSession, frames: list[DataFrame]) -> None:
    """Removes what these results of stash() hold, once nothing reads them any more."""
    for path in [f._stashed for f in frames]:
        remove(spark, path)
        STASHED.remove(path)


def sliding(x: np.ndarray, length: int, pick) -> np.ndarray:
    """Least or largest value of every run of `length`, by doubling."""
    if len(x) < length:
        return x[:0]
    size = 1
    while size * 2 <= length:
        x, size = pick(x[:-size], x[size:]), size * 2
    return pick(x[: len(x) - (length - size)], x[length - size :]) if size < length else x


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of texts, for the session, have no more rows than this; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class Recent(dict):
    """Remembers results of make(key) for the last KEEP to 2 KEEP different keys: what isn't asked for while KEEP others come is forgotten.
    Those of keys longer than LONG are made anew each time."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordHash(dict):
    """64-bit hashes of words; forgets all when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def flat_hashes(lists: list[list[bytes]], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several documents in one array, and where each document ends."""
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    return np.fromiter(map(cache.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=n), ends


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from those of its two parts."""
    x = a * _A + (b ^ (b >> U(29))) * _B + _C
    x ^= x >> U(32)
    x *= _A
    return x ^ (x >> U(29))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` words, built from windows of doubling lengths."""
    if len(h) < length:
        return h[:0]
    out, have, power, size, left = None, 0, h, 1, length
    while left:
        if left & 1:
            n = len(h) - have - size + 1
            out = power if out is None else join_hash(out[:n], power[have : have + n])
            have += size
        left >>= 1
        if left:
            power, size = join_hash(power[:-size], power[size:]), size * 2
    return out[: len(h) - length + 1]


def inside(ends: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which windows of `length` of n words lie within one document."""
    if n < length:
        return np.zeros(0, dtype=bool)
    at = np.arange(n - length + 1)
    return at + length <= ends[np.searchsorted(ends, at, side="right")]

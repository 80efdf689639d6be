"""Helpers shared by the training-data operators.

Rules that hold for every operator of this subpackage:

* a row is named by its integer ``doc_id`` (``vec_id`` for vectors); rows whose id is null take no part;
* a null text counts as the empty text;
* operators select the columns they need, so extra columns, whatever their names, change nothing;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.session import ensure_checkpoint_dir

#: The white space of the contracts: ``[\x20\x09-\x0D]``. ``bytes.split()`` cuts at exactly these.
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")

#: Fixed size of the membership bitmaps: BITMAP_BUCKETS rows of 4 KB (32,768 bits) each, 16 MB in all.
BITMAP_BUCKETS = 4096
BITMAP_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): no null ids, null texts as empty, nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
                       ).filter(F.col("doc_id").isNotNull())


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the session names: it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder, for tables that a job writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again: smaller than a checkpoint."""
    folder = shared_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever the names hold (dots, back quotes)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def bitmap_array(bitmap: DataFrame) -> np.ndarray:
    """The bits of :func:`member_bitmap` as one array of fixed size (16 MB), for tests inside Python tasks."""
    out = np.zeros((BITMAP_BUCKETS, BITMAP_BITS // 8), np.uint8)
    for bucket, bits in bitmap.collect():
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def is_member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` may be among those of the bitmap (never a false no)."""
    at = hashes.view(np.uint64) & np.uint64(BITMAP_BUCKETS * BITMAP_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def member_bitmap(hashes: DataFrame, col: str) -> DataFrame:
    """(bucket int, bits binary): a one-hash Bloom filter of the long column ``col``, of fixed size.

    At most BITMAP_BUCKETS rows of 4 KB, whatever the input: that bound is what allows the broadcast in
    :func:`maybe_member`. A false positive costs work, never a result: callers group exactly afterwards.
    """
    h = F.col(col)
    spread = F.pmod(h, F.lit(BITMAP_BUCKETS * BITMAP_BITS))
    return (hashes.select(F.floor(spread / BITMAP_BITS).cast("int").alias("bucket"),
                          (spread % BITMAP_BITS).cast("long").alias("_bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("_bit").alias("bits")))


def maybe_member(df: DataFrame, col: str, bitmap: DataFrame, how: str = "flag") -> DataFrame:
    """``df`` plus boolean ``_maybe``: whether ``col`` may be among the bitmap's hashes (never a false no).

    ``how="keep"`` drops the rows that certainly are not. The bitmap is broadcast: it has a fixed size.
    """
    spread = F.pmod(F.col(col), F.lit(BITMAP_BUCKETS * BITMAP_BITS))
    bit = (spread % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, bit % 8) == 1
    b = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    joined = df.join(b, F.floor(spread / BITMAP_BITS).cast("int") == F.col("_bucket"),
                     "left" if how == "flag" else "inner")
    out = joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")
    return out if how == "flag" else out.filter("_maybe").drop("_maybe")


# --- numpy hashing of words, used inside tasks ---------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1           # odd multiplier of the byte polynomial
_P_INV = pow(_P, -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of them."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _TABLES:
        p, q = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        _TABLES.clear()
        _TABLES[size] = (p, q)
    return _TABLES[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as uint8, starts, ends) of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return b, np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_BLANK[b]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [len(b)]))
    return b, edge[0::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over its bytes, then a mixing step. Linear in the text."""
    b, s, e = word_spans(raw)
    if not len(s):
        return np.zeros(0, np.uint64)
    p, q = powers(len(b) + 1)
    acc = np.empty(len(b) + 1, np.uint64)
    acc[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:len(b)], out=acc[1:])
    h = (acc[e] - acc[s]) * q[s]
    return mix64(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """64-bit hashes of every run of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    mul, h = np.uint64(seed | 1), np.full(m, seed, np.uint64)
    for i in range(n):
        h *= mul
        h += words[i:i + m]
    return mix64(h)


def sorted_runs(df: DataFrame, order: list[Column], what: str) -> DataFrame:
    """``df`` in ranges of ``order``, written and read again, with ``_run`` (number of the range, ascending with the
    order) and ``_at`` (position in it, ascending, with gaps between ranges only).

    A range is one task's share, whatever a key's weight: the row's place in its input breaks ties, so equal keys
    split over ranges. Both columns are frozen by the write; a lost executor after it changes nothing.
    """
    tie = fresh(df, "_tie")
    keys = [*order, F.col(tie)]
    runs = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return store(runs.drop(tie).withColumn("_run", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id()), what)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; needs the column ``tab`` of ``crc_table`` in scope."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, [{byte} FOR i IN range(1, 1 + octet_length(encode({text})))]), "
            "lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])))")


#: A common table expression with the 256 entries of the reflected crc32 polynomial, made by its rule.
CRC_TABLE_SQL = """crc_table AS (SELECT list(list_reduce(list_prepend(v, [0 FOR i IN range(8)]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY v) AS tab
    FROM (SELECT unnest(range(256))::BIGINT AS v))"""

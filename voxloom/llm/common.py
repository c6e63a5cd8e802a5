"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh_path, materialize, shared_dir, small_side

__all__ = ["Steps", "arrow_batches", "ascii_lower", "blanks", "bucketed", "crc32_sql", "fresh_path", "give_back", "letter_runs", "materialize", "private", "restored", "shared_dir", "small_side", "table", "with_columns", "words"]

#: Java regular expression of a run of the white space that separates words.
WS = "[\\x20\\x09-\\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runs of letters (Unicode category L) within Latin-1, for the faster `re`.
_LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_LATIN_RUNS = {lines: re.compile(f"[{_LATIN_LETTERS}]+" + "|\n" * lines) for lines in (False, True)}
_BEYOND_LATIN = re.compile("[^\x00-\xff]")



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def blanks(c: Column) -> Column:
    """The text with each white space character as a blank; null counts as empty. Byte-wise, faster than a regex."""
    c = F.coalesce(c, F.lit(""))
    for ch in "\t\n\x0b\f\r":
        c = F.replace(c, F.lit(ch), F.lit(" "))
    return c


def words(c: Column) -> Column:
    """Array of the words of a text; null counts as no text."""
    return F.array_remove(F.split(blanks(c), " "), "")


def letter_runs(text: str, lines: bool = False) -> list[str]:
    """Runs of letters; numerals and marks are none. lines: line ends as well."""
    if _BEYOND_LATIN.search(text):
        import regex

        return regex.findall(r"\p{L}+|\n" if lines else r"\p{L}+", text)
    return _LATIN_RUNS[lines].findall(text)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table in buckets of a key and read it back: a join or grouping by the key leaves it where it is.

    The catalog's entry goes at once, the files in the shared folder stay, as with `materialize`."""
    spark = df.sparkSession
    path, entry = fresh_path(spark, name), f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"drop table {entry}")
    return out


def private(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by position, so that no name clashes with an operator's own; the new name of each."""
    names = {c: f"__{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a table that went through `private`, under their own names again."""
    return df.select(*names.values()).toDF(*names)


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes: the checksum's table is made by its rule, then used byte by byte."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    table_ = f"list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {step}))"
    of = "(strpos('0123456789ABCDEF', substr(hex({t}), {at}, 1)) - 1)"
    values = f"list_transform(range(strlen({text})), lambda j: 16 * {of.format(t=text, at='2 * j + 1')} + {of.format(t=text, at='2 * j + 2')})"
    walk = f"list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, b: xor(c >> 8, crc_table.t[xor(c & 255, b) + 1]))"
    return f"(select xor({walk}, 4294967295) from (select {table_} as t) crc_table)"


class Steps:
    """The written tables of one run of an operator; those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """At the end of a Python task: return freed memory to the system, as an idle worker shares its executor's memory."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bytes of a batch between Spark and Python, rows whose texts Python holds at once.
BATCH_BYTES, ROWS_AT_ONCE = 4 << 20, 512


def arrow_batches(spark: SparkSession) -> None:
    """Bound batches to Python by their bytes, unless the session has a lower bound already: rows say nothing of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable) -> DataFrame:
    """Add columns that Python computes from the text; all other columns pass through Arrow as they are.

    make() is called once a task; what it returns turns a list of texts into one Arrow array for each field."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                new = columns(b[text].to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[f.name for f in fields]])
        del columns
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import shared_dir

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
SPACE = b" \t\n\r\x0b\x0c"


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is an empty one."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the cluster names."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and
    what has been written survives the loss of any executor."""
    # Spark 4.1 may zip the inputs of a union partition by partition, and lose rows
    # after adaptive coalescing; see plumbline.session.tune.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    # Nothing reads the shuffles behind a table once it is written; without this they
    # stay on disk until the driver happens to collect its garbage.
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bits of a table that tells hashes which may be wanted: 2^22 of them in 2^16 rows, whatever the data.
SLOT_BITS = 22


def _slot(h: str):
    low = F.col(h).bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))
    return F.shiftright(low, 6).alias("_word")


def maybe_in(df: DataFrame, h: str, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """The rows of ``df`` whose hash column ``h`` may be among the hashes in the only
    column of ``wanted``, and few others; with ``flag``, all rows and a column that tells
    them. For use before a join: the table of bits that is broadcast has at most 2^16
    rows, and rows that it lets through are only sent in vain."""
    one = F.expr(f"shiftleft(1L, cast({wanted.columns[0]} & 63 as int))")
    bits = wanted.select(_slot(wanted.columns[0]), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    joined = df.withColumn("_word", _slot(h)).join(F.broadcast(bits), "_word", "left" if flag else "inner")
    hit = F.expr(f"coalesce(shiftrightunsigned(_bits, cast({h} & 63 as int)) & 1, 0) = 1")
    own = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*own, hit.alias(flag)) if flag else joined.where(hit).select(*own)

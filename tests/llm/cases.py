"""Documents that every operator of this package has to survive."""

from pyspark.sql import types as T

SCHEMA = (
    T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType())
    .add("n_chars", T.LongType()).add("n_words", T.StringType()).add("component_id", T.StringType()).add("ids", T.StringType()))
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly box in the old garden near a river bank today"
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "x", PROSE, PROSE, PROSE + " again", "wörter é ﬁ ½ 　 ideographic space 漢字 😀", "\x00nul \x00 bytes",
    "▁▁ marks ▁a", "a" * 30_000, "word " * 4_000, "\n".join(["same line here again"] * 50), "Σίσυφος ΣΊΣΥΦΟΣ İstanbul K",
]


def rows(texts, start=0):
    return [(start + i, t, None, "hot" if i % 3 else None, None, "x", None, "y") for i, t in enumerate(texts)]


def odd(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, clashing extra columns."""
    data = rows(ODD) + [(None, None, None, None, None, None, None, None), (None, PROSE, "en", "hot", 1, None, None, None)]
    data += [data[4], data[4], (7, "another text under a used id", None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), SCHEMA)

"""Removal of repeated passages of several lines, by content-defined chunks of lines.

A text is cut into lines, and lines into chunks: a chunk ends after a line where a
rolling hash of the last ``WINDOW`` line hashes is 0 modulo ``DIVISOR``. The cut depends
on these lines only, so a passage is cut alike wherever it stands, and lines put before
it don't shift its chunks. A chunk of ``MIN_LINES`` lines or more that occurs more than
once in the corpus stays where it comes first (in the document of the smallest id, and
there at its first place) and is removed elsewhere. Occurrences are grouped by their
bytes, not by a hash alone.

Everything is a DataFrame expression. Chunk texts are combined before they are shuffled,
so a chunk that is everywhere costs one row for each task; what goes back to documents
is two hashes and a number for each occurrence.

Defined results: a null text stays null; an empty text is one empty line and stays.
A chunk of fewer lines is never removed, so a text without line breaks stays as it is.
A null id comes before all others. Rows that share an id count as one document for what
comes first: each keeps its own first copy. Other columns are kept; the two count columns
get underscores where such names are taken. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.functions.text import bound
from noteforge.llm.common import free_name

WINDOW, DIVISOR, MIN_LINES = 2, 3, 2
FACTOR = 1_000_003
NO_ID = -(1 << 63)


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def rolling(hashes: Column, i: Column) -> Column:
    """Polynomial hash of the ``WINDOW`` line hashes up to place ``i``, as a number below 2**31."""
    value = F.lit(0).cast("bigint")
    for back in range(WINDOW - 1, -1, -1):
        value = F.pmod(value * F.lit(FACTOR) + F.get(hashes, i - back), F.lit((1 << 31) - 1))
    return value


def chunks_of_lines(text: Column) -> Column:
    """Array of (lines, body) in text order; null for a null text. Every step is computed once for a text."""

    def ends(lines: Column, hashes: Column) -> Column:
        last = F.size(lines) - 1
        here = lambda i: (i == last) | ((i >= WINDOW - 1) & (rolling(hashes, i) % DIVISOR == 0))
        return F.filter(F.sequence(F.lit(0), last), here)

    def cut(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
            body = F.array_join(F.slice(lines, start + 1, end - start + 1), "\n")
            return F.struct((end - start + 1).alias("lines"), body.alias("body"))

        return F.transform(ends, chunk)

    def of(lines: Column) -> Column:
        return bound(F.transform(lines, line_hash), lambda hashes: bound(ends(lines, hashes), lambda e: cut(lines, e)))

    return F.when(text.isNotNull(), bound(F.split(text, "\n", -1), of))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Keys of a row: its id for what comes first, and a hash that tells rows of one id apart."""
    id_key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
    return docs.withColumns({"_id": id_key, "_row": F.xxhash64(F.col(doc_id).cast("string"), text)})


def remove_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with what is left of ``text``, and the numbers of its lines and of removed lines."""
    total, gone = (free_name(docs, c) for c in counts)
    keyed = _keyed(docs, doc_id, text)
    chunks = (
        keyed.select("_id", "_row", F.posexplode(chunks_of_lines(F.col(text))).alias("k", "c"))
        .where(F.col("c.lines") >= min_lines)
        .select("_id", "_row", "k", F.xxhash64("c.body").alias("h1"), F.xxhash64(F.lit(1), "c.body").alias("h2"), "c.body")
    )
    repeated = (
        chunks.groupBy("h1", "h2", "body").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"))
        .where("n > 1").select("h1", "h2", "first_id")
    )
    copies = chunks.select("_id", "_row", "k", "h1", "h2").join(repeated, ["h1", "h2"])
    removed = (
        copies.repartition("_id", "_row")
        .groupBy("_id", "_row", "h1", "h2").agg(F.array_sort(F.collect_set("k")).alias("ks"), F.first("first_id").alias("first_id"))
        .withColumn("ks", F.when(F.col("first_id") == F.col("_id"), F.slice("ks", F.lit(2), F.size("ks"))).otherwise(F.col("ks")))
        .groupBy("_id", "_row").agg(F.flatten(F.collect_list("ks")).alias("_gone"))
    )
    df = keyed.join(removed, ["_id", "_row"], "left")

    def left(chunks: Column) -> Column:
        """What stays, with the numbers of all lines and of removed ones."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), F.coalesce("_gone", F.array().cast("array<int>")))
        lines = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, c: a + c["lines"])

        def of(rows: Column) -> Column:
            body = F.array_join(F.transform(rows, lambda c: c["body"]), "\n")
            return F.struct(body.alias("body"), lines(chunks).alias("total"), (lines(chunks) - lines(rows)).alias("gone"))

        return bound(F.transform(kept, lambda k: F.get(chunks, k)), of)

    df = df.withColumn("_left", bound(chunks_of_lines(F.col(text)), left))
    return df.select(
        *[F.col("_left.body").alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce("_left.total", F.lit(0)).alias(total),
        F.coalesce("_left.gone", F.lit(0)).alias(gone),
    )

"""Removal of lines that an earlier document holds, in DataFrame functions only.

1. Each long enough line becomes (key, doc_id, position), with key 128 bits of the SHA-256 of the normalised line; texts stay behind.
2. Keys are partitioned by ranges and sorted by document and position within them, so the first row of a key is its first
   occurrence; a running window hands it on to the rows after it, and a row of a later document is to drop.
3. A key that holds more than one row in 1/HOT_SHARE of a sample never meets in a task: there are at most HOT_SHARE of these keys, so their
   first documents (a minimum, summed up on the map side) are broadcast, and their rows are judged where they lie. The sample
   decides only which way a key goes; either way gives the same rows.
4. What comes back is a bitmap of the lines to keep for each document, as runs (start, length); a document that keeps all has none.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: At most so many keys go the way of hot keys.
HOT_SHARE = 2000
#: Rows that are looked at for hot keys.
SAMPLE_ROWS = 200_000

WHITE = " \t\n\x0b\x0c\r"


def normalised(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; no other letter changes."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _texts(docs: DataFrame) -> DataFrame:
    """version tells texts of one doc_id apart."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(key, doc_id, position, version, n_lines) of the lines whose normalised form has min_chars code points or more."""
    split = _texts(docs).where("doc_id is not null").withColumn("lines", F.split("text", "\n"))
    rows = split.select("doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode(F.transform("lines", normalised)).alias("position", "line"))
    return rows.where(F.char_length("line") >= min_chars).select(F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("key"), "doc_id", "position", "version", "n_lines")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, keep) of the documents that lose lines; keep has the runs of lines that stay.

    A line goes if a document of smaller doc_id holds its normalised form, and that has min_chars code points. All lines of the first
    document stay, repeated ones too. Rows of equal doc_id are one document, told apart by version (xxhash64 of the text) if their
    texts differ. Rows without a doc_id lose nothing and count for nothing. Null texts are one empty line. Columns other than doc_id
    and text are not read. An empty table gives an empty table.
    """
    rows = saved(line_rows(docs, min_chars), "lines")
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    sample = rows.select("key").sample(share, 12)
    # with few rows, what is hot in the sample must still be there more than once
    least = max(2, int(sample.count() / hot_share) + 1)
    hot = saved(sample.groupBy("key").count().where(F.col("count") >= least).select("key"), "hot-lines")
    few = F.broadcast(hot)
    first = rows.join(few, "key").groupBy("key").agg(F.min("doc_id").alias("first"))
    late_hot = rows.join(F.broadcast(saved(first, "hot-first")), "key")
    ranges = rows.join(few, "key", "left_anti").repartitionByRange("key").sortWithinPartitions("key", "doc_id", "position")
    late = ranges.withColumn("first", F.first("doc_id").over(Window.partitionBy("key").orderBy("doc_id", "position")))
    own = ["doc_id", "version", "n_lines"]
    both = late.select(*own, "position", "first").union(late_hot.select(*own, "position", "first")).where("doc_id > first")
    gone = both.groupBy(*own).agg(F.array_sort(F.collect_set("position")).alias("gone"))
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1)), F.concat("gone", F.array("n_lines"))
    runs = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))
    return gone.select(*own, F.size("gone").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of docs, with the text that its bitmap leaves."""
    joined = _texts(docs).join(bitmaps.select("doc_id", "version", "n_dropped", "keep"), ["doc_id", "version"], "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", F.when(F.col("keep").isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kept_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}
ORACLES = {
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) IS TRUE AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY n, doc_id
"""
}

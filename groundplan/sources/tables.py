"""Reading and writing tables, CSV, nested JSON, key/value text and file inventories."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_metrics_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_meta(spark: SparkSession, path: str, schema: StructType | str | None = None, whole: bool = True) -> DataFrame:
    """One row per recording of JSON objects with a list demos; the other fields are repeated. whole: a file is one object, else each line is one."""
    reader = spark.read.option("multiLine", whole)
    meta = (reader.schema(schema) if schema else reader).json(path)
    return meta.select(*(c for c in meta.columns if c != "demos"), F.explode("demos").alias("demo")).select("*", "demo.*").drop("demo")


def key_values(text: str) -> Column:
    """All quoted pairs of a name and a number as a map; of equal names, the last one counts."""
    pattern = r'"(\w+)"\s+"(-?[\d.]+)"'
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), k) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].try_cast("double").alias("value")))
    ordered = F.array_sort(pairs)
    beside = F.arrays_zip(ordered.alias("a"), F.slice(ordered, 2, F.size(keys)).alias("b"))  # the last one has none
    last = F.filter(beside, lambda z: z["b"].isNull() | (z["b"]["key"] != z["a"]["key"]))
    return F.map_from_entries(F.transform(last, lambda z: F.struct(z["a"]["key"].alias("key"), z["a"]["value"].alias("value"))))


def parse_key_values(df: DataFrame, text: str, name: str = "values") -> DataFrame:
    return df.withColumn(name, key_values(text))


def first_key_values(df: DataFrame, text: str, keys: tuple[str, ...] = ("pos_x", "pos_y", "scale", "rotate"), required: tuple[str, ...] = ("pos_x", "pos_y", "scale")) -> DataFrame:
    """One column for each key, from its first pair; null without one, and an error for a key that is required."""
    out = {}
    for k in keys:
        found = F.nullif(F.regexp_extract(text, rf'"{k}"\s+"(-?[\d.]+)"', 1), F.lit("")).cast("double")
        out[k] = F.coalesce(found, F.raise_error(F.lit(f"no {k}")).cast("double")) if k in required else found
    return df.withColumns(out)


#: Bytes that a file's content has at most to come as one value; longer files are read in parts.
WHOLE_FILE, PART = 1 << 30, 8 << 20


def file_inventory(spark: SparkSession, root: str, glob: str = "*.dem", hashed: bool = True, limit: int = WHOLE_FILE) -> DataFrame:
    """(path, size_bytes, sha256) of all files below root that match, ordered by path; contents are only read for the hash.

    Files of over limit bytes are read in tasks, part after part, from the file system that their path names. Empty files have a row too: Spark lists
    them, as it lists all files, but reads none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    sized = files.select("path", F.col("length").alias("size_bytes"))
    plain = lambda path: re.sub("^([a-z0-9]+:)//(?=/)", r"\1", unquote(path))  # noqa: E731  as column path has it
    named = spark.createDataFrame([(plain(p),) for p in files.inputFiles()], "path string")
    empty = named.join(sized, "path", "left_anti").select("path", F.lit(0).cast("long").alias("size_bytes"))
    if not hashed:
        return sized.union(empty).withColumn("sha256", F.lit(None).cast("string")).orderBy("path")

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(quote(re.sub("^([a-z0-9]+:)/(?!/)", r"\1///", path), safe=":/@"))
                hashes = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while part := stream.read(PART):
                        hashes.update(part)
                found.append(hashes.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "size_bytes", "sha256"])

    schema = "path string, size_bytes long, sha256 string"
    small = files.where(F.col("length") <= limit).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = sized.where(F.col("size_bytes") > limit).mapInArrow(in_parts, schema)
    return small.union(large).union(empty.withColumn("sha256", F.lit(hashlib.sha256().hexdigest()))).orderBy("path")


def write_by_map(df: DataFrame, path: str, spread: str | None = None, parts: int = 8) -> None:
    """Parquet in one folder per map. With spread, each map's rows go to `parts` writers by a hash of that column."""
    keys = ["map_name"] if spread is None else ["map_name", F.pmod(F.xxhash64(spread), F.lit(parts))]
    df.repartition(*keys).write.partitionBy("map_name").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None, name: str = "rows") -> None:
    """One JSON object per row; with by, one per group, with its rows as a list (a group must fit in a task: these are summaries)."""
    if by:
        rest = [c for c in df.columns if c not in by]
        df = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    df.write.json(path)

"""Readers and writers of source tables, truth, folds, candidates and submissions."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kinweave.functions.ids import id_list
from kinweave.functions.text import ADDRESS_ALIASES, COUNTRY_ALIASES, NAME_ALIASES, first_present
from kinweave.operators.contracts import ContractError, repeated, require_columns, require_none, source_violations
from kinweave.sources.scratch import scratch_path

CANDIDATE_COLUMNS = [
    "source1_entity_id", "candidate_entity_id", "candidate_source", "name_tfidf_score", "address_tfidf_score", "name_rank", "address_rank",
    "retrieved_by_name", "retrieved_by_address", "retrieved_by_exact", "retrieval_provenance", "retrieval_score",
]


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All fields as text: NA and null stay literal, an empty field is the empty text.

    Reading the header is the only look at the file before the query runs;
    ``columns`` are pushed to the scan.
    """
    first = path if isinstance(path, str) else path[0]
    head = spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(first).limit(0).columns
    schema = StructType([StructField(c, StringType()) for c in head])
    df = spark.read.option("sep", "\t").option("header", True).option("escape", '"').schema(schema).csv(path).na.fill("")
    if columns:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def read_table(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files or folders, or TSV files, as one table; a path given twice is an error."""
    if len({os.path.normpath(p) for p in paths}) < len(paths):
        raise ContractError("a path is given twice")
    kinds = {p.rsplit(".", 1)[-1].lower() in ("tsv", "csv", "txt") for p in paths}
    if len(kinds) > 1:
        raise ContractError("TSV and Parquet can't be mixed")
    return read_tsv(spark, list(paths)) if kinds.pop() else spark.read.option("recursiveFileLookup", True).parquet(*paths)


def load_source(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A source table under its canonical names; empty or repeated ids are an error.

    ``rows`` keeps the records with the smallest ids.
    """
    raw = read_tsv(spark, path)
    require_columns(raw, ["entity_id"])
    made = {"entity_id": F.trim("entity_id"), "business_name": first_present(raw.columns, NAME_ALIASES), "business_address": first_present(raw.columns, ADDRESS_ALIASES), "country": first_present(raw.columns, COUNTRY_ALIASES)}
    rest = [c for c in raw.columns if c not in made]
    out = raw.select(*(e.alias(n) for n, e in made.items()), *rest)
    require_none(source_violations(out), path)
    return out.orderBy("entity_id").limit(rows) if rows is not None else out


def load_sources(spark: SparkSession, s1: str, s2: str, s3: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three sources; without a third path, an empty table like the second."""
    two = load_source(spark, s2)
    return load_source(spark, s1), two, load_source(spark, s3) if s3 else two.limit(0)


def edges_of(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """``source1_entity_id, candidate_entity_id`` of a list table, repeated ids once."""
    require_columns(lists, ["source1_entity_id", column])
    return lists.select(F.trim("source1_entity_id").alias("source1_entity_id"), F.explode(id_list(F.col(column))).alias("candidate_entity_id")).where("source1_entity_id <> ''").distinct()


def load_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries, those without matches included, and truth edges."""
    lists = read_tsv(spark, path)
    require_columns(lists, ["source1_entity_id", "matched_entity_ids"])
    return lists.select(F.trim("source1_entity_id").alias("source1_entity_id")).where("source1_entity_id <> ''").distinct(), edges_of(lists)


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from the long or the list form; empty ids are dropped."""
    return explode_candidates(read_table(spark, path))


def explode_candidates(raw: DataFrame) -> DataFrame:
    """Long pairs with ``position``, the place in their list."""
    alias = next((c for c in ("candidate_entity_id", "candidate_entity_ids", "candidate_id", "matched_entity_ids", "matched_entity_id") if c in raw.columns), None)
    if alias is None or "source1_entity_id" not in raw.columns:
        raise ContractError("no pairs in the table")
    rest = [c for c in raw.columns if c not in (alias, "source1_entity_id")]
    parts = F.transform(F.split(F.coalesce(alias, F.lit("")), ","), lambda x: F.trim(x))
    out = raw.select(F.trim("source1_entity_id").alias("source1_entity_id"), F.posexplode(parts).alias("position", "candidate_entity_id"), *rest)
    return out.where("source1_entity_id <> '' AND candidate_entity_id <> ''")


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ["entity_id", "fold"]).withColumn("fold", F.col("fold").cast(IntegerType()))


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``entity_id, country, business_name`` of S1; a table without countries has UNKNOWN ones."""
    raw = read_tsv(spark, path)
    country = F.trim("country") if "country" in raw.columns else F.lit("UNKNOWN")
    name = F.trim("business_name") if "business_name" in raw.columns else F.lit("")
    return raw.select(F.trim("entity_id").alias("entity_id"), country.alias("country"), name.alias("business_name")).where("entity_id <> ''")


def load_query_order(spark: SparkSession, path: str) -> DataFrame:
    """``position, source1_entity_id`` in the order of the lines; several files come in the order of their names.

    A split of a file has its name and first byte, and the lines of a split are
    numbered in order, whichever partition it's in. Only the number of lines of
    each split reaches the driver.
    """
    lines = read_tsv(spark, path, ["entity_id"]).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("line"), F.trim("entity_id").alias("source1_entity_id"))
    sizes = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).orderBy("file", "at").collect()
    starts, before = [], 0
    for row in sizes:
        starts.append((row["file"], row["at"], before - row["first"]))
        before += row["n"]
    base = spark.createDataFrame(starts, "file string, at long, base long")
    return lines.join(F.broadcast(base), ["file", "at"]).select((F.col("base") + F.col("line")).alias("position"), "source1_entity_id")


def write_single(df: DataFrame, path: str, order: str, overwrite: bool = False, header: bool = True) -> None:
    """One TSV file at a local path, in the order of a column that isn't written.

    Spark writes sorted parts to the shared folder; they're joined into a
    temporary file that then takes the path's name.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    spark = df.sparkSession
    folder = scratch_path(spark, "tsv")
    names = [c for c in df.columns if c != order]
    df.orderBy(order).select(*names).write.option("sep", "\t").option("emptyValue", "").option("nullValue", "").option("quote", "\u0000").option("escapeQuotes", False).csv(folder)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    lines = spark.read.text(folder).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "value").orderBy("f", "i")
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as out:
        if header:
            out.write("\t".join(names) + "\n")
        for row in lines.toLocalIterator():
            out.write(row["value"] + "\n")
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """The fixed candidate columns that the table has, as a folder of TSV parts."""
    candidates.select(*(c for c in CANDIDATE_COLUMNS if c in candidates.columns)).write.option("sep", "\t").option("header", True).option("emptyValue", "").mode("errorifexists").csv(path)


def write_folds(folds: DataFrame, path: str) -> None:
    write_single(folds.withColumn("_order", F.col("entity_id")), path, "_order", overwrite=True)


def write_grouped(df: DataFrame, path: str, key: list[str], target_rows: int = 75_000) -> None:
    """Parquet parts of about ``target_rows`` in which no group is split; an existing path is an error.

    A group's part is a hash bucket of its key, so no count of rows runs through
    one task; groups larger than the target make a larger part.
    """
    rows = df.count()
    buckets = max(1, -(-rows // target_rows))
    df.repartition(buckets, *key).sortWithinPartitions(*key).write.mode("errorifexists").parquet(path)


def split_groups(df: DataFrame, key: list[str]) -> DataFrame:
    """Groups that lie in more than one file of a written table; none if it was written by groups."""
    return df.withColumn("_file", F.input_file_name()).groupBy(*key).agg(F.count_distinct("_file").alias("files")).where("files > 1")


def whole_groups(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows arranged so that each group lies together in one partition."""
    return df.repartition(*key).sortWithinPartitions(*key)


def file_system(spark: SparkSession, path: str):
    """The store of a path, and the path in it; a path without a scheme lies where Spark looks for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # local files without checksum files beside them, which an editor wouldn't keep up
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    """JSON through a temporary file in the same folder; with a session in any store that Spark writes."""
    body = json.dumps(value, indent=2, sort_keys=True) + "\n"
    if spark:
        fs, where = file_system(spark, path)
        temporary = where.suffix(f".{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        fs.delete(where, False)
        if not fs.rename(temporary, where):
            raise OSError(f"can't write {path}")
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as out:
        out.write(body)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def publish_snapshot(df: DataFrame, path: str, order: str, rows: int) -> None:
    """An immutable snapshot of the first rows in an order; an existing one stays."""
    if not Path(path, "_SUCCESS").exists():
        shutil.rmtree(path, ignore_errors=True)
        df.orderBy(order).limit(rows).write.parquet(path)


def distinct_records(pairs: DataFrame) -> DataFrame:
    """Source records of pairs, once each."""
    return pairs.select(F.col("candidate_source").alias("source"), F.col("candidate_entity_id").alias("record_id")).dropDuplicates(["source", "record_id"])


def first_of_group(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def repeated_ids(df: DataFrame, key: list[str]) -> DataFrame:
    return repeated(df, key)

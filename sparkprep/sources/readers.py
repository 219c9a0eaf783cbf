"""Readers and writers: text lines, JSON records, packed Parquet rows, and split folders.

Paths go to Spark's readers as they are, so any store that Spark reads will do; nothing here opens files on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkprep.functions.arrays import valid_row

PACKED_COLUMNS = ["input_ids", "loss_mask", "seq_start_id"]
PACKED_SCHEMA = "input_ids array<int>, loss_mask array<tinyint>, seq_start_id array<int>"


def is_packed_path(path: str) -> bool:
    """Whether a name is that of a packed Parquet file, in any case."""
    return path.lower().endswith((".idx.parquet", ".idx.pq"))


def is_parquet_spec(spec: str) -> bool:
    """Whether a path is a Parquet file, a glob of such, or a folder of them by its ending slash."""
    name = spec.lower()
    return name.endswith((".parquet", ".pq")) or "*" in name and ".p" in name.rsplit("*", 1)[-1] or name.endswith("/")


def text_lines(spark: SparkSession, path: str, header_lines: int = 0) -> DataFrame:
    """(file, line_number, line): the lines of each file without its first ``header_lines`` and without blank lines at its end.

    Line numbers come from the byte offsets that whole-file reads keep in order, so each file is read by one task; use
    ``json_lines`` or ``spark.read.text`` where numbers aren't needed and files should be split.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\n+$", "").alias("value"))
    lines = whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("at", "line")).where(F.col("at") >= header_lines)
    return lines.select("file", (F.col("at") - header_lines).cast("long").alias("line_number"), "line")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One record for each line; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of JSON files that hold a list, an object with data, examples or records, or one record for each file."""
    whole = spark.read.text(path, wholetext=True)
    items = f"array<struct<{record}>>"
    wrapped = F.from_json("value", f"data {items}, examples {items}, records {items}")
    one = F.from_json("value", record)
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", items)).otherwise(F.coalesce(wrapped["data"], wrapped["examples"], wrapped["records"], F.array(one)))
    return whole.select(F.inline(found))


def packed_rows(spark: SparkSession, spec: str) -> DataFrame:
    """Packed rows with their three columns; a file without one of them is an error before any row is read."""
    rows = spark.read.parquet(spec)
    missing = [c for c in PACKED_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"{spec} has no columns {missing}")
    return rows.select(*PACKED_COLUMNS)


def checked(rows: DataFrame) -> DataFrame:
    """The packed rows; one that breaks the invariants is an error when it is read."""
    return rows.where(F.when(valid_row(F.col("input_ids"), F.col("loss_mask"), F.col("seq_start_id")), True).otherwise(F.raise_error("a packed row is broken").cast("boolean")))


def write_packed(rows: DataFrame, path: str, rows_per_file: int = 100_000, mode: str = "errorifexists") -> None:
    """Packed rows as Parquet with the types that readers expect."""
    typed = rows.select(F.col("input_ids").cast("array<int>"), F.col("loss_mask").cast("array<tinyint>"), F.col("seq_start_id").cast("array<int>"))
    typed.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_splits(rows: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> None:
    """JSON lines in one folder for each split, ``split=<name>``; folders that exist stay unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "ignore").partitionBy(split).json(path)


def located(files: DataFrame, name: str, rows: str) -> DataFrame:
    """Adds (first, last): the numbers of each file's rows when files follow one another by name. One row for each file."""
    w = Window.orderBy(name)
    total = F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumns({"first": total - F.col(rows), "last": total - 1})


def member_index(members: DataFrame, shard: str, key: Column, offset: str, size: Column) -> DataFrame:
    """(shard, key, offset, bytes): the members of an archive grouped by key; a group ends where the next one begins."""
    groups = members.groupBy(shard, key.alias("key")).agg(F.min(offset).alias("offset"))
    ends = members.groupBy(shard).agg(F.max(F.col(offset) + size).alias("end"))
    after = F.lead("offset").over(Window.partitionBy(shard).orderBy("offset"))
    return groups.withColumn("after", after).join(ends, shard).select(shard, "key", "offset", (F.coalesce("after", "end") - F.col("offset")).alias("bytes"))


def resolved(spark: SparkSession, spec: str) -> list[str]:
    """The Parquet files that a path stands for, in order: a file, those of a folder, or of a glob. None at all is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(spec)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(path) or []:
        held = files.listStatus(status.getPath()) if status.isDirectory() and not is_parquet_name(status.getPath().getName()) else [status]
        found += [x.getPath().toString() for x in held]
    found = sorted(x for x in found if is_parquet_name(x))
    if not found:
        raise ValueError(f"no Parquet files at {spec}")
    return found


def is_parquet_name(name: str) -> bool:
    return name.lower().endswith((".parquet", ".pq"))


def places(numbers: DataFrame, number: str, files: DataFrame) -> DataFrame:
    """Adds (file, row_in_file) to row numbers over files that follow one another: ``files`` is (file, first, last), a row for each file.

    Numbers and files meet in stretches as long as a file in the mean, so each number is compared with the few files of its stretch.
    """
    mean = files.agg(F.avg(F.col("last") - F.col("first") + 1)).first()[0]
    width = max(1, int(mean or 1))
    held = files.withColumn("stretch_", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"last div {width}"))))
    at = numbers.withColumn("stretch_", F.expr(f"{number} div {width}")).join(held, "stretch_").where(F.col(number).between(F.col("first"), F.col("last")))
    return at.withColumn("row_in_file", F.col(number) - F.col("first")).drop("first", "last", "stretch_")


def metadata(spark: SparkSession, folder: str, schema: str, extensions: tuple[str, ...], name: str = "meta.json") -> DataFrame:
    """(columns of ``schema``) of a folder: from its list of records, JSON or line by line, or else a row for each file by its extension.

    Broken lines of a file by lines are left out; ``spark.read`` with a corrupt-record column shows them.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    if not listed.isEmpty():
        text = listed.select(F.col("content").cast("string").alias("text"))
        items = F.from_json("text", f"array<struct<{schema}>>")
        whole = text.where(F.ltrim("text").startswith("[")).select(F.inline(items))
        lines = text.where(~F.ltrim("text").startswith("[")).select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
        read = lines.select(F.try_parse_json("line").isNotNull().alias("good"), F.from_json("line", schema).alias("r")).where("good").select("r.*")
        return whole.unionByName(read)
    first = schema.split()[0]
    pattern = "|".join(x.lstrip(".") for x in extensions)
    found = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias(first)).where(F.lower(first).rlike(rf"\.(?:{pattern})$"))
    rest = [f for f in spark.createDataFrame([], schema).schema if f.name != first]
    return found.select(first, *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))


def merge_text_files(spark: SparkSession, pattern: str, path: str, files: int) -> None:
    """The lines of many small text files as ``files`` larger ones; a file that doesn't end its last line doesn't run into the next."""
    spark.read.text(pattern).coalesce(files).write.text(path)


def write_json_lines(rows: DataFrame, path: str, fields: dict[str, Column], mode: str = "errorifexists") -> None:
    """Rows as JSON lines with the fields given, nested as their columns are."""
    rows.select(*(c.alias(k) for k, c in fields.items())).write.mode(mode).json(path)

"""Readers that turn files into lake tables: bundles, candidate folders, records, instances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinlift.functions import deal, finite, materialise, meet
from joinlift.functions.files import file_system
from joinlift.functions.spread import TASK_ROWS
from joinlift.schema import ALL_FEATURES, INSTANCE, RELATIVE_TARGETS, TRAINING_RECORD
from joinlift.sources import records

# File names and limits of a source bundle.
TABLE_FILE, DATASET_FILE, PROBLEM_FILE = "learningData.csv", "datasetDoc.json", "problemDoc.json"
TABLE_PATH = "tables/learningData.csv"

_DATASET_DOC = (
    "dataResources array<struct<resID string, resPath string, "
    "columns array<struct<colIndex int, colName string, colType array<string>>>>>")
_DATASET_DOC_ONE = _DATASET_DOC.replace("colType array<string>", "colType string")
_PROBLEM_DOC = ("about struct<taskType string>, inputs struct<data array<struct<"
                "targets array<struct<colIndex int, colName string>>>>>")


def plain_path(path: Column) -> Column:
    """A path as it is written on disk, in one form for all readers: decoded, with a single slash after the scheme."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(decoded, "^([a-z0-9]+):/+", "$1:/")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def dataset_of(path: Column) -> Column:
    """The dataset's name in a path of either layout.

    ``.../<name>/<name>_dataset/tables/learningData.csv`` (and ``<name>_problem``), or all three files
    directly under ``.../<name>/``.
    """
    nested = F.regexp_extract(path, r"/([^/]+)/[^/]+_(?:dataset|problem)/(?:tables/)?[^/]+$", 1)
    flat = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    return F.when(nested != "", nested).otherwise(flat)


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset_id, file, path)`` of all bundle files below ``root``; contents are not read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "{" + ",".join((TABLE_FILE, DATASET_FILE, PROBLEM_FILE)) + "}")
              .load(root).select("path", "length"))
    listed = listed.withColumn("path", F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"))
    return listed.select(dataset_of(F.col("path")).alias("dataset_id"),
                         F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length")


def _json_docs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(dataset_id, doc): one small JSON text per dataset."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
            .text(root, wholetext=True)
            .select(dataset_of(plain_path(F.col("_metadata.file_path"))).alias("dataset_id"), F.col("value").alias("doc")))


def columns_meta(spark: SparkSession, root: str) -> DataFrame:
    return parse_columns(_json_docs(spark, root, DATASET_FILE))


def problems(spark: SparkSession, root: str) -> DataFrame:
    return parse_problems(_json_docs(spark, root, PROBLEM_FILE))


def parse_columns(docs: DataFrame) -> DataFrame:
    """``(dataset_id, n_resources, col_index, col, col_type)`` from dataset documents.

    ``colType`` may be one string or a list of strings.
    """
    parsed = docs.select("dataset_id", F.from_json("doc", _DATASET_DOC).alias("m"),
                         F.from_json("doc", _DATASET_DOC_ONE).alias("o"))
    def table(doc):
        return F.get(F.filter(F.col(f"{doc}.dataResources"),
                              lambda r: r["resPath"] == TABLE_PATH), F.lit(0))["columns"]
    flat = parsed.select("dataset_id", F.size("o.dataResources").alias("n_resources"),
                         F.arrays_zip(table("o").alias("one"), table("m").alias("many")).alias("cs"))
    each = flat.select("dataset_id", "n_resources", F.explode_outer("cs").alias("c"))
    return each.select(
        "dataset_id", "n_resources", F.col("c.one.colIndex").alias("col_index"),
        F.col("c.one.colName").alias("col"),
        F.coalesce(F.col("c.many.colType"), F.array("c.one.colType")).alias("col_type"))


def parse_problems(docs: DataFrame) -> DataFrame:
    """``(dataset_id, task_type, target_index)``: the first target of the first input."""
    parsed = docs.select("dataset_id", F.from_json("doc", _PROBLEM_DOC).alias("p"))
    first = F.get(F.get(F.col("p.inputs.data"), F.lit(0))["targets"], F.lit(0))
    return parsed.select("dataset_id", F.col("p.about.taskType").alias("task_type"),
                         first["colIndex"].alias("target_index"))


def table_lines(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset_id, line)``: the text lines of every source table."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TABLE_FILE)
            .text(root).select(dataset_of(plain_path(F.col("_metadata.file_path"))).alias("dataset_id"),
                               F.col("value").alias("line")))


def table_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records of every source table (``records.records``) and ``(dataset_id, n_rows)``: null rows where a table cannot be read."""
    found, files = records.records(records.text_lines(spark, root, TABLE_FILE))
    n_rows = F.when(F.col("problem").isNull() & (F.col("n_records") > 0), F.col("n_records") - 1)
    return found, files.select(dataset_of(plain_path(F.col("path"))).alias("dataset_id"), n_rows.alias("n_rows"))


def is_numeric(col_type: Column) -> Column:
    return F.array_contains(col_type, "real") | F.array_contains(col_type, "integer")


def gate(files: DataFrame, meta: DataFrame, problem: DataFrame, row_counts: DataFrame, *,
         min_rows: int, max_columns: int, max_rows: int | None = None,
         ignore_first: bool = False) -> DataFrame:
    """``(dataset_id, reject_reason)``; the reason is null for a usable dataset.

    ``row_counts``: ``(dataset_id, n_rows)``, null where the table could not be parsed.
    ``max_rows``: rejects larger tables where it is given.
    """
    have = files.groupBy("dataset_id").agg(F.count_distinct("file").alias("n_files"))
    counted = meta if not ignore_first else meta.where("col_index <> 0")
    shape = counted.groupBy("dataset_id").agg(
        F.max("n_resources").alias("n_resources"),
        F.count_if(is_numeric(F.col("col_type"))).alias("n_numeric"))
    target = meta.join(problem, "dataset_id").where("col_index = target_index").select(
        "dataset_id", is_numeric(F.col("col_type")).alias("target_is_numeric"))
    all_ = (have.join(problem, "dataset_id", "left").join(shape, "dataset_id", "left")
            .join(target, "dataset_id", "left").join(row_counts, "dataset_id", "left"))
    left = F.least(F.coalesce("n_numeric", F.lit(0)) - 1, F.lit(max_columns - 1))
    reason = (F.when(F.col("n_files") < 3, "missing files")
              .when(F.coalesce("task_type", F.lit("")) != "regression", "not a regression")
              .when(F.col("n_resources") > 1, "several tables")
              .when(~F.coalesce("target_is_numeric", F.lit(True)), "target not numeric")
              .when(left <= 1, "too few columns")
              .when(F.col("n_rows").isNull(), "unreadable")
              .when(F.col("n_rows") < min_rows, "too few rows"))
    if max_rows is not None:
        reason = reason.when(F.col("n_rows") > max_rows, "too many rows")
    return all_.select("dataset_id", reason.alias("reject_reason"))


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")).agg(
        F.count(F.lit(1)).alias("n_datasets"))


def read_bundle(spark: SparkSession, root: str, ignore_first: bool = False,
                found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and column metadata of every bundle below ``root``.

    All tables are parsed in one scan: a record is split by the CSV rules and met with its dataset's column
    list, so one wide and one narrow table cost no separate jobs, and quoted fields may hold line breaks. ``row_ord`` is the
    place of the record in its file (the header is 0). ``found``: the records of ``table_records``, where they are at hand.
    """
    meta = columns_meta(spark, root).join(problems(spark, root), "dataset_id", "left")
    numeric = meta.where(is_numeric(F.col("col_type")))
    if ignore_first:
        numeric = numeric.where("col_index <> 0")
    lists = numeric.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("col_index", "col"))).alias("cols"))
    found = table_records(spark, root)[0] if found is None else found
    heads = found.where("row_ord = 0").select("path", dataset_of(plain_path(F.col("path"))).alias("dataset_id")).join(lists, "dataset_id")
    fields = records.with_header(found, heads)
    cells = fields.select("dataset_id", "row_ord", F.inline(F.transform("cols", lambda c: F.struct(
        c["col"].alias("col"), F.trim(F.get("fs", c["col_index"])).try_cast("double").alias("v")))))
    return cells.select("dataset_id", F.col("row_ord").cast("string").alias("row_key"), "row_ord", "col", "v"), meta


def _ranges(held: DataFrame, large: DataFrame) -> list[DataFrame]:
    """(dataset_id, files) of the large datasets: stored ranges of their lines, in order (an entry per range); none where no dataset is large."""
    if large.isEmpty():
        return []
    rows = meet(held, large, ["dataset_id"], ["row_ord"], "left_semi")
    parts = materialise(rows.repartitionByRange(-(-rows.count() // TASK_ROWS), "dataset_id", "row_ord").sortWithinPartitions("dataset_id", "row_ord"))
    of_file = parts.select("dataset_id", "row_ord", plain_path(F.col("_metadata.file_path")).alias("file")).groupBy("dataset_id", "file").agg(
        F.min("row_ord").alias("first"))
    files = of_file.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("first", "file"))).alias("files"))
    return [files.repartition(min(large.count(), 1_000), "dataset_id")]


def write_bundles(rows: DataFrame, docs: DataFrame, path: str) -> None:
    """Writes ``path/<dataset_id>/`` with the three files of a bundle.

    ``rows``: (dataset_id, row_ord, line), the lines of the tables, header first. ``docs``: (dataset_id, doc, problem), either null where a file
    is to be left out. A task streams the lines of its datasets to their files. Datasets of more than ``TASK_ROWS`` lines are first sorted in
    ranges of about so many, each in its own task; the task that writes the file reads them one after another.
    """
    held = materialise(rows.select("dataset_id", "row_ord", "line"))
    large = materialise(held.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS).select("dataset_id"))
    small = meet(held, large, ["dataset_id"], ["row_ord"], "left_anti")
    ordered = deal(small, ["dataset_id"]).sortWithinPartitions("dataset_id", "row_ord")

    def lines_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        name, out, done = None, None, []
        for batch in batches:
            for dataset, _, line in zip(*(c.to_pylist() for c in batch.columns)):
                if dataset != name:
                    if out:
                        out.close()
                    fs.create_dir(f"{at}/{dataset}", recursive=True)
                    name, out = dataset, fs.open_output_stream(f"{at}/{dataset}/{TABLE_FILE}", compression=None)
                    done.append(dataset)
                out.write((line + "\n").encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["dataset_id"])

    def ranges_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        for batch in batches:
            for dataset, files in zip(*(c.to_pylist() for c in batch.columns)):
                fs.create_dir(f"{at}/{dataset}", recursive=True)
                with fs.open_output_stream(f"{at}/{dataset}/{TABLE_FILE}", compression=None) as out:
                    for file in files:
                        source, where = file_system(file["file"])
                        with source.open_input_file(where) as opened:
                            for part in pq.ParquetFile(opened).iter_batches(10_000, columns=["dataset_id", "line"]):
                                own = part.filter(pc.equal(part["dataset_id"], dataset)).column("line").to_pylist()
                                out.write("".join(line + "\n" for line in own).encode())
            yield batch.select(["dataset_id"])

    def docs_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        for batch in batches:
            for dataset, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                fs.create_dir(f"{at}/{dataset}", recursive=True)
                for file, text in zip((DATASET_FILE, PROBLEM_FILE), texts):
                    if text is not None:
                        with fs.open_output_stream(f"{at}/{dataset}/{file}", compression=None) as out:
                            out.write(text.encode())
            yield batch.select(["dataset_id"])
    for written in (ordered.mapInArrow(lines_out, "dataset_id string"), *[d.mapInArrow(ranges_out, "dataset_id string") for d in _ranges(held, large)],
                    docs.select("dataset_id", "doc", "problem").mapInArrow(docs_out, "dataset_id string")):
        written.write.format("noop").mode("overwrite").save()


def ingest_candidates(spark: SparkSession, path: str, key: str | DataFrame, sep: str = ",", rename: bool = False,
                      named_by: str = "file", row_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells of a folder of candidate tables, one dataset per file (or per subfolder), and what became of each file.

    One scan reads files of any number of layouts: a record meets its own file's header. ``key`` is the name of the key column, or a table
    ``(dataset_id, key)`` with a name for each dataset. Infinite and missing values become 0; a row without any value is dropped.
    ``rename`` calls the value column after its file. ``row_id`` adds the record's place in its file, which tells rows of a
    repeated key apart.

    The second table is ``(dataset_id, path, key, n_rows, reason)``; ``reason`` is null for a file that was read, else one of
    ``empty file`` (blank lines only; Spark's readers do not list files of no bytes), ``unclosed quote``, ``no key column``, ``no value column``.
    """
    found, files = records.records(records.text_lines(spark, path))
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .where("length >= 0").select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("listed")))
    place = F.col("listed")
    ident = file_stem(place) if named_by == "file" else F.regexp_extract(place, r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    heads = records.headers(found, sep)
    known = files.join(heads, "path", "left").withColumn("listed", plain_path(F.col("path")))
    all_ = listed.join(known, "listed", "left").withColumn("dataset_id", ident)
    if isinstance(key, DataFrame):
        all_ = all_.join(key.select("dataset_id", F.col("key").alias("key")), "dataset_id", "left")
    else:
        all_ = all_.withColumn("key", F.lit(key))
    at = F.array_position("names", F.col("key")).cast("int") - 1
    reason = (F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.coalesce("n_records", F.lit(0)) == 0, "empty file")
              .when(F.coalesce(at, F.lit(-1)) < 0, "no key column").when(F.size("names") < 2, "no value column"))
    files = materialise(all_.select("dataset_id", "listed", "path", "key", (F.col("n_records") - 1).alias("n_rows"), "names", at.alias("at"),
                                    reason.alias("reason")))                             # one row per file
    column = (lambda v: F.col("dataset_id")) if rename else (lambda v: v["name"])
    named = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("name"), i.alias("i"))), lambda v: v["i"] != F.col("at"))
    met = records.with_header(found, files.where("reason is null").select("path", "dataset_id", "at", named.alias("cols")), sep)

    def value(v):
        return F.struct(column(v).alias("col"), finite(F.get("fs", v["i"]).try_cast("double")).alias("v"))
    rows = met.select("dataset_id", F.nullif(F.get("fs", F.col("at")), F.lit("")).alias("row_key"), F.col("row_ord").cast("string").alias("row_id"),
                      F.transform("cols", value).alias("vs"))
    kept = rows.where(F.col("row_key").isNotNull() | F.exists("vs", lambda v: v["v"].isNotNull()))
    ids = ["dataset_id", *(["row_id"] if row_id else []), "row_key"]
    cells = kept.select(*ids, F.inline("vs")).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return cells, files.select("dataset_id", F.col("listed").alias("path"), "key", "n_rows", "reason")


def read_candidates(spark: SparkSession, path: str, key: str | DataFrame, sep: str = ",", rename: bool = False,
                    named_by: str = "file", row_id: bool = False) -> DataFrame:
    """The cells of ``ingest_candidates``; an error where no file could be read."""
    cells, files = ingest_candidates(spark, path, key, sep, rename, named_by, row_id)
    if files.where("reason is null").isEmpty():
        raise ValueError(f"no file in {path} has its key column")
    return cells


def read_base(spark: SparkSession, path: str, key: str, name: str, sep: str = ",", row_id: bool = False) -> DataFrame:
    """Cells of one base table; columns that hold no numbers are left out by ``drop_empty``.

    ``row_id`` adds the place of a row in its file, for a base whose key repeats.
    """
    found, _ = records.records(records.text_lines(spark, path))
    at = F.array_position("names", F.lit(key)).cast("int") - 1
    named = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("name"), i.alias("i"))), lambda v: v["name"] != key)
    rows = records.with_header(found, records.headers(found, sep).select("path", at.alias("at"), named.alias("cols")), sep).select(
        F.lit(name).alias("dataset_id"), F.col("row_ord").cast("string").alias("row_id"),
        F.nullif(F.get("fs", F.col("at")), F.lit("")).alias("row_key"),
        F.inline(F.transform("cols", lambda v: F.struct(v["name"].alias("col"), F.get("fs", v["i"]).try_cast("double").alias("v")))))
    return rows if row_id else rows.drop("row_id")


def to_cells(df: DataFrame, key: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A wide table as cells; what is not a number becomes null."""
    values = [c for c in (columns or df.columns) if c != key]
    wide = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), *[
        F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in values])
    return wide.unpivot(["row_key"], [f"`{c}`" for c in values], "col", "v").select(
        F.lit(name).alias("dataset_id"), "row_key", "col", "v")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Training records: one JSON object per line, unknown fields ignored."""
    parsed = spark.read.text(path).where("trim(value) <> ''").select(
        F.from_json("value", TRAINING_RECORD).alias("r"))
    return parsed.select("r.*")


def record_pairs(records: DataFrame) -> DataFrame:
    """Records as pairs with one column per score, before and after."""
    names = {"mae": "mean_absolute_error", "mse": "mean_squared_error",
             "medae": "median_absolute_error", "r2": "r2_score"}
    return records.select(
        F.col("query_dataset").alias("query_id"), "target",
        F.col("candidate_dataset").alias("candidate_id"), "imputation_strategy", "mark",
        *[F.get(c, F.lit(i)).alias(f"{m}_{s}") for m, c in names.items()
          for i, s in enumerate(("before", "after"))])


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Learning instances from CSV, by column name: ids, features, relative targets."""
    known = {f.name: f.dataType for f in INSTANCE.fields}
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    return raw.select(*[
        F.col(c).cast(known[c]).alias(c) if c in known and isinstance(known[c], T.DoubleType)
        else F.col(c) for c in raw.columns])


def instance_parts(instances: DataFrame) -> DataFrame:
    """Ids, the feature array and the four targets."""
    present = [f for f in ALL_FEATURES if f in instances.columns]
    return instances.select("query", "target", "candidate", F.array(*present).alias("features"),
                            *[t for t in RELATIVE_TARGETS if t in instances.columns])


# ---- sinks -----------------------------------------------------------------------------------

def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object per line; field names repeat in each, so large sets are best compressed (``gzip``), which ``read_records`` reads too."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_instances(instances: DataFrame, path: str) -> None:
    instances.write.mode("overwrite").option("quoteAll", "true").csv(path, header=True)


def write_cells(cells: DataFrame, path: str, buckets: int = 64) -> None:
    """Cells by dataset bucket, so that a few datasets are read without the rest."""
    (cells.withColumn("bucket", F.pmod(F.xxhash64("dataset_id"), F.lit(buckets)).cast("int"))
     .repartition("bucket", F.pmod(F.xxhash64("row_key"), F.lit(16)))
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def stage(spark: SparkSession, path: str, make, reuse: bool = True) -> DataFrame:
    """A stage's stored result, or, where it has not finished before, its fresh one."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if not (reuse and done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- identity and clean-up -------------------------------------------------------------------

def content_ids(cells: DataFrame) -> DataFrame:
    """``(dataset_id, content_id)``: equal tables share an id, whatever their name or row order.

    The id folds a digest of every cell by xor (order-free and combined map-side), for two
    independent digests, with the number of cells.
    """
    text = F.concat_ws("|", "row_key", "col", F.coalesce(F.col("v").cast("string"), F.lit("")))
    def half(a):
        return F.conv(F.substring(F.md5(text), a, 15), 16, 10).cast("long")
    parts = cells.groupBy("dataset_id").agg(
        F.bit_xor(half(1)).alias("a"), F.bit_xor(half(16)).alias("b"),
        F.count(F.lit(1)).alias("n"))
    return parts.select("dataset_id", F.concat_ws("-", "a", "b", "n").alias("content_id"))


def rename_to_ids(records: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace dataset names in the listed columns by their content ids."""
    out = records
    for c in columns:
        out = out.join(ids.select(F.col("dataset_id").alias(c), F.col("content_id").alias("__id")),
                       c, "left").withColumn(c, F.coalesce("__id", c)).drop("__id")
    return out


def drop_empty(cells: DataFrame) -> DataFrame:
    """Without the columns that hold no number at all."""
    full = cells.groupBy("dataset_id", "col").agg(F.count("v").alias("c")).where("c > 0")
    return cells.join(full.select("dataset_id", "col"), ["dataset_id", "col"], "left_semi")


def numeric_columns(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Only the columns that the metadata calls real or integer."""
    kept = meta.where(is_numeric(F.col("col_type"))).select("dataset_id", "col").distinct()
    return cells.join(kept, ["dataset_id", "col"], "left_semi")


def normal_name(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[-_\s]", "-")


def drop_repeated_names(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """The candidate's cells without the columns whose normalised name the base also has."""
    taken = base.select(normal_name(F.col("col")).alias("__n")).distinct()
    kept = candidate.select("dataset_id", "col").distinct().withColumn(
        "__n", normal_name(F.col("col"))).join(taken, "__n", "left_anti")
    return candidate.join(kept.select("dataset_id", "col"), ["dataset_id", "col"], "left_semi")


def small_enough(meta: DataFrame, max_bytes: int) -> DataFrame:
    return meta.where(F.col("n_bytes") < max_bytes)

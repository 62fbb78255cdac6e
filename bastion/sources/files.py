"""Folder scan, text and CSV sources, metadata tagging.

The corpus layout is ``root/<department>/<file>``. Files are listed and read by
Spark's ``binaryFile`` source (distributed, one row per file); nothing is read on
the driver. Dispatch is on the case-sensitive suffix; unknown suffixes are
skipped; files that cannot be turned into text go to a rejects table instead of
failing the job.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".md", ".txt")
CSV_SUFFIXES = (".csv",)
EXTRACTED_ONLY = (".pdf",)  # page extraction is a per-file codec we do not ship


def _segments(path: str) -> int:
    return len([x for x in path.split("/") if x])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files exactly two levels below ``root`` with path, department, file_name, suffix, content.

    ``root`` may be relative, a URI, or hold doubled slashes: its depth is that of the path as the file
    system resolves it. Files of other suffixes are not read at all.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    resolved = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()
    known = ",".join(s[1:] for s in (*TEXT_SUFFIXES, *CSV_SUFFIXES, *EXTRACTED_ONLY))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{known}}}").load(f"{root.rstrip('/')}/*/*")
    bare = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    return (files.where(F.size(parts) == _segments(resolved) + 2)
            .select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file_name"),
                    "content")
            .withColumn("suffix", F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))


def tag(df: DataFrame) -> DataFrame:
    """file_name and source = file name; role and department = lower(folder)."""
    return (df.withColumn("source", F.col("file_name")).withColumn("role", F.lower("folder"))
              .withColumn("department", F.lower("folder")))


def text_documents(files: DataFrame) -> DataFrame:
    """A .md/.txt file is one document (whole file, UTF-8); ``error`` is set, and text null, where it is not UTF-8."""
    t = files.where(F.col("suffix").isin(*TEXT_SUFFIXES))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return t.select("path", "folder", "file_name", text.alias("text"),
                    F.when(text.isNull(), F.lit("not valid UTF-8")).alias("error"))


#: CSV rows handed on at a time.
CSV_BATCH = 2000


def _row_text(row: dict) -> str:
    """A CSV row as 'column: value' lines."""
    return "\n".join(f"{(k or '').strip()}: {(v or '').strip() if isinstance(v, str) else v}" for k, v in row.items())


def _csv_rows(batches):
    def rows(rec):
        try:
            reader = csv.DictReader(io.TextIOWrapper(io.BytesIO(rec.content), "utf-8", newline=""))
            for i, row in enumerate(reader):
                yield (rec.path, rec.folder, rec.file_name, i, _row_text(row), None)
        except Exception as exc:  # noqa: BLE001 — a bad file is reported, the job goes on
            yield (rec.path, rec.folder, rec.file_name, -1, None, f"{type(exc).__name__}: {exc}")

    def frame(out):
        return pd.DataFrame(out, columns=["path", "folder", "file_name", "row", "text", "error"])

    out = []
    for pdf in batches:
        for rec in pdf.itertuples(index=False):
            for row in rows(rec):
                out.append(row)
                if len(out) >= CSV_BATCH:
                    yield frame(out)
                    out = []
    if out:
        yield frame(out)


def csv_documents(files: DataFrame) -> DataFrame:
    """S3: one document per CSV row, text = 'column: value' lines; parse errors kept in ``error``.

    Each file is parsed inside a task with Python's csv module (quotes, embedded
    commas and newlines handled), its rows handed on in small batches; files are spread over
    tasks by the scan. Large files, and any above the binary source's 2 GB, are for :func:`split_csv_documents`.
    """
    c = files.where(F.col("suffix").isin(*CSV_SUFFIXES)).select("path", "folder", "file_name", "content")
    return c.mapInPandas(_csv_rows, "path string, folder string, file_name string, row int, text string, "
                                    "error string")


def large_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3 for one big file: Spark's own reader, which splits it (no line breaks inside quotes)."""
    rows = spark.read.csv(path, header=True, escape='"')
    lines = [F.concat(F.lit(f"{c.strip()}: "), F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))) for c in rows.columns]
    return rows.select(F.lit(path).alias("path"), F.concat_ws("\n", *lines).alias("text"))


# Regular expressions of a CSV line (fields end at a comma or a lone carriage return). What stands inside quotes up to
# its end; a field that is over; the beginning of a line up to a field that is still open.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"[^,\r]*+|[^",\r][^,\r]*+|)'
_OPEN = rf'(?:{_FIELD}[,\r])*+"{_INSIDE}'


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, text) of the records of CSV files, which Spark may have cut anywhere.

    A line maps the two states in which it can begin (outside or inside quotes) to the state in which it ends. Most lines
    keep or flip the state; a line that ends alike in both cases fixes it. The state before a line is therefore the value of the
    last fixing line, flipped as often as lines flipped it since: two running aggregates within a block, and one row a block
    to carry them from block to block. Lines are numbered by the records that begin before them and joined again.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    out = F.col("line").rlike(f"^{_OPEN}$")  # state at the end if it began outside
    ins = F.col("line").rlike(f"^{_INSIDE}$") | F.col("line").rlike(f'^{_INSIDE}"[^,\r]*+[,\r]{_OPEN}$')  # or inside
    plain = ~F.col("line").contains('"')
    line = line.withColumn("fixed", F.when(~plain & (out == ins), out.cast("int"))).withColumn("flips", F.when(~plain & out & ~ins, 1).otherwise(0))
    upto = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("flipped", F.sum("flips").over(upto))
    # the last line so far that fixed the state: its value and the flips until then
    seen = seen.withColumn("known", F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flipped")), ignorenulls=True).over(upto))
    ends = seen.groupBy("path", "block").agg(F.max_by(F.struct("known", "flipped"), "at").alias("end"))  # a row a block
    blocks = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = (ends.withColumn("total", F.coalesce(F.sum("end.flipped").over(blocks), F.lit(0)))
            .withColumn("mark", F.when(F.col("end.known").isNotNull(), F.struct(F.col("end.known.fixed").alias("fixed"), (
                F.col("total") + F.col("end.known.flipped")).alias("flipped"))))
            .withColumn("before", F.last("mark", ignorenulls=True).over(blocks)).select("path", "block", "total", "before"))
    state = lambda known, flips: F.pmod(known["fixed"] + flips - known["flipped"], F.lit(2))
    enters = F.when(F.col("before").isNotNull(), state(F.col("before"), F.col("total"))).otherwise(F.pmod("total", F.lit(2)))
    ends = ends.select("path", "block", enters.alias("enters"))
    # one row a split of a file is joined to its lines on the keys by which these are dealt already
    after = F.when(F.col("known").isNotNull(), state(F.col("known"), F.col("flipped"))).otherwise(F.pmod(F.col("enters") + F.col("flipped"), F.lit(2)))
    prior = Window.partitionBy("path", "block").orderBy("at")
    lines = (seen.join(ends, ["path", "block"]).withColumn("after", after)
             .withColumn("starts", (F.coalesce(F.lag("after").over(prior), F.col("enters")) == 0).cast("int")))
    lines = lines.withColumn("nth", F.sum("starts").over(upto)).select("path", "block", "at", "line", "starts", "nth")
    begun = lines.groupBy("path", "block").agg(F.sum("starts").alias("n"))
    begun = begun.select("path", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("earlier"))
    numbered = lines.join(begun, ["path", "block"]).select("path", (F.col("earlier") + F.col("nth") - 1).alias("record"), "block", "at", "line")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))  # the lines of one record
    return numbered.groupBy("path", "record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def _record_rows(record: int, first: int, header: str | None, text: str | None) -> list[tuple[int, str | None, str | None]]:
    """(part, text, error) of the rows of one record with its file's header, as ``_csv_rows`` words them."""
    if text is None:
        return [(0, None, "not valid UTF-8")]
    out = []
    try:
        names = next(csv.reader(io.StringIO(header, newline="")), [])
        rows = list(csv.reader(io.StringIO(text, newline="")))
        for i, row in enumerate(rows[1:] if record == first else rows):
            if row:
                cells = dict(zip(names, row)) | ({None: row[len(names):]} if len(row) > len(names) else dict.fromkeys(names[len(row):]))
                out.append((i, _row_text(cells), None))
    except Exception as exc:  # noqa: BLE001 — a bad record is reported, the job goes on
        out.append((0, None, f"{type(exc).__name__}: {exc}"))
    return out


def split_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3 for files of any size: (path, record, part, text, error), one row per CSV row, line breaks inside quotes included.

    Spark cuts a file where it likes; no task reads a whole file. ``record`` orders the rows of a file (``part`` where a lone
    carriage return divides a record). The rows equal those that Python's csv module finds in the whole file.
    """
    records = _csv_records(spark, path).withColumn("text", F.try_validate_utf8("text"))
    # the header is the first record that is not blank
    first = records.where(F.trim(F.regexp_replace("text", r"[\r\n]", "")) != "").groupBy("path").agg(
        F.min_by("text", "record").alias("header"), F.min("record").alias("first"))
    rows = records.join(first, "path").where(F.col("record") >= F.col("first"))
    # records go to Python a hundred at a time: an Arrow batch holds 10 000, however long
    parsed = F.udf(_record_rows, "array<struct<part:int,text:string,error:string>>", useArrow=False)
    return rows.select("path", "record", F.explode(parsed("record", "first", "header", "text")).alias("r")).select(
        "path", "record", "r.part", "r.text", "r.error")


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects). documents: path, file_name, source, role, department, row, text."""
    files = scan(spark, root)
    txt = text_documents(files).withColumn("row", F.lit(0))
    csvd = csv_documents(files)
    docs = txt.unionByName(csvd)
    good = tag(docs.where(F.col("error").isNull()).drop("error"))
    bad_csv = docs.where(F.col("error").isNotNull()).select("path", "file_name", F.col("error").alias("reason"))
    unsupported = files.where(F.col("suffix").isin(*EXTRACTED_ONLY)).select(
        "path", "file_name", F.lit("needs extracted text (PDF pages)").alias("reason"))
    return good, bad_csv.unionByName(unsupported)

"""Files written beside tables, and stores of vectors: distributed writers, mirrored folders, logs and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import sinks

#: The columns of a vector store, partitioned by store.
STORE = "chunk_id string, content string, embedding array<float>, metadata map<string,string>, store string"
BOM = b"\xef\xbb\xbf"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_files(files: DataFrame, folder: str, policy: str = "overwrite") -> DataFrame:
    """Writes rows (name, content: binary) as files under a folder that all executors share; name and what was done of each: written or there.

    skip leaves files that are there. A file is written under another name and renamed, so a task that is run again does no harm.
    """
    if policy not in ("overwrite", "skip"):
        raise ValueError(f"no policy {policy!r}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _filesystem(folder)
        for batch in batches:
            done = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = f"{base}/{name}"
                if policy == "skip" and store.get_file_info(path).type != fs.FileType.NotFound:
                    done.append("there")
                    continue
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{path}.part") as out:
                    out.write(bytes(content))
                store.move(f"{path}.part", path)
                done.append("written")
            yield pd.DataFrame({"name": batch["name"], "done": done})

    return files.select("name", "content").mapInPandas(write, "name string, done string")


def mirrored(path: Column, root: str, ending: str) -> Column:
    """The path relative to the root, with another ending: where its output stands under the output's root."""
    relative = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    return F.regexp_replace(F.ltrim(relative, F.lit("/")), r"\.[^./]*$|$", ending) if ending.startswith(".") else F.concat(F.regexp_replace(F.ltrim(relative, F.lit("/")), r"\.[^./]*$", ""), F.lit(ending))


def text_and_meta(pages: DataFrame, name: str, text: str, meta: list[str]) -> DataFrame:
    """Two files of each page: its text, and a JSON of its fields."""
    fields = F.to_json(F.struct(*meta), {"ignoreNullFields": "false"})
    pair = F.array(F.struct(F.concat(name, F.lit(".txt")).alias("name"), F.encode(F.col(text), "UTF-8").alias("content")), F.struct(F.concat(name, F.lit("_meta.json")).alias("name"), F.encode(fields, "UTF-8").alias("content")))
    return pages.select(F.explode(pair).alias("f")).select("f.*")


def csv_line(columns: list[str], separator: str = ",", quoted: bool = True) -> Column:
    """A line of values; quoted where needed, or, if not quoted, with separators inside as spaces."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if not quoted:
        return F.concat_ws(separator, *[F.translate(cell(c), separator, " ") for c in columns])
    needs = lambda v: v.rlike(f'["\\n\\r{separator}]')
    return F.concat_ws(separator, *[F.when(needs(cell(c)), F.concat(F.lit('"'), F.replace(cell(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell(c)) for c in columns])


def csv_files(rows: DataFrame, name: str, position: str, columns: list[str], bom: bool = True, quoted: bool = True) -> DataFrame:
    """One CSV of each name, with a header and, if asked for, a byte order mark: for readers that need one file, such as spreadsheets.

    A name's lines meet in one task: for tables of a page or a statement, not of a corpus.
    """
    lines = F.array_sort(F.collect_list(F.struct(position, csv_line(columns, quoted=quoted).alias("line"))))
    body = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n"))
    encoded = F.encode(body, "UTF-8")
    return rows.groupBy(name).agg((F.concat(F.lit(BOM), encoded) if bom else encoded).alias("content")).select(F.col(name).alias("name"), "content")


def triples(rows: DataFrame, name: str, position: str, columns: list[str]) -> DataFrame:
    """TXT, JSON and CSV of each name's rows."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(position, c.alias("x")))), lambda r: r["x"])
    found = rows.groupBy(name).agg(F.array_join(ordered(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), "\n").alias("txt"), F.to_json(ordered(F.struct(*columns)), {"ignoreNullFields": "false"}).alias("json"), F.array_join(ordered(csv_line(columns)), "\n").alias("lines"))
    files = {"txt": F.col("txt"), "json": F.col("json"), "csv": F.concat(F.lit(",".join(columns) + "\n"), "lines")}
    each = F.array(*[F.struct(F.concat(name, F.lit(f".{e}")).alias("name"), F.encode(c, "UTF-8").alias("content")) for e, c in files.items()])
    return found.select(F.explode(each).alias("f")).select("f.*")


def without_header(old: Column, new: Column, header_lines: int = 2) -> Column:
    """An aligned table with another appended, whose header lines are left out."""
    body = F.array_join(F.slice(F.split(new, "\n"), header_lines + 1, F.size(F.split(new, "\n"))), "\n")
    return F.when(old.isNull(), new).otherwise(F.concat(F.rtrim(old, F.lit("\n")), F.lit("\n"), body))


def appended_typed(df: DataFrame, path: str) -> None:
    """Appends rows in the types of the table that is there: a column of another type is cast, and one that doesn't fit raises."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    sinks.write(df if there is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in there.schema.fields]), path, "append")


def mismatch_log(checks: DataFrame, keys: list[str]) -> DataFrame:
    """A line for each total that disagrees with its parts."""
    text = F.concat(F.lit("["), F.concat_ws("/", *keys), F.lit("] "), "parent", F.lit(": "), F.coalesce(F.col("observed").cast("string"), F.lit("")), F.lit(" ≠ "), F.col("children_sum").cast("string"))
    return checks.where("not ok").select(*keys, "parent", text.alias("line"))


def unknown_words(cleaned: DataFrame) -> DataFrame:
    """word, n of the words that no dictionary entry was similar to, counted over all rows of advanced_clean."""
    return cleaned.select(F.explode("unknown").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def run_report(rows: DataFrame, code: str, values: list[str], config: dict, sample: int = 5) -> DataFrame:
    """One row: counts, the codes met more than once with their counts, a sample of the first rows by code, and the configuration as JSON."""
    from ledgerloom.operators.lines import parse_report

    repeated = rows.where(F.col(code).isNotNull()).groupBy(code).count().where("count > 1")
    codes = repeated.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(code), "count"))))).alias("repeated_codes"))
    first = rows.orderBy(code, *values).limit(sample).agg(F.to_json(F.array_sort(F.collect_list(F.struct(code, *values)))).alias("sample"))
    return parse_report(rows, code, values).join(codes).join(first).withColumn("config", F.lit(json.dumps(config, sort_keys=True, ensure_ascii=False)))


def append_to_store(chunks: DataFrame, path: str, store: str, run: str | None = None) -> str:
    """Appends chunks (chunk_id, content, embedding, metadata) to a store, a partition of the table; new ids only. Gives the run's name.

    Each run overwrites a partition of its own, and leaves it out of what it compares with: given its name, a run can be
    repeated, whole or after a failure, and writes the same once. Runs at the same time write apart, and neither sees
    the other, so they may both bring an id; open_store then shows the row of the run whose name comes first. Of rows of
    a run that share an id one is kept. Null ids aren't kept.
    """
    run = run or uuid.uuid4().hex
    spark = chunks.sparkSession
    ready = chunks.select("chunk_id", "content", F.col("embedding").cast("array<float>"), F.col("metadata").cast("map<string,string>"), F.lit(store).alias("store"), F.lit(run).alias("run"))
    ready = ready.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    there = _runs(spark, path)
    if there is not None:
        ready = ready.join(there.where((F.col("store") == store) & (F.col("run") != run)).select("chunk_id"), "chunk_id", "left_anti").select(*ready.columns)
    ready.drop("store", "run").write.mode("overwrite").parquet(f"{path}/store={_escaped(store)}/run={_escaped(run)}")
    return run


def _escaped(value: str) -> str:
    """A value as Spark writes it in the name of a partition."""
    return "".join(c if c.isalnum() or c in "-_. " else f"%{ord(c):02X}" for c in value) if value.isascii() else "".join(c if c not in "\"#%'*/:=?\\{[]^" else f"%{ord(c):02X}" for c in value)


def _runs(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of a table of stores with their runs; None where the folder isn't there."""
    try:
        return spark.read.schema(f"{STORE}, run string").option("basePath", path).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def open_store(spark: SparkSession, path: str, store: str | None = None, fallback: str | None = None) -> DataFrame | None:
    """A store's chunks, all stores' if none is named; where the folder isn't there the fallback's, and None where neither is.

    An id that two runs at the same time brought is there once: only ids are compared for that, and the rest stays where it is.
    """
    for folder in filter(None, (path, fallback)):
        found = _runs(spark, folder)
        if found is None:
            continue
        found = found if store is None else found.where(F.col("store") == store)
        twice = found.groupBy("store", "chunk_id").agg(F.min("run").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("store", "chunk_id", "first")
        seen = found.join(twice, ["store", "chunk_id"], "left").where("first is null or first = run")
        return seen.select("chunk_id", "content", "embedding", "metadata", "store")
    return None


def store_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, and those of tables, of each store."""
    return chunks.groupBy("store").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("metadata")["type"] == "table").alias("n_tables"))

"""Table sinks and scans as pure functions of DataFrames: upserts, replacement, paging, samples, checks.

Each takes a snapshot and a batch and returns the new snapshot, so that it serves batch
jobs and foreachBatch alike.  Keys that are null never match and are kept as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(columns) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in columns]


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row with the highest order of each key.  max_by aggregates before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*_order(order), F.struct(*rest).alias("_rest"))).alias("_top"))
    return picked.select(*keys, "_top._rest.*").select(*df.columns)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins; on equal order the batch does."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both, keys, [*order, "_batch"]).drop("_batch")


def insert_if_absent(existing: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, inserted rows); of equal keys in the batch one is inserted, the one with the smallest other columns."""
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else batch.distinct()
    new = one.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True), new


def observe(existing: DataFrame, batch: DataFrame, keys: list[str], first: str, last: str, at: str) -> DataFrame:
    """Ledger of first and last observation: history and batch in one aggregation."""
    seen = existing.select(*keys, first, last).unionByName(batch.select(*keys, F.col(at).alias(first), F.col(at).alias(last)))
    return seen.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))


def replace_by_key(existing: DataFrame, batch: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """All rows of the replaced keys give way to the batch; a key may be replaced by nothing."""
    gone = (replaced if replaced is not None else batch).select(key).distinct()
    return existing.join(gone, key, "left_anti").unionByName(batch)


def delete_by_key(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def take(queue: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Delete and return: (taken, remaining)."""
    return queue.join(chosen.select(key), key, "left_semi"), queue.join(chosen.select(key), key, "left_anti")


def page_by_offset(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset paging: no row before the page is sorted."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in an order that is random but the same each time."""
    return df.orderBy(F.sha2(key, 256), key).limit(n)


def sample_blocks(df: DataFrame, key: str, below: str) -> DataFrame:
    """Rows whose hash starts below a hexadecimal bound: the same share of every block."""
    return df.where(F.substring(F.sha2(key, 256), 1, len(below)) < below)


def max_normalized(df: DataFrame, column: str) -> DataFrame:
    """Scores divided by their maximum if it is positive; the maximum is one row."""
    top = df.agg(F.max(column).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(F.col(column))).drop("_top")


def merge_schema(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Additive evolution: columns missing on either side are null."""
    return existing.unionByName(batch, allowMissingColumns=True)


def row_numbers(df: DataFrame, partition: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def footer_rows(spark, path: str) -> DataFrame:
    """(n): rows of a Parquet table by the footers of its files, read by the tasks; no column is scanned."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def count(parts):
        from pyarrow import fs, parquet

        for p in parts:
            sizes = []
            for name in p["path"]:
                # Spark writes file: where others write file://
                system, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if not name.startswith("file://") and name.startswith("file:") else name)
                with system.open_input_file(at) as f:
                    sizes.append(parquet.ParquetFile(f).metadata.num_rows)
            yield pd.DataFrame({"n": sizes})

    return files.mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table as a whole; the old one stays until the new one is complete."""
    from ..session import file_system

    df.write.mode("overwrite").parquet(f"{path}.new")
    fs, old = file_system(df.sparkSession, path)
    fs.delete(old, True)
    fs.rename(file_system(df.sparkSession, f"{path}.new")[1], old)


def append(df: DataFrame, path: str, batch: str) -> None:
    """Appends a named batch to a Parquet log; a batch that is tried again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def rebuild(rows: DataFrame, key: str, path: str, parts: int, until: int | None = None) -> int:
    """Writes rows in so many parts by the hash of a key and skips those that are complete; returns how many it wrote.

    `until` ends it early, as when it is broken off."""
    from ..session import file_system

    spark, done = rows.sparkSession, 0
    for k in range(parts if until is None else until):
        fs, mark = file_system(spark, f"{path}/part={k}/_SUCCESS")
        if not fs.exists(mark):
            rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k).write.mode("overwrite").parquet(f"{path}/part={k}")
            done += 1
    return done


def bulk_write(existing: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, one row with `written`): rows of the batch replace those with their key; a row with a null key isn't written."""
    good = batch.where(F.col(key).isNotNull())
    return existing.join(good.select(key), key, "left_anti").unionByName(good, allowMissingColumns=True), good.agg(F.count("*").alias("written"))


def bulk_delete(existing: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, one row with `deleted` keys, one with `ignored` keys that nothing has)."""
    gone = keys.select(key).where(F.col(key).isNotNull()).distinct()
    held = gone.join(existing.select(key), key, "left_semi")
    return existing.join(gone, key, "left_anti"), held.agg(F.count("*").alias("deleted")), gone.join(existing.select(key), key, "left_anti").agg(F.count("*").alias("ignored"))

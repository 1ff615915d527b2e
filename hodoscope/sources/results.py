"""Re-reading stage results, with the checks their readers make, and layout dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodoscope.schemas import schema


def _need(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks; t0 and has_t0 may be missing."""
    df = _need(spark.read.parquet(path), ["entry", "track_index", "kx", "ky", "bx", "by"], "tracks")
    for n, v in (("t0", F.lit(None).cast("double")), ("has_t0", F.lit(False)), ("raw_event_id", F.col("entry"))):
        df = df if n in df.columns else df.withColumn(n, v)
    return df


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """Tracker validation rows; a track with two raw event ids is an error when the table is used."""
    df = _need(spark.read.parquet(path), ["entry", "raw_event_id", "track_index", "det", "res_x", "res_y", "cluster_indices"], "validation")
    bad = df.groupBy("entry", "track_index").agg(F.count_distinct("raw_event_id").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"track {bad[0]['entry']}/{bad[0]['track_index']} has several raw event ids")
    return df


def read_dut_rows(spark: SparkSession, path: str) -> DataFrame:
    """DUT rows of either layout in a common shape: strips have cluster_x and cluster_y, pads one cluster for both."""
    df = spark.read.parquet(path)
    if "cluster_x" not in df.columns:
        df = _need(df, ["cluster_idx", "hit_flag"], "pad DUT rows").withColumns({"cluster_x": F.col("cluster_idx"), "cluster_y": F.col("cluster_idx"), "hit_flag": F.when(F.col("hit_flag") != 0, 3).otherwise(0)})
    return df.select(*[n for n in schema("DUT_ROWS").names if n in df.columns])


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """Scope events: the compact layout has reference_time; the older one has validity per channel and stored resolutions."""
    df = spark.read.parquet(path)
    if "reference_time" in df.columns:
        return df
    _need(df, ["event_id", *[f"c{k}_{n}" for k in (1, 2, 3) for n in ("time", "valid", "resolution")]], "scope events")
    w = [F.when(F.col(f"c{k}_valid"), 1 / (F.col(f"c{k}_resolution") ** 2)) for k in (1, 2, 3)]
    total = w[0] + w[1] + w[2]
    return df.withColumn("reference_time", sum((F.col(f"c{k}_time") * v for k, v in enumerate(w, 1)), F.lit(0.0)) / total).where("reference_time IS NOT NULL")


def read_runs(spark: SparkSession, path: str, runs: list[int] | None = None) -> DataFrame:
    """A result table of many runs, partitioned by run_id; the filter prunes folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("run_id").isin(*runs)) if runs else df


def write(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = True) -> None:
    w = df.write.mode("overwrite" if overwrite else "error")
    (w.partitionBy(*by) if by else w).parquet(path)


def parameters(spark: SparkSession, values: dict) -> DataFrame:
    """Fits and other nested results of a run as rows (path, value): keys and list places joined by dots; numbers only."""
    rows: list[tuple[str, float]] = []

    def add(path: str, v: object) -> None:
        if isinstance(v, dict):
            for k, w in v.items():
                add(f"{path}.{'-'.join(map(str, k)) if isinstance(k, tuple) else k}", w)
        elif isinstance(v, list | tuple):
            for i, w in enumerate(v):
                add(f"{path}.{i}", w)
        elif isinstance(v, int | float):
            rows.append((path, float(v)))

    for name, v in values.items():
        add(name, v)
    return spark.createDataFrame(rows, "path string, value double")


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    """The stored fits of a run by path, e.g. "hat.pairs.1-2.sigma"."""
    return {r["path"]: r["value"] for r in _need(spark.read.parquet(path), ["path", "value"], "parameters").collect()}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

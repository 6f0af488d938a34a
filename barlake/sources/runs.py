"""Committed run outputs (K3-K8): tables of one run that readers see all at once or not at all.

A run's tables are written under ``root/<run_id>/``; nothing reads them there by listing. The last
step writes a manifest, ``root/_manifests/<run_id>.json``, first under a name that readers
ignore and then renamed, with every table's format and schema. Readers go through the
manifest, so a run that failed half-way, or is being written, is never read.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")
#: null and the empty text stay apart; quotes, line ends and outer blanks stay in their values
TEXT = dict(header=True, nullValue="\\N", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def run_stamp() -> str:
    """K5: the time of the run, to the microsecond, in an order that sorts."""
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(sc._jsc.hadoopConfiguration()), hpath


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: one of {FORMATS}")
    w = df.write.mode("error")
    if fmt == "csv":
        w = w.options(**TEXT, quoteAll=True)
    (w.option("ignoreNullFields", False) if fmt == "json" else w).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = r.options(**TEXT, multiLine=True)
    return r.format(fmt).load(path)


class RunWriter:
    """Tables of one run; readers see them after :meth:`commit`."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None):
        self.spark, self.root, self.run_id, self.tables = spark, root.rstrip("/"), run_id or run_stamp(), {}
        fs, manifest = _hadoop(spark, self._manifest())
        if fs.exists(manifest):
            raise FileExistsError(f"run {self.run_id} is committed already")

    def _manifest(self, prefix: str = "") -> str:
        return f"{self.root}/_manifests/{prefix}{self.run_id}.json"

    def write(self, name: str, df: DataFrame, fmt: str = "parquet") -> "RunWriter":
        write_table(df, f"{self.root}/{self.run_id}/{name}", fmt)
        self.tables[name] = {"format": fmt, "schema": df.schema.jsonValue()}
        return self

    def commit(self) -> str:
        fs, staged = _hadoop(self.spark, self._manifest("_staged_"))
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps({"run": self.run_id, "tables": self.tables}).encode()))
        finally:
            out.close()
        if not fs.rename(staged, _hadoop(self.spark, self._manifest())[1]):
            raise FileExistsError(f"run {self.run_id} is committed already")
        return self.run_id

    def abort(self) -> None:
        """Deletes what a failed run has written."""
        fs, folder = _hadoop(self.spark, f"{self.root}/{self.run_id}")
        fs.delete(folder, True)

    def __enter__(self) -> "RunWriter":
        return self

    def __exit__(self, kind, *_) -> None:
        self.abort() if kind else self.commit()


def committed_runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of the committed runs, oldest first."""
    fs, folder = _hadoop(spark, f"{root.rstrip('/')}/_manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n[:-5] for n in names if n.endswith(".json") and not n.startswith(("_", ".")))


def read_run(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of a committed run, by default of the newest; an error if there is none."""
    runs = committed_runs(spark, root)
    run_id = run_id or (runs[-1] if runs else None)
    if run_id not in runs:
        raise FileNotFoundError(f"no committed run {run_id or ''} under {root}")
    root = root.rstrip("/")
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{root}/_manifests/{run_id}.json").collect()))
    if name not in manifest["tables"]:
        raise KeyError(f"run {run_id} has no table {name}: {sorted(manifest['tables'])}")
    table = manifest["tables"][name]
    return read_table(spark, f"{root}/{run_id}/{name}", table["format"], T.StructType.fromJson(table["schema"]))


def write_evaluation(metrics: DataFrame, summary: DataFrame, ranking: DataFrame, root: str, run_id: str | None = None) -> str:
    """K7: metrics as Parquet and JSON, the summary and the ranking as CSV, one committed run."""
    with RunWriter(metrics.sparkSession, root, run_id) as run:
        run.write("metrics", metrics).write("metrics_json", metrics, "json")
        run.write("summary", summary.coalesce(1), "csv").write("ranking", ranking.coalesce(1), "csv")
    return run.run_id

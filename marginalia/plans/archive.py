"""Archive run: keep the old files, say what was done, write the cleaned ones.

Tables below the archive root, one folder per run:

``code_archive``     rel_dir, name, text          the files as they were
``operation_index``  rel_path, label, line        what was done to each
``summary``          rel_path, json               every removed comment
``summary_names``    rel_path, summary_name       the name of each file's summary
``changes``          path, html                   the files with their comments highlighted
``runs``             files, matching_files, occurrences    what a finished run has seen

Names need the files of one stem together, comments do not: they are written apart, so that no comment text is
shuffled, and ``read_summaries`` puts them together.

A run counts once its row in ``runs`` is there, which is written last: readers leave out what a run that was cut short
has written. Writing a run again takes that row away first and replaces the run's folders.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths, scan, times
from marginalia.operators import files
from marginalia.operators.naming import summary_names
from marginalia.plans.preview import nothing_found
from marginalia.plans.workspace import drop, shared_dir
from marginalia.rules import JobConfig, root_path

CODE_ARCHIVE = "code_archive"
OPERATION_INDEX = "operation_index"
SUMMARY = "summary"
SUMMARY_NAMES = "summary_names"
CHANGES = "changes"
RUNS = "runs"


@dataclass(frozen=True)
class RunResult:
    """A finished run: its name, the files under the path rules, those of them with a wanted ending, and the occurrences."""

    run_id: str
    files: int
    matching_files: int
    occurrences: int


def new_run_id(spark: SparkSession) -> str:
    """Name of a run that starts now, in local time."""
    return spark.range(1).select(times.run_id(times.local_now_millis())).first()[0]


def summary_json(rel_path: Column, path: Column, items: Column) -> Column:
    """Field names and their order are part of the format."""
    listed = F.transform(
        items,
        lambda item: F.struct(
            path.alias("filePath"),
            item["pos"].alias("pos"),
            item["lines"].alias("lines"),
            item["comment_text"].alias("commentText"),
        ),
    )
    return F.to_json(F.struct(rel_path.alias("relativePath"), listed.alias("items")))


def scanned_run(sources: DataFrame, config: JobConfig) -> DataFrame:
    """Selected files with comments: path, rel_path, segments, cleaned, comments, label."""
    chosen = files.select_files(sources, config).select("path", "text")
    rel_path = paths.forward_slashes(paths.relative(F.col("path"), config.base))
    return files.clean_files(files.commented_files(chosen, config.comments)).withColumn("rel_path", rel_path)


def routed_run(sources: DataFrame, config: JobConfig) -> DataFrame:
    """Every file of the tree: the columns of ``scanned_run`` for those with comments, path, rel_path and text for the
    others, and ``found`` to tell them apart. One scan of each text."""
    path, text = F.col("path"), F.col("text")
    touched = files.wanted(path, config) & scan.has_start_tag(text, config.comments)
    pieces = F.when(F.coalesce(touched, F.lit(False)), scan.cut(text, config.comments))
    # A generator gives the pieces to all that follows; as a plain column they would be worked out for each of them.
    cut = sources.select("path", "text", F.inline(F.array(F.struct(pieces.alias("segments")))))
    found = F.coalesce(F.size("segments") > 1, F.lit(False))
    marked = cut.withColumn("found", found).withColumn("segments", F.when(found, F.col("segments")))
    rel_path = paths.forward_slashes(paths.relative(path, config.base))
    labelled = files.clean_files(marked).withColumns({"rel_path": rel_path, "text": F.when(~F.col("found"), text)})
    return labelled.withColumns({c: F.when(F.col("found"), F.col(c)) for c in ("cleaned", "comments", "label")})


def code_archive(run: DataFrame) -> DataFrame:
    rel_dir = F.coalesce(paths.parent(F.col("rel_path")), F.lit(""))
    return run.select(
        rel_dir.alias("rel_dir"),
        paths.file_name(F.col("rel_path")).alias("name"),
        F.array_join("segments", "").alias("text"),
    )


def operation_index(run: DataFrame) -> DataFrame:
    return run.select("rel_path", "label", F.concat_ws(":", "rel_path", "label").alias("line"))


def summary(run: DataFrame) -> DataFrame:
    items = scan.occurrences(F.col("segments"))
    return run.select("rel_path", summary_json(F.col("rel_path"), F.col("path"), items).alias("json"))


def named_summaries(run: DataFrame) -> DataFrame:
    names = summary_names(run.select("path"))
    return run.select("path", "rel_path").join(names, "path").select("rel_path", "summary_name")


def changes(run: DataFrame) -> DataFrame:
    """Markup per file, or one row that says there is nothing."""
    return files.file_markup(run).unionByName(nothing_found(run))


def snapshot(run: DataFrame) -> DataFrame:
    """Cleaned files; the ones that held nothing but comments are gone."""
    return run.where(~files.is_emptied(F.col("cleaned"))).select("path", "rel_path", F.col("cleaned").alias("text"))


def archive_run(
    spark: SparkSession,
    sources: DataFrame,
    config: JobConfig,
    run_id: str | None = None,
    snapshot_path: str | None = None,
    whole_tree: bool = False,
) -> str:
    """Archive the selected files and write their cleaned texts below ``snapshot_path``; returns the run's name."""
    return archive(spark, sources, config, run_id, snapshot_path, whole_tree).run_id


def archive(
    spark: SparkSession,
    sources: DataFrame,
    config: JobConfig,
    run_id: str | None = None,
    snapshot_path: str | None = None,
    whole_tree: bool = False,
) -> RunResult:
    """Like ``archive_run``; returns the run's totals as well, which the scan of the sources counts on its way.

    With ``whole_tree`` the snapshot holds the files without comments and those that the rules leave out as well. They
    are found in the same scan: it writes every file once, commented ones to a folder of the staging table and all
    others to another.

    The scanned files are written to a table in the shared folder, which goes when the run is over, and every
    output reads just the columns it needs from there: a lost executor costs a piece of that table, never the scan.
    """
    target = snapshot_path or f"{config.archive_root}/snapshot"
    if config.base and f"{root_path(target)}/".startswith(f"{config.base}/"):
        raise ValueError("cleaned files are never written into the source tree")
    run_id = run_id or new_run_id(spark)
    drop(spark, f"{config.archive_root}/{RUNS}/run_id={run_id}")
    staging = shared_dir(spark)
    seen, found = Observation(), Observation()
    path = F.col("path")
    under, chosen = paths.passes(path, config.base, config.paths), files.wanted(path, config)
    counted = sources.select("path", "text").observe(seen, F.count_if(under).alias("files"), F.count_if(chosen).alias("matching_files"))
    routed = routed_run(counted, config) if whole_tree else scanned_run(counted, config).withColumn("found", F.lit(True))
    routed.observe(found, F.sum("comments").alias("occurrences")).write.partitionBy("found").parquet(staging)
    staged = spark.read.schema(f"{_schema(routed)}, found boolean").parquet(staging)
    run = staged.where("found").drop("found", "text")

    def write(frame: DataFrame, table: str) -> None:
        frame.write.mode("overwrite").parquet(f"{table}/run_id={run_id}")

    outputs = {
        CHANGES: changes(run),
        CODE_ARCHIVE: code_archive(run),
        OPERATION_INDEX: operation_index(run),
        SUMMARY: summary(run),
        SUMMARY_NAMES: named_summaries(run),
    }
    # The tables do not depend on each other, so one may use the cores that another leaves idle.
    with ThreadPoolExecutor(len(outputs)) as pool:
        list(pool.map(write, outputs.values(), (f"{config.archive_root}/{table}" for table in outputs)))
    # Cleaned files come last: they exist only if the old ones are safe.
    cleaned = snapshot(run)
    if whole_tree:
        cleaned = cleaned.unionByName(staged.where("not found").select("path", "rel_path", "text"))
    write(cleaned, target)
    totals = seen.get | found.get
    result = RunResult(run_id, totals["files"], totals["matching_files"], totals["occurrences"] or 0)
    row = (result.files, result.matching_files, result.occurrences)
    write(spark.createDataFrame([row], "files long, matching_files long, occurrences long").coalesce(1), f"{config.archive_root}/{RUNS}")
    drop(spark, staging)
    return result


def _schema(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "found")


def finished_runs(spark: SparkSession, root: str) -> DataFrame:
    """run_id, files, matching_files and occurrences of every finished run."""
    rows = spark.read.schema("run_id string, files long, matching_files long, occurrences long").parquet(f"{root}/{RUNS}")
    return rows.select("run_id", "files", "matching_files", "occurrences")


def _is_finished(spark: SparkSession, root: str, run_id: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{RUNS}/run_id={run_id}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_archive(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A table of the archive with the ``run_id`` of each row; naming a run opens that run's folder only.

    Runs that have not been finished are left out; naming such a run is an error.
    """
    if run_id is not None and not _is_finished(spark, root, run_id):
        raise LookupError(f"no finished run {run_id} in {root}")
    where = f"{root}/{table}" if run_id is None else f"{root}/{table}/run_id={run_id}"
    frame = spark.read.option("basePath", f"{root}/{table}").parquet(where)
    frame = frame.withColumn("run_id", F.col("run_id").cast("string"))
    return frame if run_id is not None else frame.join(finished_runs(spark, root).select("run_id"), "run_id", "left_semi").select(*frame.columns)


def read_summaries(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """rel_path, summary_name, json and run_id."""
    names = read_archive(spark, root, SUMMARY_NAMES, run_id)
    texts = read_archive(spark, root, SUMMARY, run_id)
    return names.join(texts, ["run_id", "rel_path"]).select("rel_path", "summary_name", "json", "run_id")

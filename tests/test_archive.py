import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import preview
from marginalia.operators import files, naming
from marginalia.plans import archive, workspace
from marginalia.plans.preview import preview_run, write_preview
from marginalia.rules import CommentRules, JobConfig, PathRules
from marginalia.sources import listing
from marginalia.sources.tree import inventory, read_tree
from marginalia.streaming.runs import archive_stream

ROOT = "/depot/lab"
RULES = {"remove_blocks": ["/*...*/"], "keep_blocks": ["/**...*/"], "remove_lines": ["//"], "keep_lines": ["//:", "//*"]}
REST = "module lab\nstore Shelf {\n    size = 12\n    tag = \"jars\"\n}"
SOURCES = {
    "/kit/rack/Shelf.kt": "// say 'x', not \"y\"\n" + REST,
    "/kit/rack/Drawer.kt": "/* gone */\n//: stays\n// gone as well\n" + REST,
    "/kit/rack/Empty.kt": "/* nothing\n   else */",
    "/kit/wall/Shelf.java": "// say 'x', not \"y\"\n" + REST,
    "/kit/wall/Clean.java": REST,
    "/kit/notes.yaml": "// endings leave this out",
    "/barn/Cart.kt": "// paths leave this out",
}


@pytest.fixture
def job(tmp_path):
    return JobConfig.parse(ROOT, str(tmp_path / "archive"), ["/kit/*"], ["*.kt", "*.java"], **RULES)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(ROOT + p, t) for p, t in SOURCES.items()], "path string, text string")


def test_archive_run(spark, sources, job):
    run_id = archive.archive_run(spark, sources, job, "2031-02-03T04-05-06_0078")

    def table(name):
        return archive.read_archive(spark, job.archive_root, name, run_id)

    lines = {r.rel_path: r.line for r in table("operation_index").collect()}
    assert lines == {
        "kit/rack/Shelf.kt": "kit/rack/Shelf.kt:1 comment removed",
        "kit/rack/Drawer.kt": "kit/rack/Drawer.kt:2 comments removed",
        "kit/rack/Empty.kt": "kit/rack/Empty.kt:file removed",
        "kit/wall/Shelf.java": "kit/wall/Shelf.java:1 comment removed",
    }
    summaries = {r.summary_name: r for r in archive.read_summaries(spark, job.archive_root, run_id).collect()}
    assert {n: r.rel_path for n, r in summaries.items()} == {
        "Shelf.json": "kit/rack/Shelf.kt", "Shelf-1.json": "kit/wall/Shelf.java", "Drawer.json": "kit/rack/Drawer.kt", "Empty.json": "kit/rack/Empty.kt",
    }
    comment = SOURCES["/kit/rack/Shelf.kt"].removesuffix(REST)
    fields = [("relativePath", "kit/rack/Shelf.kt"), ("items", [
        dict([("filePath", ROOT + "/kit/rack/Shelf.kt"), ("pos", {"first": 0, "last": len(comment) - 1}), ("lines", {"first": 1, "last": 1}), ("commentText", comment)])
    ])]
    assert summaries["Shelf.json"].json == json.dumps(dict(fields), separators=(",", ":"))
    assert len(json.loads(summaries["Drawer.json"].json)["items"]) == 2
    kept = {(r.rel_dir, r.name): r.text for r in table("code_archive").collect()}
    assert kept == {(os.path.dirname(p), os.path.basename(p)): SOURCES["/" + p] for p in lines}
    assert {r.rel_path: r.text for r in table("snapshot").collect()} == {
        "kit/rack/Shelf.kt": REST,
        "kit/rack/Drawer.kt": "\n//: stays\n" + REST,
        "kit/wall/Shelf.java": REST,
    }
    assert sorted(r.path for r in table("changes").collect()) == sorted(f"{ROOT}/{p}" for p in lines)


def test_whole_tree(spark, sources, job):
    archive.archive_run(spark, sources, job, "whole", whole_tree=True)
    tree = {r.rel_path: r.text for r in archive.read_archive(spark, job.archive_root, "snapshot", "whole").collect()}
    assert tree == {
        "kit/rack/Shelf.kt": REST,
        "kit/rack/Drawer.kt": "\n//: stays\n" + REST,
        **{p[1:]: SOURCES[p] for p in ("/kit/wall/Clean.java", "/kit/notes.yaml", "/barn/Cart.kt")},
        "kit/wall/Shelf.java": REST,
    }
    odd = spark.createDataFrame([(ROOT + "/kit/a.kt", ""), (ROOT + "/kit/b.kt", None), (ROOT + "/kit/c.kt", "// x")], "path string, text string")
    assert sorted((r.rel_path, r.text) for r in files.cleaned_tree(odd, job).collect()) == [("kit/a.kt", ""), ("kit/b.kt", None)]


def test_staging_goes_and_comments_are_not_shuffled(spark, sources, job):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    archive.archive_run(spark, sources, job, "tidy")
    assert {d for d in set(os.listdir(base)) - before if d.startswith("marginalia-")} == set()
    run = archive.scanned_run(sources, job)
    assert "Exchange" not in archive.summary(run)._jdf.queryExecution().executedPlan().toString()


def test_runs_stand_side_by_side_and_can_be_repeated(spark, sources, job):
    java = sources.where("path like '%.java'")
    archive.archive_run(spark, java, job, "run-1")
    archive.archive_run(spark, java, job, "run-1")
    archive.archive_run(spark, sources.where("path like '%.kt'"), job, "run-2")
    counts = archive.read_archive(spark, job.archive_root, "operation_index").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in counts} == {"run-1": 1, "run-2": 3}
    one = archive.read_archive(spark, job.archive_root, "summary", "run-2")
    assert {r.run_id for r in one.collect()} == {"run-2"} and one.count() == 3
    assert all("/run_id=run-2/" in f for f in one.inputFiles())


def test_nothing_to_archive(spark, sources, job):
    archive.archive_run(spark, sources.where("path like '%Clean%'"), job, "empty")
    rows = archive.read_archive(spark, job.archive_root, "changes", "empty").collect()
    assert [(r.path, r.html) for r in rows] == [(None, preview.NO_COMMENTS)]
    assert archive.read_archive(spark, job.archive_root, "operation_index", "empty").count() == 0


def test_source_tree_is_never_written(spark, sources, job):
    with pytest.raises(ValueError, match="source tree"):
        archive.archive_run(spark, sources, job, "x", snapshot_path="file:" + ROOT + "/kit")


def test_run_names(spark):
    import re

    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d_0\d{3}", archive.new_run_id(spark))


def test_totals(spark, sources, job):
    assert tuple(files.run_totals(sources, job).first()) == (6, 5, 5)
    assert tuple(files.run_totals(sources.limit(0), job).first()) == (0, 0, 0)


def test_cleaning_from_a_table_of_occurrences(spark, sources, job):
    found = files.find_occurrences(sources, job.comments)
    listed = {r.path: r.cleaned for r in files.clean_listed(sources, found).collect()}
    direct = files.clean_files(files.commented_files(sources, job.comments))
    assert listed == {r.path: r.cleaned for r in direct.collect()}
    again = files.find_occurrences(direct.selectExpr("path", "cleaned as text"), job.comments)
    assert again.count() == 0


def test_previews(spark, sources, job, tmp_path):
    lines = [r.line for r in preview_run(sources, job).orderBy("path", "first").collect()]
    assert [line.split(">")[0] for line in lines] == [
        "kit/rack/Drawer.kt:1", "kit/rack/Drawer.kt:3", "kit/rack/Empty.kt:1", "kit/rack/Shelf.kt:1", "kit/wall/Shelf.java:1",
    ]
    assert lines[2] == "kit/rack/Empty.kt:1> /* nothing\\n   else */"
    target = str(tmp_path / "lines")
    write_preview(preview_run(sources, job), target)
    assert [r.value for r in spark.read.text(target).collect()] == lines
    assert preview_run(sources, job, "markup").count() == 4
    assert preview_run(sources, job, "multi_line").count() == 5
    for some in (sources.where("path like '%Clean%'"), sources.limit(0)):
        assert [(r.path, r.line) for r in preview_run(some, job, "markup").collect()] == [(None, preview.NO_COMMENTS)]
    with pytest.raises(ValueError):
        preview_run(sources, job, "other")


def test_summary_names_in_a_group_that_has_most_files(spark):
    rows = [f"/d{i:03d}/{'hot' if i % 3 else f's{i % 5}'}.kt" for i in range(400)]
    want, seen = {}, {}
    for path in sorted(rows):
        stem = path.split("/")[-1].removesuffix(".kt")
        want[path] = f"{stem}-{seen[stem]}.json" if stem in seen else f"{stem}.json"
        seen[stem] = seen.get(stem, 0) + 1
    frame = spark.createDataFrame([(r,) for r in rows], "path string").repartition(7)
    assert {r.path: r.summary_name for r in naming.summary_names(frame).collect()} == want
    ranged = frame.selectExpr("'hot' as g", "path").repartitionByRange(5, "g", "path")
    assert len({r[0] for r in ranged.selectExpr("spark_partition_id()").collect()}) == 5, "a hot group lies in many ranges"


def sequential_names(rows):
    taken, want = set(), {}
    for path in sorted(rows):
        stem, k = path.split("/")[-1].removesuffix(".kt"), 0
        while (name := f"{stem}-{k}.json" if k else f"{stem}.json") in taken:
            k += 1
        taken.add(name)
        want[path] = name
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_no_two_summaries_share_a_name(spark, seed):
    rng = random.Random(seed)
    ends = ["0", "01", "1", "2", "3", "4", "5", "11", "30", str(10**19)]
    stems = ["-".join([rng.choice("XY"), *rng.choices(ends, k=rng.choice([0, 0, 1, 1, 2, 3]))]) for _ in range(300)]
    rows = [f"/d{rng.randrange(1000):04d}/{i}/{s}.kt" for i, s in enumerate(stems)]
    frame = spark.createDataFrame([(r,) for r in [*rows, None, None]], "path string").repartition(5)
    got = naming.summary_names(frame).collect()
    assert len(got) == len(rows) + 2
    names = {r.path: r.summary_name for r in got}
    assert names.pop(None) is None
    assert names == sequential_names(rows)
    assert naming.summary_names(frame.limit(0)).count() == 0


def test_names_of_three_files_that_clash(spark, job):
    paths = [f"{ROOT}/kit/{d}" for d in ("a/X.kt", "b/X.kt", "c/X-1.kt")]
    archive.archive_run(spark, spark.createDataFrame([(p, "// c") for p in paths], "path string, text string"), job, "clash")
    names = {r.rel_path: r.summary_name for r in archive.read_summaries(spark, job.archive_root, "clash").collect()}
    assert names == {"kit/a/X.kt": "X.json", "kit/b/X.kt": "X-1.json", "kit/c/X-1.kt": "X-1-1.json"}


def test_links_are_not_followed(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a/b/One.kt", "a/Two.kt", "Three.kt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("// x")
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "Far.kt").write_text("// far")
    (root / "a/b/up").symlink_to(root)
    (root / "a/b/self").symlink_to(root / "a/b")
    (root / "far").symlink_to(outside)
    (root / "Same.kt").symlink_to(root / "Three.kt")
    (root / "broken").symlink_to(root / "nowhere")
    assert sorted(r.rel_path for r in inventory(spark, str(root)).collect()) == ["Three.kt", "a/Two.kt", "a/b/One.kt"]
    assert sorted(r.rel_path for r in inventory(spark, str(root), recursive=False).collect()) == ["Three.kt"]
    # the root itself may be a link
    (tmp_path / "link").symlink_to(root)
    assert inventory(spark, str(tmp_path / "link")).count() == 3


def test_a_flat_directory_is_listed_by_several_tasks(spark, tmp_path):
    for k in range(900):
        (tmp_path / f"f{k:04d}.kt").touch()
    found = listing.listed(spark, str(tmp_path), page=50)
    assert sorted(r.rel_path for r in found.collect()) == [f"f{k:04d}.kt" for k in range(900)]
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 4


def test_a_run_cut_short_is_not_seen(spark, sources, job, monkeypatch):
    archive.archive_run(spark, sources, job, "good")
    seen = archive.read_archive(spark, job.archive_root, "operation_index").count()

    def broken(run):
        raise RuntimeError("no room")

    with monkeypatch.context() as m:
        m.setattr(archive, "snapshot", broken)
        with pytest.raises(RuntimeError):
            archive.archive_run(spark, sources, job, "bad")
    assert os.path.isdir(f"{job.archive_root}/operation_index/run_id=bad")
    assert archive.read_archive(spark, job.archive_root, "operation_index").count() == seen
    assert {r.run_id for r in archive.read_summaries(spark, job.archive_root).collect()} == {"good"}
    assert {r.run_id for r in archive.finished_runs(spark, job.archive_root).collect()} == {"good"}
    with pytest.raises(LookupError):
        archive.read_archive(spark, job.archive_root, "operation_index", "bad")
    # a repeat of a finished run that is cut short takes the run away, a further one brings it back
    with monkeypatch.context() as m:
        m.setattr(archive, "snapshot", broken)
        with pytest.raises(RuntimeError):
            archive.archive_run(spark, sources, job, "good")
    assert archive.finished_runs(spark, job.archive_root).count() == 0
    archive.archive_run(spark, sources, job, "good")
    archive.archive_run(spark, sources, job, "bad")
    assert archive.read_archive(spark, job.archive_root, "operation_index").count() == 2 * seen


@pytest.mark.parametrize("whole_tree", [False, True])
def test_totals_come_from_the_run(spark, sources, job, whole_tree):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    result = archive.archive(spark, sources.mapInArrow(counted, sources.schema), job, "totals", whole_tree=whole_tree)
    totals = files.run_totals(sources, job).first()
    assert (result.files, result.matching_files, result.occurrences) == tuple(totals)
    assert read.value == sources.count(), "every source is read once"
    stored = archive.finished_runs(spark, job.archive_root).where("run_id = 'totals'").first()
    assert tuple(stored)[1:] == tuple(totals)
    nothing = archive.archive(spark, sources.limit(0), job, "nothing", whole_tree=whole_tree)
    assert (nothing.files, nothing.matching_files, nothing.occurrences) == (0, 0, 0)


def test_tree(spark, tmp_path):
    root = tmp_path / "my tree"
    contents = {
        "src/a b/Mäin+1.kt": b"// caf\xc3\xa9\r\nx",
        "src/100%.kt": b"\xff // bad\n",
        "src/Other.txt": b"// no",
        "src/__init__.kt": b"// under",
        "src/_form.kt": b"//form",
        "src/.hidden.kt": b"// dot",
        "src/.config/_x/Deep.kt": b"// deep",
        "src/Nothing.kt": b"",
        "gen/G.kt": b"// generated",
        "Top.kt": b"/* top */",
    }
    for name, data in contents.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (root / "empty folder").mkdir()
    listed = inventory(spark, str(root)).collect()
    assert {r.rel_path: r.length for r in listed} == {n: len(d) for n, d in contents.items()}
    assert {r.path for r in listed} == {str(root / n) for n in contents}
    for r in listed:
        assert abs(r.modified.timestamp() - (root / r.rel_path).stat().st_mtime) < 1e-3
    assert [r.rel_path for r in inventory(spark, str(root), recursive=False).collect()] == ["Top.kt"]
    assert [(r.path, r.length) for r in inventory(spark, str(root / "Top.kt")).collect()] == [(str(root / "Top.kt"), 9)]
    assert inventory(spark, str(root / "empty folder")).count() == 0

    config = JobConfig(f"file:{root}", "", CommentRules.parse(**RULES), PathRules.parse(["/src/*", "*Top*"], ["*gen*"]), (".kt",))
    chosen = read_tree(spark, str(root), config)
    texts = {r.rel_path: r.text for r in chosen.collect()}
    wanted = [n for n in contents if n.endswith(".kt") and not n.startswith("gen")]
    assert texts == {n: contents[n].decode("utf-8", "replace") for n in wanted}
    scanned = files.find_occurrences(files.select_files(chosen, config), config.comments).count()
    assert scanned == len(wanted) - 1
    with pytest.raises(Exception, match="missing"):
        read_tree(spark, str(tmp_path / "missing")).count()


def test_unwanted_files_are_not_opened(spark, tmp_path):
    (tmp_path / "good.kt").write_text("// x")
    unwanted = tmp_path / "other.txt"
    unwanted.write_text("y")
    config = JobConfig(str(tmp_path), "", CommentRules.parse(**RULES), PathRules(), (".kt",))
    chosen = read_tree(spark, str(tmp_path), config)
    everything = read_tree(spark, str(tmp_path))
    unwanted.unlink()
    assert [r.text for r in chosen.collect()] == ["// x"]
    with pytest.raises(Exception, match="other.txt"):
        everything.collect()


def test_stream_of_files(spark, tmp_path, sources, job):
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")

    def drain():
        arriving = spark.readStream.schema("path string, text string").parquet(inbox)
        archive_stream(arriving, job, "stream", checkpoint).awaitTermination()
        rows = archive.read_archive(spark, job.archive_root, "operation_index").collect()
        return sorted((r.run_id, r.rel_path) for r in rows)

    sources.where("path like '%.kt'").coalesce(1).write.parquet(inbox)
    first = [("stream-000000", f"kit/rack/{n}.kt") for n in ("Drawer", "Empty", "Shelf")]
    assert drain() == first
    sources.where("path like '%.java'").coalesce(1).write.mode("append").parquet(inbox)
    assert drain() == [*first, ("stream-000001", "kit/wall/Shelf.java")]
    assert len(drain()) == 4


def test_shared_folder_is_taken_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_dir(spark).startswith(base + "/")
    assert workspace.shared_dir(spark) != workspace.shared_dir(spark)

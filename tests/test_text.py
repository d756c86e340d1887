import datetime
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from marginalia.functions import preview, rewrite, scan, text, times
from marginalia.operators import files
from marginalia.rules import CommentRules

CODE = CommentRules.parse(["/*...*/"], ["/**...*/"], ["//"], ["//:", "//*"])


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_positions(spark):
    cases = [("", "X"), ("X", "X"), ("abcXdefXghiX", "X"), ("XabcXdefXghiX", "X"), ("XabcX", "Y"), ("aaaa", "aa"),
             ("xaaxaaa", "aaa"), ("é\n😀\n", "\n"), ("abab" * 60, "aba"), ("a.b.c", "."), ("x^^x", "^")]
    for content, needle in cases:
        expected = [i for i in range(len(content)) if content.startswith(needle, i)]
        assert values(spark, [(content,)], "t string", text.positions(F.col("t"), needle)) == [(expected,)]


def test_line_numbers_and_text_around_an_offset(spark):
    contents = ["", "\n", "one\ntwo", "é😀\n\n\nlast\n", "no end", "a\r\nb\r\n"]
    rows = [(c, p) for c in contents for p in range(len(c) + 1)]
    t, p = F.col("t"), F.col("p")
    got = values(spark, rows, "t string, p int", text.line_number(t, p), text.line_before(t, p), text.line_after(t, p))
    for (c, at), row in zip(rows, got, strict=True):
        after = "" if c[at : at + 1] == "\n" else c[at + 1 :].split("\n")[0]
        assert row == (c[:at].count("\n") + 1, c[:at].split("\n")[-1], after), (c, at)


def test_line_numbers_of_a_table_of_offsets(spark):
    rng = random.Random(11)
    contents = ["", "\n", "é😀\n\n\nlast\n", "x" * 1024, "x" * 1023 + "\n", "\n" * 3000, "a\r\nb" * 700]
    contents += ["".join(rng.choice("ab😀\n") for _ in range(rng.randrange(5000))) for _ in range(5)]
    sources = [(str(k), c) for k, c in enumerate(contents)] + [("none", None)]
    rows = [(str(k), p, k) for k, c in enumerate(contents) for p in [*range(0, len(c) + 1, 7), len(c), len(c)]]
    odd = [("0", -1, 0), ("0", 1, 0), ("2", 2000, 0), ("3", 1025, 0), ("3", 5000, 0), ("none", 0, 0), ("gone", 0, 0), (None, 0, 0), ("1", None, 0)]
    sources = spark.createDataFrame(sources, "path string, text string")
    offsets = spark.createDataFrame(rows + odd, "path string, pos int, block int")
    got = sorted(files.line_numbers_of(sources, offsets).collect(), key=str)
    want = [(p, at, k, contents[k][:at].count("\n") + 1) for p, at, k in rows] + [(*o, None) for o in odd]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert files.line_numbers_of(sources, offsets.limit(0)).columns == ["path", "pos", "block", "line"]
    assert files.line_numbers_of(sources.limit(0), offsets).where("line is not null").count() == 0
    with pytest.raises(ValueError):
        files.line_numbers_of(sources, offsets.withColumnRenamed("block", "Line"))


def test_line_numbers_are_linear_in_the_offsets(spark):
    offsets = spark.range(400_000).selectExpr("'a' as path", "id * 10 as pos")
    sources = spark.sql("select 'a' as path, repeat('some text\n', 400000) as text")
    start = time.time()
    row = files.line_numbers_of(sources, offsets).agg(F.sum("line"), F.max("line")).first()
    assert tuple(row) == (400_000 * 400_001 // 2, 400_000)
    assert time.time() - start < 60


ITEM = "struct<pos:struct<first:int,last:int>,lines:struct<first:int,last:int>,comment_text:string>"


def test_removal_of_one_comment(spark):
    """Every kind of text before and after every kind of comment."""
    befores, afters = ["", "k", "k ", "k\n", "k\n\t", "  ", "\u3000"], ["", "z", " z", "\nz", " \nz", "\r\nz", "\t", "\n\n z"]
    comments = ["/* c */", "/* c\n d */", "// c\n", "// c", "// c\n// d\n"]
    cases = [(b + c + a, len(b), c) for b in befores for c in comments for a in afters if c != "// c" or not a or a[0] == "\n"]
    found = [(s, s + len(c) - 1, 1, 1 + c.rstrip("\n").count("\n"), c) for _, s, c in cases]
    rows = [(t, ((f[0], f[1]), (f[2], f[3]), f[4])) for (t, _, _), f in zip(cases, found, strict=True)]
    got = values(spark, rows, f"t string, item {ITEM}", rewrite.remove_comment(F.col("t"), F.col("item")))
    assert [g[0] for g in got] == [brute.without(t, f) for (t, _, _), f in zip(cases, found, strict=True)]


def test_removal_of_listed_ranges(spark):
    """Random ranges, neighbouring ones and such that overlap, and blocks of the text that they cross."""
    rng = random.Random(4)
    rows, want = [], []
    for k in range(60):
        content = "".join(rng.choice(["ab", " ", "\n", "\t", "é", "x\n", "\u3000"]) for _ in range(rng.choice([5, 40, 3000])))
        at = sorted(rng.sample(range(len(content) + 1), min(len(content), rng.choice([2, 4, 8]))))
        pairs = [(a, b) for a, b in zip(at[::2], at[1::2], strict=False) if b > a]
        if k % 9 == 0 and len(pairs) > 1:
            pairs.append((pairs[0][0] + 1, pairs[1][1]))  # overlaps
            pairs = [p for p in pairs if p[1] > p[0]]
        items = [(a, b - 1, content[:a].count("\n") + 1, content[:b].rstrip("\n").count("\n") + 1, content[a:b]) for a, b in pairs]
        items = [(a, z, f, f + c.removesuffix("\n").count("\n"), c) for a, z, f, _, c in items]
        rng.shuffle(items)
        rows.append((content, [((a, z), (f, last), c) for a, z, f, last, c in items]))
        want.append(brute.cleaned(content, items))
    got = values(spark, rows, f"t string, items array<{ITEM}>", rewrite.remove_comments(F.col("t"), F.col("items")))
    assert [g[0] for g in got] == want


def test_removal_is_linear_in_the_text(spark):
    """One no-break space between two of many comments, and listed comments, cost what the others do."""

    def seconds(n):
        content = "x /* c */ y\n" * n + "/* a */\u00a0/* b */\n" + "z // d\n" * n
        frame = spark.createDataFrame([("p", content)], "path string, text string").cache()
        frame.count()
        found = files.find_occurrences(frame, CODE).cache()
        found.count()
        start = time.perf_counter()
        direct = files.clean_all(frame, CODE).first().cleaned
        listed = files.clean_listed(frame, found).first().cleaned
        took = time.perf_counter() - start
        assert direct == listed == "x y\n" * n + "\u00a0\n" * 0 + direct[len("x y\n") * n :]
        assert direct.endswith("z\n" * n) and "/*" not in direct
        frame.unpersist()
        found.unpersist()
        return took

    seconds(100)
    few, many = seconds(4_000), seconds(40_000)
    assert many < 25 * max(few, 0.5)


def test_line_contexts(spark):
    content = "a /*1*/ b /*2\n*/ c\n//3\n  /*4*/"
    frame = spark.createDataFrame([("p", content)], "path string, text string")
    found = files.commented_files(frame, CODE)
    items = text.line_contexts(F.array_join("segments", ""), scan.occurrences(F.col("segments")))
    rows = found.select(F.inline(items)).collect()
    assert [(r.before, r.after) for r in rows] == [("a ", " b /*2"), ("a /*1*/ b ", " c"), ("", "")]


def test_scan_quirks(spark):
    cases = {
        "/**/ x */ // y": [(10, 13)],
        "'\"' // not seen \" //seen": [(18, 23)],
        "/*/ still open": [],
        "//: keep /*x*/\n/*y*/": [(15, 19)],
        "a /* //: */ b": [(2, 10)],
        "//x\r\n\r\n  /*y*/": [(0, 13)],
        "/*a/*b*/c*/": [(0, 7)],
        "\"\"\" \" \"\"\" //x": [(10, 12)],
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = frame.select("t", scan.occurrences(scan.segments(F.col("t"), CODE)).alias("o")).collect()
    assert {r.t: [tuple(o.pos) for o in r.o] for r in rows} == cases


def test_null_and_empty_texts(spark):
    frame = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "path string, text string")
    assert files.find_occurrences(frame, CODE).count() == 0
    assert files.commented_files(frame, CODE).count() == 0
    nothing = CommentRules((), (("//", "\n"),))
    assert files.find_occurrences(frame, nothing).count() == 0
    assert files.clean_all(frame.where("path = 'c'"), nothing).first().cleaned == "x"
    kept = files.clean_all(frame.where("text is not null"), CODE).collect()
    assert sorted((r.path, r.cleaned) for r in kept) == [("b", ""), ("c", "x")]


def test_escapes_and_snippets(spark):
    assert values(spark, [("a\\\n\r\tb",), (None,)], "t string", text.escape_controls(F.col("t"))) == [("a\\\\\\n\\r\\tb",), ("null",)]
    content = "one two three four five"
    cases = [(9, "one two t-->h<--ree four f"), (0, "-->o<--ne two thr"), (22, "e four fiv-->e<--"), (23, "(pos 23 >) string length 23)"), (-1, "(pos -1 < 0)")]
    for pos, shown in cases:
        got = values(spark, [(content, pos)], "t string, p int", text.snippet(F.col("t"), F.col("p")))[0][0]
        assert got == shown
    assert values(spark, [("a\nb",)], "t string", text.snippet(F.col("t"), F.lit(1), 1, 1, "[", "]", False)) == [("a[\n]b",)]


def test_one_line_preview(spark):
    long = "//" + "x" * 38
    rows = [("//a\r\n//b\n",), (long,), (long + "x",)]
    got = values(spark, rows, "t string", preview.one_line(F.lit("src/A.kt"), F.lit(4), F.col("t")))
    assert [g[0] for g in got] == ["src/A.kt:4> //a\\n//b\\n", f"src/A.kt:4> {long}", f"src/A.kt:4> {long[:37]}..."]


def test_multi_line_preview(spark):
    def lines(n):
        return "\n".join(f"// {i}" for i in range(1, n + 1))

    def shown(content, first=1, last=11):
        column = preview.multi_line(F.lit("src/main/java/Main.kt"), F.lit(first), F.lit(last), F.col("t"))
        return values(spark, [(content,)], "t string", column)[0][0]

    head = "src/main/java/Main.kt:1-11>\n"
    assert shown(lines(1), 17, 17) == "src/main/java/Main.kt:17-17>\n    // 1"
    assert shown("", 17, 17) == "src/main/java/Main.kt:17-17>\n    "
    assert shown(lines(5) + "\n") == head + "\n".join(f"    // {i}" for i in range(1, 6))
    for n in (6, 11):
        assert shown(lines(n)) == head + f"    // 1\n    // 2\n    [...]\n    // {n - 1}\n    // {n}"
    assert shown("a\r\n\tb\n\n") == head + "    a\n        b\n    "


def test_sections_and_markup(spark):
    contents = ["a //b\nc", "//b", "x", "", "/*1*/a\t<&>\"\"/*2*/\r\n"]
    frame = spark.createDataFrame([(f"/{i}", c) for i, c in enumerate(contents)], "path string, text string")
    scanned = frame.select("path", scan.segments(F.col("text"), CODE).alias("segments"))
    got = {}
    for r in files.file_sections(scanned).orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.seq, r.text, r.highlight))
    assert got == {
        "/0": [(1, "a ", False), (2, "//b\n", True), (3, "c", False)],
        "/1": [(1, "", False), (2, "//b", True)],
        "/2": [(1, "x", False)],
        "/4": [(1, "", False), (2, "/*1*/", True), (3, 'a\t<&>""', False), (4, "/*2*/", True), (5, "\r\n", False)],
    }
    html = {r.path: r.html for r in files.file_markup(scanned).collect()}
    assert html["/4"] == (
        '\n<h2 class="file">/4</h2>\n<span class="plain"></span>\n<span class="occurrence">/*1*/</span>\n'
        '<span class="plain">a&nbsp;&nbsp;&nbsp;&nbsp;&lt;&amp;&gt;&quot;&quot;</span>\n<span class="occurrence">/*2*/</span>\n<span class="plain"><br/></span>\n'
    )


def test_markup_of_texts_with_border_marks(spark):
    frame = spark.createDataFrame([("/p", "a\ue000<//\ue001\ue002\n")], "path string, text string")
    html = files.file_markup(files.commented_files(frame, CODE)).first().html
    assert html == (
        '\n<h2 class="file">/p</h2>\n<span class="plain">a\ue000&lt;</span>\n'
        '<span class="occurrence">//\ue001\ue002<br/></span>\n'
    )


def test_times_do_not_depend_on_the_session_zone(spark):
    moments = [1661194800123, 0, -1, 951782400007, 253402300799999]
    expected = []
    for m in moments:
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=m)
        expected.append(f"{at:%Y-%m-%d}'T'{at:%H:%M:%S}.0{at.microsecond // 1000:03d}")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = values(spark, [(m,) for m in moments], "m long", times.iso_text(F.col("m")), times.iso_text(F.col("m"), False), times.run_id(F.col("m")))
            assert [g[0] for g in got] == expected
            assert [g[1] for g in got] == [e[:-5] for e in expected]
            assert got[0][2] == "2022-08-22T19-00-00_0123"
            offsets = spark.range(1).select(
                times.utc_offset_millis(F.timestamp_millis(F.lit(1661194800123)), "Europe/Berlin"),
                times.utc_offset_millis(F.timestamp_millis(F.lit(1640000000000)), "America/New_York"),
                times.local_now_millis() - times.now_millis() - times.utc_offset_millis(F.current_timestamp(), zone),
            ).first()
            assert tuple(offsets) == (7_200_000, -18_000_000, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

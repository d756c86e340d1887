import random
import re
from collections import Counter

from marginalia.llm import outliers


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_base_columns_of_awkward_rows(awkward):
    rows = [r for r in awkward.collect() if len(r.text or "") < 100_000]
    got = outliers.judged(awkward.where("text is null or length(text) < 100000")).collect()
    assert sorted(str((r.doc_id, *plain(r.text))) for r in rows) == sorted(
        str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got
    )
    assert not any(r.kept and r.base_failed for r in got)


def test_long_text(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randint(0, 9)}" for _ in range(30_000))
    got = outliers.judged(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == plain(text)


def test_rejects_junk_and_keeps_clean_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]

    def prose(n):
        return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))

    rows = [(k, prose(rng.randint(15, 600)), "en", "a" if k % 3 else "b") for k in range(900)]
    rows += [(1000 + k, prose(rng.randint(15, 3000)), "de", None) for k in range(100)]
    rows += [(2000 + k, " ".join(w + "###" for w in prose(100).split()), "en", "a") for k in range(60)]
    rows += [(3000 + k, prose(50), "xx", "tiny") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judged(docs).collect()}
    assert len(got) == len(rows)
    assert sum(not got[k].kept for k in got if k < 2000) == 0
    assert not any(got[k].kept for k in got if 2000 <= k < 3000)
    assert all(got[k].kept and got[k].distance is None for k in got if k >= 3000)


def test_empty_table_and_native_plan(nothing, awkward):
    assert outliers.judged(nothing).count() == 0
    plan = outliers.judged(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_third_of_a_group_as_copies_of_junk_and_almost_half_as_varied_junk(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def junk():
        return " ".join(w + "#" * len(w) for w in prose(rng.randint(80, 300)).split())

    same = junk()
    rows = [(k, prose(rng.randint(50, 600)), "en", "copies") for k in range(600)] + [(1000 + k, same, "en", "copies") for k in range(300)]
    rows += [(2000 + k, prose(rng.randint(50, 600)), "en", "varied") for k in range(220)] + [(3000 + k, junk(), "en", "varied") for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in outliers.judged(docs).collect()}
    assert all(kept[k] == (k // 1000 in (0, 2)) for k in kept)


def test_small_groups_are_judged_by_wider_ones(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def junk():
        return " ".join(w + "#" * len(w) for w in prose(rng.randint(80, 300)).split())

    rows = [(k, prose(rng.randint(50, 600)), "en", f"s{k % 20}") for k in range(300)]
    rows += [(1000 + k, junk(), "en", f"s{k}") for k in range(20)]  # by the language's estimate
    rows += [(2000, prose(200), "xx", "s0"), (1100, junk(), "xx", "s0"), (1101, junk(), None, None)]  # by the table's
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judged(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept == (k // 1000 != 1) for k in got)
    assert all((got[k].distance is None) == (got[k].doc_id in (2000, 1100, 1101)) for k in got)

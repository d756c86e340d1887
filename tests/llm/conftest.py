"""Tables with every awkward case: nulls in any column, empty and very long texts, repeated rows, clashing columns."""

import os
import random

import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Columns that the operators also use inside.
CLASHING = "h1 h2 k1 k2 gone id y k w line at fp row score predicted n shard slot thing cell list evidence d m0 lang2".split()


def awkward_rows(n=160):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "und", "ist", "écrit", "日本", "x1", "idiot", "scum", "Ordnung"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(0, "All rights reserved.")
        if i % 5 == 0:
            lines.append(f'token = "{rng.getrandbits(160):040x}"')
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", None]), f"src{i % 14}", None))
    long_text = "wort satz " * 30_000 + "z" * 50_000 + " " * 5_000 + "\n" * 100 + "ende"
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, "  \n\t \r\n", "en", "src2", 7), (n + 3, long_text, "de", None, 1)]
    rows += [rows[7], rows[7], (None, "no id here", "en", "src3", 1), (None, None, None, None, None)]
    rows += [(n + 4 + k, rows[11][1], "en", f"src{k % 3}", 3) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    rows = [(*r, *[None if k % 2 else f"v{k}" for k in range(len(CLASHING))]) for r in awkward_rows()]
    return spark.createDataFrame(rows, schema).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("needs the test tables")
    return SF_DIR

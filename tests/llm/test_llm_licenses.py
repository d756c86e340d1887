import re

import pytest
from marginalia.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "cc by", "CC-BY cc by-nc/cc,by", "general public licenses", "the GNU Lesser General Public License; All Rights Reserved all rights reserved.",
    "cc by cc by " * 500, "ccé by cc by", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */", "spdx-license-identifier: mit and",
    "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_columns(text):
    got = licenses.examine(text)
    assert got[:5] == plain(text)
    assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
    assert 0 <= got[6] <= 1


def test_tables(awkward, nothing):
    want = sorted(str((r.doc_id, *plain(r.text))) for r in awkward.collect())
    got = licenses.scan(awkward).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize(
    ("expression", "fine", "names"),
    [
        ("MIT", True, {"mit"}),
        ("MIT OR GPL-3.0-only", True, {"mit", "gpl-3.0-only"}),
        ("MIT AND GPL-3.0-only", False, {"mit", "gpl-3.0-only"}),
        ("GPL-2.0-only OR MIT AND GPL-3.0-only", False, {"gpl-2.0-only", "mit", "gpl-3.0-only"}),
        ("(GPL-2.0-only OR MIT) and apache-2.0", True, {"gpl-2.0-only", "mit", "apache-2.0"}),
        ("Apache-2.0 WITH LLVM-exception OR X", True, {"apache-2.0", "x"}),
    ],
)
def test_expressions(expression, fine, names):
    assert licenses.evaluate(licenses.postfix(expression)) == (fine, names)


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT BSD", "()", "MIT OR (AND)", "MIT ; BSD"])
def test_bad_expressions(expression):
    with pytest.raises(licenses.ExpressionError):
        licenses.postfix(expression)


def test_permissive():
    assert licenses.examine(TEXTS[8])[7] is True
    assert licenses.examine(TEXTS[9])[7] is None
    assert licenses.examine(TEXTS[10])[5] == "gpl-2.0-only,spdx"

"""The pipeline's stages on odd rows; test_others has the whole pipeline against brute force."""

import pytest
from helpers import SF

import corpus_pipeline as C


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, edge_docs, no_docs, k):
    name, stage = C.STAGES[k]
    out = stage(spark, edge_docs, SF)
    assert out.columns == list(C.COLUMNS) if k < 4 else "n_tokens" in out.columns
    rows, every = out.collect(), edge_docs.collect()
    assert 0 < len(rows) <= len(every) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in every}
    assert stage(spark, no_docs, SF).count() == 0


def test_one_of_each_class_stays(spark):
    t = " ".join(f"w{i}" for i in range(50))
    near = t.replace("w25", "other")
    rows = [(7, t), (3, near), (9, t), (9, t), (1, "quite another text of some words"), (None, "x y z"), (2, ""), (4, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in C.near_duplicate_stage(spark, docs, SF).collect()) == ["1", "2", "3", "4", "None"]


def test_ids_that_repeat_or_lack(spark):
    """Rows go by their texts: another text of an id stays, and copies without ids go."""
    t = " ".join(f"w{i}" for i in range(50))
    near = t.replace("w25", "other")
    far = " ".join(f"v{i}" for i in range(30))
    rows = [(5, t), (5, far), (3, t), (None, near), (None, near), (None, far + " end"), (None, "one two"), (None, "one  two"), (8, "")]
    docs = spark.createDataFrame([(i, x, None, "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"].split()[:1]) for r in C.near_duplicate_stage(spark, docs, SF).collect())
    assert got == [("3", ["w0"]), ("5", ["v0"]), ("8", []), ("None", ["one"])]


def test_later_copies_go_and_first_ones_stay(spark):
    p = "".join(chr(97 + i * i % 23) + str(i) for i in range(150))
    rows = [(1, "first " + p + " end"), (2, p), (3, "before " + p), (4, "own text")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in C.suffix_stage(spark, docs, SF).collect()}
    assert got[1] == (rows[0][1], len(rows[0][1]), "en") and got[4] == ("own text", 8, "en")
    assert got[3][0] in ("before", "before ")  # the blank before the passage is part of its first copy too
    assert 2 not in got

"""Plans that work long on each row use all cores and work each row out once."""

import os

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import concepts as C
from ranksmith.operators import audit as U
from ranksmith.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", ["job_fields", "resume_fields", "group_verdicts", "vendor_mapping", "job_audit", "component_scores", "audit_confidence"])
def test_parts_are_dealt_to_all_cores(spark, name):
    assert "hashpartitioning(p_partkey" in plan(catalogue.QUERIES[name](spark, SF)) and "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, SF))


@needs_tables
def test_candidates_are_not_gathered_by_job(spark):
    assert "SortMergeJoin" not in plan(catalogue.QUERIES["component_scores"](spark, SF))


@needs_tables
def test_audit_is_not_worked_out_to_filter_rows(spark):
    text = plan(catalogue.QUERIES["audit_confidence"](spark, SF))
    below = text[text.index("REPARTITION_BY_NUM") :]
    assert "Filter (" not in below


def test_ordered_distinct_keeps_nulls_and_first_spellings(spark):
    row = spark.sql("SELECT array('b', 'A', null, 'a', 'B', 'c', null) AS a, cast(null AS array<string>) AS n, cast(array() AS array<string>) AS e")
    got = row.select(*[A.ordered_distinct(F.col(c)).alias(c) for c in "ane"]).first()
    assert list(got) == [["b", "A", None, "c", None], None, []]


def test_a_concept_is_stemmed_once(spark):
    """The stems of a concept stand once in the expression, whatever the number of texts."""
    text = str(C.multiword_match(F.col("c"), F.col("t")))
    assert text.count("regexp_extract_all") == 1


def test_rows_without_audit_entries_leave(spark):
    rows = spark.sql("SELECT 1 AS k, named_struct('changes', array(named_struct('field', 'f', 'source', 's', 'canonical', cast(null AS string), 'rule', 'r', 'confidence', 1.0D))) AS audit UNION ALL SELECT 2, named_struct('changes', cast(array() AS array<struct<field:string,source:string,canonical:string,rule:string,confidence:double>>))")
    assert [tuple(r) for r in U.audit_rows(rows, ["k"]).collect()] == [(1, "f", "s", None, "r", 1.0)]


def test_lines_of_a_batch_are_not_held_at_once(spark, monkeypatch):
    """Columns are made of a few lines at a time; the result is that of the whole."""
    from ranksmith.operators import extraction as E
    from ranksmith.operators import headings as H

    monkeypatch.setattr(H, "LINES_AT_ONCE", 3)
    texts = ["Ann\nSkills\nGo\nRust", None, "", "a\n" * 7 + "Education\nMBA"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select(E.section_lines(F.col("t")).alias("l")).collect()
    assert [[tuple(x) for x in r["l"]] for r in got] == [H.Lexicon().lines(t or "") for t in texts]


@needs_tables
def test_whole_documents_cross_in_small_batches(spark):
    catalogue.QUERIES["section_segmentation"](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_a_line_of_a_batch_is_read_once():
    from ranksmith.operators import records as R

    seen = []
    text = "Data Engineer, Acme Ltd, 2019 - 2020\n- Tested all\nQA Tester, Other Ltd, 2020 - 2021\n- Tested all"
    assert R.experience(text, lambda raw: (seen.append(raw), R.read_line(raw))[1]) == R.remembering()(text) and len(seen) == 4


@needs_tables
def test_texts_of_resumes_are_not_shuffled(spark):
    assert "RoundRobinPartitioning" not in plan(catalogue.QUERIES["resume_records"](spark, SF))

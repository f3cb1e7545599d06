"""Dictionary tables against brute force; normal forms with their audit."""

import random
import re

from pyspark.sql import functions as F

from ranksmith.functions import dictionary as W
from ranksmith.functions import text as X
from ranksmith.operators import audit as U
from ranksmith.operators import normalise as N


def plain(text):
    x = " " + re.sub(r"[^\w#+.]+", " ", (text or "").lower()) + " "
    return re.sub(" +", " ", re.sub(r" \.+", " ", re.sub(r"\.+ ", " ", x))).strip()


def test_ten_thousand_terms_in_one_pass(spark):
    pick = random.Random(7)
    vocabulary = ["".join(pick.choice("abcdé+#.") for _ in range(pick.randint(1, 5))) for _ in range(6000)]
    terms = sorted({" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 3))) for _ in range(10_500)})[:10_000]
    texts = [" ".join(pick.choice(vocabulary) + pick.choice(["", ",", ".", "  ", "!"]) for _ in range(pick.randint(0, 200))) for _ in range(60)] + [None, "", "..."]
    forms = {}
    for t in terms:
        forms.setdefault(plain(t), t)
        forms[plain(t)] = min(forms[plain(t)], t)
    want = {k: sorted({name for form, name in forms.items() if form and f" {form} " in f" {plain(t)} "}) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    dictionary = spark.createDataFrame([(t,) for t in terms], "term string")
    assert {r.k: r.terms for r in W.with_terms(df, dictionary).collect()} == want
    joined = W.with_terms(df, dictionary, key="k", max_terms=10)
    assert {r.k: r.terms for r in joined.collect()} == want
    assert all(r.terms == [] for r in W.with_terms(df, dictionary.limit(0)).collect())


def test_nothing_to_normalise(spark):
    schema = "skills array<string>, titles array<string>, companies array<string>, languages array<string>, certifications array<string>, email string, phone string, years array<string>"
    row = U.normalised(spark.createDataFrame([(None,) * 8, ([], [None], [""], [" "], None, " ", "12", ["now"])], schema), U.resume_fields()).collect()
    assert [(len(r.audit.changes), r.audit.warnings, r.audit.fields_normalized, r.skills, r.years) for r in row] == [(0, [], [], [], []), (1, [], ["education.graduation_date"], [], [])]


def test_audit_rows(spark):
    df = spark.createDataFrame([(1, ["JS", "js", "Rust"])], "k int, skills array<string>")
    out = U.normalised(df, {"skills": U.coded(F.col("skills"), N.SKILLS, "skills")})
    assert [tuple(r) for r in U.audit_rows(out, ["k"]).collect()] == [(1, "skills", "JS", "JavaScript", "skills_alias", 1.0), (1, "skills", "js", "JavaScript", "skills_alias", 1.0)]
    assert out.first().audit.duplicates_removed == 1 and out.first().skills == ["JavaScript", "Rust"]


def test_places(spark):
    texts = ["Chennai", "Chennai, Tamil Nadu", "Lyon, Rhone, France", "Leeds, UK", "Canada", "", None, " , "]
    got = [tuple(r.l) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.location(F.col("t")).alias("l")).collect()]
    none = (None,) * 4
    assert got == [("Chennai", "Tamil Nadu", "India", "IN", "Chennai, Tamil Nadu, India"), ("Chennai", "Tamil Nadu", None, None, "Chennai, Tamil Nadu"), ("Lyon", "Rhone", "France", None, "Lyon, Rhone, France"), ("Leeds", None, "UK", "GB", "Leeds, UK"), (None, None, "Canada", "CA", "Canada"), (*none, None), (*none, None), (*none, ",")]


def test_compatibility_forms(spark):
    df = spark.createDataFrame([("\ufb01ne \uff12",), ("plain",), (None,)], "t string")
    assert [r.n for r in df.select(X.nfkc(F.col("t")).alias("n")).collect()] == ["fine 2", "plain", None]

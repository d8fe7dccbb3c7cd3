"""Scoring moves the texts that are cited, not the collection."""

from plumbline.operators import verify


def test_only_cited_texts_are_ranked(spark):
    cites = spark.createDataFrame([(1, "Case 3"), (2, "nobody"), (3, " ")], "citation_id long, case_name string")
    held = spark.createDataFrame([(i, f"Case {i % 5}", f"t{i}") for i in range(30)], "doc_id long, case_name string, text string")
    found = verify.opinions(cites, held)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "t13"), (1, "t3"), (1, "t8")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")


def test_cites_without_letters_in_common(spark):
    held = spark.createDataFrame([("Doe v. Roe, 12 U.S. 3",), ("Other",)], "name string")
    cites = spark.createDataFrame([("12 U.S. 3", "doe"), ("9 F. 9", "doe"), ("", "doe")], "cite string, case_name string")
    assert [tuple(r) for r in verify.reporter_matches(cites, held).collect()] == [("12 U.S. 3", "doe", "Doe v. Roe, 12 U.S. 3")]
    assert verify.reporter_matches(cites.where("cite = ''"), held).count() == 0

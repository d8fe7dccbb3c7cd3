"""Path templates below the fourth segment."""

from plumbline.llm import urls


def test_labels_below_the_fourth_segment_are_told_apart(spark):
    deep = "http://h/a/b/c/d/e/f"
    labels = [(f"{deep}/{k}/p{i}", action) for k, action in (("bad", "block"), ("good", "allow")) for i in range(30)]
    pages = [(0, f"{deep}/bad/new"), (1, f"{deep}/good/new"), (2, "http://other/a/b/c/d/e/f"), (3, "http://h/a"), (4, None)]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, action string"))
    found = {r["page_id"]: r for r in got.collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    assert (found[0]["verdict"], found[1]["verdict"]) == ("block", "allow")
    assert found[2]["template"].endswith("/{bare}") and found[2]["verdict"] == "allow"

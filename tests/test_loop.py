from plumbline.__main__ import main
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.engine import Engine
from plumbline.operators import agents, verify
from plumbline.plans.loop import Memory, ablations, cite_rows, review, split_by_cache


def corpus(spark):
    docs = spark.createDataFrame([(i, f"case {i} holds that rule {i % 3} applies to matter {i}") for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rule 1 applies to matter 4"), (2, "nothing like it whatsoever rule"), (3, "")], "query_id long, query string")
    return docs, asked


def test_review(spark):
    docs, asked = corpus(spark)
    got = {r["query_id"]: r for r in review(asked, docs).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r["rounds"] in (1, 2) and r["decision"] == "TERMINATE" for r in got.values())
    # the defense never cites what the other side holds
    assert all(r["eor"] == 0.0 for r in got.values())
    assert got[3]["n_citations"] == 0 and got[3]["confidence"] == 0.0


def test_ablations(spark):
    docs, asked = corpus(spark)
    rows = ablations(asked, docs, config=DEFAULTS).collect()
    assert len(rows) == 15 and {r["variant"] for r in rows} == {"full", "no_defense", "no_scoring", "no_memory", "single_round"} and {r["rounds"] for r in rows if r["variant"] == "single_round"} == {1}


def test_cache_split(spark):
    _, asked = corpus(spark)
    hits = spark.createDataFrame([(1, True, 9), (2, False, 8)], "query_id long, hit boolean, nearest_id long")
    known, rest = split_by_cache(asked, hits)
    assert [r["query_id"] for r in known.collect()] == [1] and sorted(r["query_id"] for r in rest.collect()) == [2, 3]


def test_command_line(spark, tmp_path, capsys):
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out
    main(["run", "tier_pivot", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    main(["build-engine", "/root/testdata/sf0.001", str(tmp_path / "engine")])
    spark.createDataFrame([(1, "one question")], "query_id long, query string").write.parquet(str(tmp_path / "asked"))
    main(["review", str(tmp_path / "engine"), str(tmp_path / "asked"), "--out", str(tmp_path / "answers"), "--no-memory"])
    assert [r["query_id"] for r in spark.read.parquet(str(tmp_path / "answers")).collect()] == [1]


def test_many_citations_of_far_questions(spark):
    """Keys of 1,500 citations a question, of neighbouring questions near 2^62, do not meet."""
    big, most = 2**62, 1500
    cites = [(f"case {i}", None, None, f"rule {i}", None, "") for i in range(most)]
    said = spark.createDataFrame([(q, (1, "", cites, None, None, None, None, None, None, None)) for q in (big, big + 1)], f"query_id long, said {agents.SAID}")
    cited = cite_rows(said, said.where("false"))
    assert cited.select("citation_id").distinct().count() == cited.count() == 2 * most
    held = spark.createDataFrame([("case 7",), ("case 1400",)], "name string")
    evidence = spark.createDataFrame([(1, "case 1400", "rule 1400")], "doc_id long, case_name string, text string")
    scored = verify.score_citations(cited.where("ordinal in (7, 400, 1400)"), held, evidence).select("query_id", "ordinal", "support", "tier")
    assert sorted((r["query_id"] - big, r["ordinal"], r["support"]) for r in scored.collect()) == [(q, o, 1.0 if o == 1400 else None) for q in (0, 1) for o in (7, 400, 1400)]
    scores = cited.where("ordinal in (7, 1400)").select("query_id", "ordinal", "case_name", F.lit(0.1).alias("ccs"), F.when(F.col("ordinal") == 7, "FABRICATED").otherwise("MISATTRIBUTED").alias("tier"))
    results = spark.createDataFrame([], "query_id long, query string, answer string, confidence double, n_verified long")
    risks = Memory.empty(spark).with_results(results, scores).risks
    assert sorted((r["name"], r["n"], r["last"]["seq"]["query_id"] - big) for r in risks.collect()) == [("case 1400", 2, 1), ("case 7", 2, 1)]


def test_jurisdiction_is_for_the_dense_side(spark, tmp_path):
    docs = spark.createDataFrame([(0, "ohio ohio ohio", "A", 1, ""), (1, "a rule of law", "B", 1, "")], "doc_id long, text string, case_name string, year int, reporter_cite string")
    engine = Engine.build(docs, f"file://{tmp_path}/e")
    asked = spark.createDataFrame([(1, "rule", "rule Ohio")], "query_id long, query string, dense_query string")
    plain = {r["doc_id"]: r["rrf_score"] for r in engine.search(asked.drop("dense_query")).collect()}
    both = {r["doc_id"]: r["rrf_score"] for r in engine.search(asked).collect()}
    assert both[1] >= plain[1] - 0.001 and both[0] < 2 / 61  # found by its vector alone

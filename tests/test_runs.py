"""Whole runs on small tables against plain Python."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import models
from plumbline.config import DEFAULTS
from plumbline.engine import Engine
from plumbline.functions import fuzzy, salvage
from plumbline.operators import agents, verify
from plumbline.plans import loop, runs
from plumbline.storage import shared_path


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, f"matter {i} of rule {i % 5} was held to apply in full, " + " ".join(f"w{(i * k) % 37}" for k in range(30)), f"Case {i}", 1900 + i, f"{i} U.S. {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, case_name string, year int, reporter_cite string")
    return Engine.build(docs, shared_path(spark, "engine"))


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, f"does rule {i % 5} apply to matter {i} and w{i}") for i in range(12)] + [(100 + i, f" Does rule {i % 5} apply to matter {i} and w{i}") for i in range(0, 12, 3)] + [(50, ""), (51, None)]
    return spark.createDataFrame(rows, "query_id long, query string")


def brute_rule(r, config, defense=True, scoring=True):
    avg, low = (1.0 if r["avg_ccs"] is None else r["avg_ccs"]), None
    low = avg if r["min_ccs"] is None else r["min_ccs"]
    if defense and r["concede"]:
        return 1
    if r["rounds"] >= config.max_rounds:
        return 2
    if scoring and (avg < config.avg_weak or low < config.min_weak) and r["n_gaps"] >= 1:
        return 3
    return 4 if defense and (r["challenge"] or 0) > config.challenge_strong and r["n_gaps"] >= 1 else 5


def test_a_round_step_by_step(spark, engine, asked):
    s = loop.Session(engine)
    rows = loop.asked_rows(asked).where("query_id < 60").withColumn("more", F.array().cast("array<string>"))
    found, scores = loop.run_round(rows, s, 0)
    got, cites = {r["query_id"]: r for r in found.collect()}, scores.collect()
    assert set(got) == {*range(12), 50, 51}
    names = [f"Case {i}" for i in range(40)] + [f"{i} U.S. {i}" for i in range(40)]
    for c in cites:
        key = c["case_name"].lower()
        if key in {n.lower() for n in names}:
            assert (c["existence"], c["match_type"]) == (1.0, "EXACT")
        else:
            best = max(max(fuzzy.ratio(key, n.lower()), fuzzy.token_set_ratio(key, n.lower())) for n in names) / 100
            assert c["existence"] == (round(best, 4) if best >= DEFAULTS.existence_accept else 0.0) or c["existence"] == DEFAULTS.subset_score
        expected = round(c["existence"] * c["support"], 4) if c["support"] is not None else 0.0
        assert c["ccs"] == pytest.approx(expected)
    for i, r in got.items():
        mine = [c for c in cites if c["query_id"] == i]
        assert r["n_citations"] == len(mine) and sorted(c["ordinal"] for c in mine) == list(range(len(mine)))
        if mine:
            assert r["avg_ccs"] == pytest.approx(sum(c["ccs"] for c in mine) / len(mine), abs=1e-4) and r["min_ccs"] == pytest.approx(min(c["ccs"] for c in mine), abs=1e-4)
        assert r["rule_no"] == brute_rule(r, DEFAULTS) and r["decision"] == ("CONTINUE" if r["rule_no"] in (3, 4) else "TERMINATE")
    assert {c["agent"] for c in cites} == {"prosecutor", "defense"} and len({c["tier"] for c in cites}) > 1


def test_judge_and_rounds(spark, engine, asked):
    results, scores = loop.review_with_scores(asked, engine)
    got, cites = {r["query_id"]: r for r in results.collect()}, scores.collect()
    assert len(got) == asked.count() and {r["rounds"] for r in got.values()} >= {1, 2}
    for i, r in got.items():
        assert 0.0 <= r["confidence"] <= 1.0
        if r["decision"] != "CACHED":
            assert r["n_verified"] <= sum(c["tier"] == "SUPPORTED" for c in cites if c["query_id"] == i) or r["n_rejected"] >= 0
            assert r["n_citations"] == sum(c["query_id"] == i for c in cites)


def test_memory_answers_what_was_asked_before(spark, engine, asked):
    full = {r["query_id"]: r for r in loop.review(asked, engine).collect()}
    bare = {r["query_id"]: r for r in loop.review(asked, loop.Session(engine, use_memory=False)).collect()}
    cached = {i for i, r in full.items() if r["decision"] == "CACHED"}
    # a repeated question is answered from memory if its first answer was worth keeping
    worth = {i for i in range(0, 12, 3) if full[i]["n_verified"] > 0 and full[i]["confidence"] > 0}
    assert cached == {100 + i for i in worth} and worth
    assert all(full[100 + i]["answer"] == full[i]["answer"] and full[100 + i]["confidence"] == full[i]["confidence"] for i in worth)
    assert "CACHED" not in {r["decision"] for r in bare.values()}
    assert all(bare[100 + i]["rounds"] >= 1 for i in worth)


def test_warnings_come_from_risky_names(spark, engine, asked):
    rows = loop.asked_rows(asked).where("query_id < 12")
    empty = loop.Memory.empty(spark)
    results, scores = loop.session(rows, loop.Session(engine))
    after = empty.with_results(results, scores)
    risky = {r["name"]: r["total"] / r["n"] for r in after.risks.collect()}
    bad = {c["case_name"] for c in scores.collect() if c["tier"] in ("FABRICATED", "MISATTRIBUTED", "UNVERIFIABLE")}
    assert {n.lower() for n in risky} == {n.lower() for n in bad}
    said = [r["warning"] for r in after.warnings(rows, engine, DEFAULTS).collect()]
    named = {n for w in said for n in w.removeprefix("Failed before: ").split("; ")}
    assert said and named <= set(risky) and all(risky[n] < DEFAULTS.risk_threshold for n in named)


def test_invoke_asks_again():
    calls = []

    def flaky(prompts):
        calls.append(list(prompts))
        if len(calls) == 1:
            raise OSError("busy")
        return ["{}" if p.startswith("only") or len(calls) > 2 else "no braces" for p in prompts]

    assert models.invoke(flaky, ["a", "b"], ["only a", "plain b"]) == ["{}", "{}"]
    assert calls == [["a", "b"], ["only a", "plain b"], ["plain b"]]
    assert models.invoke(lambda p: ["never"] * len(p), ["a"], ["a"]) == ["never"]
    with pytest.raises(RuntimeError):
        models.invoke(lambda p: 1 / 0, ["a"], ["a"])


def test_answers_are_read_with_care():
    stage, said, cites, challenge, concede, gaps, *_ = agents.read_answer(json.dumps({"counter_argument": "x", "counter_citations": [{"case_name": " A "}, {"case_name": ""}, "no", {"case_name": "B", "year": "1999", "self_confidence": 7}], "challenge_strength": "0.5", "concede": "yes", "gaps": "one"}))
    assert (stage, said, challenge, concede, gaps) == (1, "x", 0.5, False, ["one"])
    assert [(c[0], c[2], c[4]) for c in cites] == [("A", 0, 0.5), ("B", 0, 1.0)]
    assert agents.read_answer(None)[2] == [] and salvage.salvage("")[1] == 0


def test_opinions_are_looked_up_and_verified(spark, engine):
    cited = spark.createDataFrame([(1, "case 7"), (2, "Case 8x"), (3, "Nobody at all"), (4, "")], "citation_id long, case_name string")
    got = verify.opinions(cited, engine.texts, lambda q: q.crossJoin(spark.createDataFrame([(1, 8), (2, 9), (4, 8)], "rank long, doc_id long")))
    assert sorted((r["citation_id"], re.search(r"matter (\d+)", r["text"])[1]) for r in got.collect()) == [(1, "7"), (2, "8")] or {r["citation_id"] for r in got.collect()} == {1, 2}


def test_engine_parts(spark, engine, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        Engine.load(spark, f"file://{tmp_path}/none")
    chosen = engine.of_volumes(["7", "8"])
    assert sorted(r["doc_id"] for r in chosen.texts.collect()) == [7, 8] and chosen.vectors.count() == 2
    vectors = models.hashed_embedder()(["a b", ""])
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1)
    assert {r["key"] for r in engine.entities(spark.createDataFrame([(1, 1, 5)], "query_id long, rank long, doc_id long")).collect()} == {"case 5", "5 u.s. 5"}


def test_scores_of_the_stress_set(spark):
    found = runs.stress_scores(spark, "/root/testdata/sf0.001")
    rows = found.collect()
    kinds = {r["type"] for r in rows}
    assert kinds == {"correct", "misattributed", "casehold_distractor", "fabricated_with_cite", "fabricated_no_cite", "real_off_corpus"}
    assert all(r["existence"] == 1.0 and (r["tier"] == "SUPPORTED" or r["support"] is None or r["support"] < 0.7) for r in rows if r["type"] == "correct")
    assert all(r["existence"] == 0.0 for r in rows if r["type"] == "real_off_corpus")

"""Hand-worked cases of the rule tables and text functions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fuzzy, salvage
from plumbline.functions import text as fx
from plumbline.operators import catalog, chunking, debate, dense, fusion, lexical, memory, metrics, verify
from plumbline.sources import cases


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "bounds"), [(0, []), (1, [(0, 1)]), (450, [(0, 450)]), (451, [(0, 450), (375, 451)]), (825, [(0, 450), (375, 825)]), (826, [(0, 450), (375, 825), (750, 826)])])
def test_chunks(spark, n, bounds):
    docs = one(spark, doc_id=1, text=" ".join(f"w{i}" for i in range(n)))
    rows = chunking.chunk_documents(docs).orderBy("chunk_index").collect()
    assert [(r["word_start"], r["word_end"]) for r in rows] == bounds


def test_chunk_parameters(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(one(spark, doc_id=1, text="a"), 10, 10)


@pytest.mark.parametrize(("size", "starts"), [(0, []), (450, [0, 350]), (1800, [0, 350, 700, 1050, 1400, 1750]), (5000, [0, 350, 700, 1050, 1400, 1750])])
def test_windows(spark, size, starts):
    rows = chunking.character_windows(one(spark, doc_id=1, text="x" * size)).orderBy("window_no").collect()
    assert [r["start"] for r in rows] == starts
    assert not rows or sum(len(r["window"]) for r in rows[-1:]) == min(450, min(size, 1800) - starts[-1])


@pytest.mark.parametrize(
    ("exists", "support", "held", "tier", "score"),
    [(1.0, 0.70, True, "SUPPORTED", 0.7), (1.0, 0.69, True, "UNCERTAIN", 0.69), (1.0, 0.39, True, "MISATTRIBUTED", 0.39), (0.84, 0.9, True, "FABRICATED", 0.756), (0.84, 0.9, False, "UNVERIFIABLE", 0.756), (0.85, None, True, "UNVERIFIABLE", 0.0), (0.5, None, True, "FABRICATED", 0.0), (0.5, None, False, "UNVERIFIABLE", 0.0)],
)
def test_verdict(spark, exists, support, held, tier, score):
    e, s, known = F.lit(exists), F.lit(support).cast("double"), F.lit(support is not None)
    row = spark.range(1).select(verify.verdict(e, s, known, F.lit(held)).alias("t"), verify.confidence_score(e, s, known).alias("c")).first()
    assert (row["t"], row["c"]) == (tier, pytest.approx(score))


@pytest.mark.parametrize(
    ("round_no", "avg", "low", "gaps", "challenge", "concede", "rule"),
    [(0, 0.59, 0.59, 1, 0.0, False, 3), (0, 0.95, 0.39, 1, 0.0, False, 3), (0, 0.59, 0.59, 0, 0.0, False, 5), (1, 0.1, 0.1, 3, 1.0, False, 2), (0, 0.1, 0.1, 3, 1.0, True, 1), (0, 1.0, 1.0, 1, 0.5, False, 5), (0, 1.0, 1.0, 1, 0.51, False, 4)],
)
def test_decision(spark, round_no, avg, low, gaps, challenge, concede, rule):
    r = debate.decision_rule(F.lit(round_no), F.lit(avg), F.lit(low), F.lit(gaps), F.lit(challenge), F.lit(concede))
    row = spark.range(1).select(r.alias("r"), debate.decision(r).alias("d")).first()
    assert (row["r"], row["d"]) == (rule, "CONTINUE" if rule in (3, 4) else "TERMINATE")


@pytest.mark.parametrize(("n", "mean", "unsure", "raw", "expected"), [(1, 0.9, 0, 0.8, 0.87), (0, None, 1, 0.9, 0.35), (0, None, 1, 0.0, 0.20), (0, None, 0, 0.9, 0.2), (2, 0.8, 0, 0.0, 0.8)])
def test_judge_confidence(spark, n, mean, unsure, raw, expected):
    assert value(spark, debate.judge_confidence(F.lit(n), F.lit(mean).cast("double"), F.lit(unsure), F.lit(raw))) == pytest.approx(expected)


def test_idf_and_repeated_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    index = lexical.LexicalIndex.build(docs)
    assert {r["term"]: r["idf"] for r in index.terms.collect()}["a"] == pytest.approx(math.log(8 / 3))
    asked = spark.createDataFrame([(1, "a"), (2, "a a")], "query_id long, query string")
    top = {r["query_id"]: r["score"] for r in index.top(asked).collect()}
    assert top[2] == pytest.approx(2 * top[1])
    assert index.top(spark.createDataFrame([(1, "")], "query_id long, query string")).count() == 0


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    index = lexical.LexicalIndex.build(docs)
    index.save(str(tmp_path / "index"))
    again = lexical.LexicalIndex.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "b c")], "query_id long, query string")
    assert again.top(asked).collect() == index.top(asked).collect()


def test_fusion_ties(spark):
    first = spark.createDataFrame([(1, 1, "x")], "query_id long, rank long, doc_id string")
    second = spark.createDataFrame([(1, 1, "y")], "query_id long, rank long, doc_id string")
    assert [r["doc_id"] for r in fusion.fuse(first, second).orderBy("rank").collect()] == ["x", "y"]
    assert fusion.fuse(first, first).first()["rrf_score"] == pytest.approx(2 / 61, abs=1e-6)


def test_entity_map(spark):
    hits = spark.createDataFrame([(1, 1, "d1", ["N"], ["C"]), (1, 2, "d2", ["n"], ["c"])], "query_id long, rank long, doc_id string, names array<string>, cites array<string>")
    assert {r["key"]: r["doc_id"] for r in fusion.entity_map(hits).collect()} == {"n": "d1", "c": "d2"}


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [(r["vec_id"], r["distance"]) for r in dense.nearest(asked, rows, 3).orderBy("rank").collect()] == [(1, 0.0), (3, 0.0), (2, 1.0)]
    assert dense.cache_hits(asked, rows).first()["nearest_id"] == 3
    assert dense.nearest(asked.where("false"), rows).count() == 0


def test_names(spark):
    assert value(spark, fx.clean_name(F.lit('["Alpha v. Beta"]'))) == "Alpha v. Beta"
    assert [value(spark, fx.safe_year(F.lit(t).cast("string"))) for t in ("1973", "decided 1973", None, "n/a")] == [1973, 1973, 0, 0]
    assert value(spark, fx.year_of_date(F.lit("1973-01-22"))) == 1973
    assert value(spark, fx.clamp(F.lit("7"), 0.5)) == 1.0 and value(spark, fx.clamp(F.lit("x"), 0.5)) == 0.5


def test_volumes():
    assert catalog.parse_volumes("400-402") == ["400", "401", "402"]
    assert catalog.parse_volumes("410, 347") == ["410", "347"]
    assert catalog.parse_volumes("7") == ["7"]
    assert len(catalog.parse_volumes("landmark")) == 27 and len(catalog.parse_volumes("modern")) == 286
    assert catalog.parse_volumes("402-400") == []


def test_volume_of(spark):
    got = [value(spark, catalog.volume_of(F.lit(v), F.lit(c), F.lit(d), F.lit(t))) for v, c, d, t in [("{'volume_number': '12'}", "", "", ""), ("77", "", "", ""), ("", "410 U.S. 113", "", ""), ("", "", "vol_9", ""), ("", "", "", "See 5 U. S. 1"), ("", "", "", "")]]
    assert got == ["12", "77", "410", "9", "5", ""]


def brute_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    total = len(a) + len(b)
    return round(200 * rows[-1][-1] / total) if total else 0


def test_ratio_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy.ratio(a, b) == brute_ratio(a, b)
    assert fuzzy.ratio("", "") == 0 and fuzzy.ratio(None, "a") == 0
    assert fuzzy.token_set_ratio("roe v wade", "wade v roe") == 100


def test_best_matches(spark):
    import random

    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abc ") for _ in range(6)) for _ in range(60)})
    held = sorted({"".join(rng.choice("abc ") for _ in range(7)) for _ in range(80)})
    found = fuzzy.best_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in held], "name string"))
    expected = {n: min(((-brute_ratio(n, h), h) for h in held)) for n in names}
    assert {r["name"]: (-r["ratio"], r["best"]) for r in found.collect()} == expected


def test_salvage():
    assert salvage.salvage('{"a": [1,2,],}') == ({"a": [1, 2]}, 2)
    assert salvage.salvage('{"a": ["x"') == ({"a": ["x"]}, 3)
    assert salvage.salvage("") == ({}, 0)
    assert salvage.salvage("nothing here", "verdict") == ({"verdict": "nothing here"}, 5)
    assert salvage.salvage("[1, 2]")[1] == 5
    assert salvage.salvage('so {"a": 1} then') == ({"a": 1}, 2)
    found, stage = salvage.salvage('"argument": "yes", "confidence": 0.7, "concede": TRUE, "gaps": ["a", "b"]')
    assert stage == 4 and found == {"argument": "yes", "confidence": 0.7, "concede": True, "gaps": ["a", "b"]}


def test_salvage_of_broken_fields():
    broken = 'x "verdict": "he said \\"no\\"", "overall_confidence": .5 {"year": 1999, "case_name": "A v. B", "citation": "1 U.S. 2", "ccs": 0.25 "court": } {"case_name": "C", "year": "n/a"} {"case_name": "open'
    found, stage = salvage.salvage(broken)
    assert stage == 4 and found["verdict"] == 'he said "no"' and "overall_confidence" not in found
    assert found["citations"] == [{"year": 1999, "case_name": "A v. B", "reporter_cite": "1 U.S. 2", "self_confidence": 0.25}, {"case_name": "C", "year": "n/a"}]
    assert salvage.salvage('"gaps": ["a", "b" "concede": maybe, "reason": "r"')[0] == {"reason": "r"}


def test_counter_evidence_is_disjoint(spark):
    own = spark.createDataFrame([(1, "a", "Same start"), (1, "b", "other")], "query_id long, doc_id string, text string")
    hits = spark.createDataFrame([(1, 0, 1, "a", "x"), (1, 0, 2, "c", "same start "), (1, 0, 3, "d", "y"), (1, 1, 1, "d", "y"), (1, 1, 2, "e", "z")], "query_id long, query_ord int, rank long, doc_id string, text string")
    assert [r["doc_id"] for r in debate.counter_evidence(hits, own).orderBy("rank").collect()] == ["d", "e"]


def test_overlap(spark):
    cited = spark.createDataFrame([(1, "alpha"), (1, "beta")], "q long, name string")
    texts = spark.createDataFrame([(1, "alpha beta", "beta"), (2, "x", "")], "q long, own string, counter string")
    assert {r["q"]: r["eor"] for r in debate.evidence_overlap(cited, texts, "q").collect()} == {1: 0.5, 2: 0.0}


def test_reconcile(spark):
    verified = spark.createDataFrame([(1, "riley v. california", 0.9, 1), (1, "a v. b", 0.3, 2)], "query_id long, name string, score double, ord int")
    cited = spark.createDataFrame([(1, "Riley v. California"), (1, "Riley"), (1, "Unknown Matter")], "query_id long, case_name string")
    got = {r["case_name"]: (r["score"], r["via"]) for r in debate.reconcile(cited, verified).collect()}
    # an entry without words of three letters backs any name
    assert got == {"Riley v. California": (0.9, "exact"), "Riley": (0.9, "words"), "Unknown Matter": (0.3, "words")}


def test_running_mean(spark):
    rows = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4), (1, 3, 0.0)], "k long, seq long, x double")
    got = memory.running_means(rows, "k", "x", "seq").orderBy("seq").collect()
    assert [round(r["run_avg"], 6) for r in got] == [0.2, 0.3, 0.2] and got[-1]["n"] == 3


def test_high_risk_cuts_before_it_filters(spark):
    near = spark.createDataFrame([(1, i + 1, i) for i in range(6)], "query_id long, rank long, vec_id long")
    risks = spark.createDataFrame([(0, 0.9), (1, 0.2), (2, 0.5), (3, 0.1), (4, 0.8), (5, 0.1)], "vec_id long, avg_ccs double")
    assert sorted(r["vec_id"] for r in memory.high_risk(near, risks).collect()) == [1, 3]


def test_recurrence(spark):
    held = spark.createDataFrame([("known case",)], "name string")
    votes = spark.createDataFrame([(1, 1, "phantom one"), (1, 1, "quite invented"), (1, 2, "phantom one"), (2, 1, "known case")], "pair_id long, query_no int, name string")
    got = metrics.recurrence(votes, held).first()
    assert (got["rhr"], got["initial"], got["recurred"], got["pair_rhr"]) == (0.5, 2, 1, 1.0)


def test_empty_catalog_makes_every_name_fake(spark):
    names = spark.createDataFrame([("marbury v. madison",), ("x y",), ("",)], "name string")
    kinds = metrics.classify_names(names, spark.createDataFrame([], "name string"))
    assert {r["key"]: r["kind"] for r in kinds.collect()} == {"marbury v. madison": "OFF_CORPUS", "x y": "FABRICATED", "": "FABRICATED"}


def test_existence(spark):
    held = spark.createDataFrame([("Riley v. California",), ("410 U.S. 113 Roe v. Wade",)], "name string")
    cited = spark.createDataFrame([("riley v. california ", ""), ("Roe", "410 U.S. 113"), ("Riley", ""), ("Zzzz", "")], "case_name string, reporter_cite string")
    got = {r["case_name"]: (r["existence"], r["match_type"]) for r in verify.existence(cited, held).collect()}
    assert got["riley v. california "] == (1.0, "EXACT") and got["Roe"] == (1.0, "REPORTER")
    assert got["Riley"][1] == "FUZZY" and got["Zzzz"] == (0.0, "NOT_FOUND")


def test_score_citations(spark):
    held = spark.createDataFrame([("Roe v. Wade",)], "name string")
    evidence = spark.createDataFrame([("Roe v. Wade", "the right of privacy is broad")], "case_name string, text string")
    cited = spark.createDataFrame([(1, "Roe v. Wade", "", "the right of privacy"), (2, "Nobody v. Anyone", "410 U.S. 113", "x"), (3, "Roe v. Wade", "", "")], "citation_id long, case_name string, reporter_cite string, holding string")
    got = {r["citation_id"]: (r["tier"], r["ccs"]) for r in verify.score_citations(cited, held, evidence).collect()}
    assert got == {1: ("SUPPORTED", 1.0), 2: ("FABRICATED", 0.0), 3: ("UNVERIFIABLE", 0.0)}


def test_ingest(spark, tmp_path):
    body = {"head_matter": "Head", "opinions": [{"text": "x" * 120}, {"text": ""}]}
    rows = [
        {"id": "1", "name_abbreviation": "", "name": "Alpha v. Beta", "court": {"name": "S. Ct."}, "decision_date": "1973-01-22", "first_page": "113", "volume_number": "410", "reporter": "U.S.", "citations": [{"cite": "410 U.S. 113"}], "casebody": body},
        {"id": "2", "name": "Short", "casebody": {"text": "too short"}},
    ]
    (tmp_path / "vol_410.json").write_text(json.dumps(rows))
    docs = cases.parse_cases(cases.read_cases(spark, str(tmp_path)))
    [row] = docs.collect()
    assert (row["case_name"], row["year"], row["volume"], row["first_page"], row["authority_identity"]) == ("Alpha v. Beta", 1973, "410", 113, "410 U.S. 113")
    assert row["text"].startswith("Head\n\nxxx") and row["doc_id"].startswith("CAP::1::")
    assert {(r["kind"], r["name"]) for r in catalog.known_catalog(docs).collect()} == {("name", "Alpha v. Beta"), ("cite", "410 U.S. 113")}
    assert [r["volume"] for r in cases.landed_volumes(spark, str(tmp_path)).collect()] == ["410"]
    chunks = chunking.chunk_documents(docs)
    cases.write_chunks(chunks, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert cases.not_yet(docs, stored).count() == 0
    summary = cases.manifest(chunks, "CAP", "public domain").first()
    assert summary["n_chunks"] == 1 and len(summary["sha256"]) == 64
    assert cases.store_metadata(docs).first()["citations"] == '[{"cite":"410 U.S. 113"}]'


def test_loaders(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (5, ["a"])], "label int, endings array<string>")
    assert [r["answer"] for r in cases.multiple_choice(rows).collect()] == ["b", ""]
    assert cases.subtasks({"s": rows, "t": spark.createDataFrame([(1,)], "x int")}).columns == ["label", "endings", "subtask", "x"]
    full = spark.createDataFrame([(1, "better")], "id int, name string")
    listed = spark.createDataFrame([(1, "old"), (2, "only")], "id int, name string")
    assert {r["id"]: r["name"] for r in cases.complete_cases(listed, full).collect()} == {1: "better", 2: "only"}


def test_metadata_replaces_columns(spark):
    rows = spark.createDataFrame([("a", "web", ["x"], {"name": "other", "unknown": "y"}), ("b", None, None, None)], "name string, source string, tags array<string>, metadata map<string,string>")
    got = [tuple(r) for r in cases.store_metadata(rows, "CAP").orderBy("name").collect()]
    assert got == [("b", "CAP", ""), ("other", "CAP", '["x"]')] and cases.store_metadata(rows).columns == ["name", "source", "tags"]


def test_cases_without_a_body_go(spark):
    body = "struct<head_matter:string,opinions:array<struct<text:string>>,text:string>"
    listed = spark.createDataFrame([("1", "one", None), ("2", "two", ("", [], " ")), ("3", "three", None)], f"id string, name string, casebody {body}")
    full = spark.createDataFrame([("1", None, ("head", [("opinion",)], "")), ("3", "full", (None, None, ""))], f"id string, name string, casebody {body}")
    assert [tuple(r)[:2] for r in cases.complete_cases(listed, full).collect()] == [("1", "one")]


def test_failed_pairs_are_counted_apart(spark):
    votes = spark.createDataFrame([(1, 1, "Fake v. One"), (1, 2, "Fake v. One"), (2, 1, "Fake v. Two"), (2, 2, "Known")], "pair_id long, query_no int, name string")
    catalog = spark.createDataFrame([("Known",)], "name string")
    failed = spark.createDataFrame([(2,), (2,), (9,)], "pair_id long")
    r = metrics.recurrence(votes, catalog, failed=failed).first()
    assert (r["initial"], r["recurred"], r["errors"]) == (1, 1, 2) and metrics.recurrence(votes, catalog).first()["initial"] == 2


def test_volume_places(spark):
    def place(volume="", metadata="", cites=(), doc_id="", name="", text=""):
        found = catalog.volume_place(F.lit(volume), F.lit(metadata), F.array(*[F.lit(c) for c in cites]).cast("array<string>"), F.lit(doc_id), F.lit(name), F.lit(text))
        return tuple(value(spark, found))

    everything = {"volume": "{'volume_number': '1'}", "metadata": "2", "cites": ["none", "3 u. s. 9", "4 U.S. 1"], "doc_id": "x_vol_5", "name": "6 US 1", "text": "7 U.S. 2"}
    expected = [("volume_record", "1"), ("metadata", "2"), ("cites", "3"), ("doc_id", "5"), ("text", "6"), ("text", "7"), ("", "")]
    for key, told in zip([*everything, None], expected, strict=True):
        assert place(**everything) == told
        if key:
            del everything[key]
    assert place(volume="vol 12", doc_id="CAP_8") == ("doc_id", "8") and place(doc_id="CAP::8") == ("", "") and place(text="x" * 200 + " 5 U.S. 1") == ("", "")


def test_case_urls(spark):
    from plumbline.sources.cases import case_url

    def place(**record):
        return tuple(value(spark, case_url({k: F.lit(v) for k, v in record.items()}, F.lit("12"), "http://b")))

    folder = "http://b/us/12/cases/"
    assert place(case_url="c", url="u.json", first_page="3") == ("case_url", "c")
    assert place(casebody_url="", url="u.json") == ("url", "u.json") and place(url="u.JSON", body_url="b") == ("body_url", "b")
    assert place(case_file_name="http://f") == ("case_file_name", "http://f") and place(file_name="/a", filename="z") == ("file_name", folder + "a.json") and place(filename="a.json") == ("filename", folder + "a.json")
    assert place(first_page="7") == ("first_page", folder + "0007-01.json") and place(first_page=" 12345 ") == ("first_page", folder + "12345-01.json")
    for record in ({"first_page": "xii", "id": "9"}, {"url": "no"}):
        with pytest.raises(Exception, match="no file is named"):
            place(**record)


def test_support_falls_back(spark):
    from plumbline.operators.verify import tiered_support

    claims = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "nothing to read")], "citation_id long, holding string")
    texts = spark.createDataFrame([(1, "a x " * 200 + "a b"), (2, "a x " * 200 + "a b"), (3, "x"), (3, " "), (4, "")], "citation_id long, text string")
    calls = []

    def scorer(claim, window):
        calls.append(1)
        return F.when(F.contains(window, claim), 0.9).otherwise(0.1)

    best = {r["citation_id"]: (r["support"], r["window"][-3:]) for r in tiered_support(claims, texts, scorer).collect()}
    assert best[1] == best[2] == (0.9, "a b") and best[3][0] == 0.1 and set(best) == {1, 2, 3}
    letters = lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "axc"])
    vectors = {r["citation_id"]: round(r["support"], 4) for r in tiered_support(claims, texts, None, letters).collect()}
    assert vectors == {1: 0.7071, 2: 0.7071, 3: 0.0}
    assert {r["support"] for r in tiered_support(claims, texts, None).collect()} == {0.0}

"""Templates judged by shapes over all hosts, against a tree grown by hand."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import urls
from plumbline.llm.queries import QUERIES, URL_RULES
from tests.conftest import DATA
from tests.llm.test_operators import URLS, brute_url, lower


def general(segment):
    plain = lower(segment).replace("{", "(").replace("}", ")")
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", plain):
        return "{d}"
    if re.fullmatch(r"[0-9]+(\.[a-z0-9]+)?", plain):
        return "{n}"
    if re.fullmatch(r"[0-9a-f-]{16,}", plain) or (re.search("[0-9]", plain) and re.fullmatch(r"[a-z0-9_=-]{12,}", plain)):
        return "{x}"
    return plain


def brute_purities(labelled, asked):
    """purity by (host, shape) for rows (host, path, action or None)."""
    counts = defaultdict(lambda: [0, 0, 0])
    for host, path, action, page in labelled + [(h, p, a, 1) for h, p, a in asked]:
        c = counts[host, tuple(general(s) for s in path.split("/") if s)]
        c[0] += page
        c[1] += action == "block"
        c[2] += action == "allow"
    b, a = (sum(c[i] for c in counts.values()) for i in (1, 2))
    prior = min(0.5, b / (a + b)) if a + b else 0.5
    domain = {h: ".".join(re.sub(r":[0-9]*$", "", h).split(".")[-2:]) for h, _ in counts}
    levels = [lambda h, s: s[:1], lambda h, s: s[:2], lambda h, s: s, lambda h, s: (domain[h], s)]
    parent, shape = dict.fromkeys(counts, prior), {}
    for k, level in enumerate(levels):
        sums = defaultdict(lambda: [0, 0])
        for (h, s), c in counts.items():
            sums[level(h, s)][0] += c[1]
            sums[level(h, s)][1] += c[2]
        for h, s in counts:
            bb, aa = sums[level(h, s)]
            if k == 2:
                shape[h, s] = (bb, aa)
            parent[h, s] = (bb + 4 * parent[h, s]) / (bb + aa + 4)
    template, live = dict.fromkeys(counts, ""), {k: len(k[1]) > 0 for k in counts}
    level = 0
    while level < urls.DEPTH or any(live.values()):
        node = defaultdict(lambda: [0, 0])
        for k, c in counts.items():
            if live[k]:
                node[k[0], template[k]][0] += c[1]
                node[k[0], template[k]][1] += c[2]
        open_ = {k: level < urls.DEPTH or (live[k] and min(node[k[0], template[k]]) > 0) for k in counts}
        child = {k: "" if not live[k] else k[1][level] if open_[k] else "{rest}" for k in counts}
        sums = defaultdict(lambda: [0, 0, 0, 0])
        for k, c in counts.items():
            for i, x in enumerate((c[1], c[2], *shape[k])):
                sums[k[0], template[k], child[k]][i] += x
        known = {k: (x[0], x[1]) if x[0] + x[1] else (x[2], x[3]) for k, x in sums.items()}
        whole = defaultdict(lambda: [0, 0])
        for (h, t, _), (bb, aa) in known.items():
            whole[h, t][0] += bb
            whole[h, t][1] += aa
        kind = {}
        for (h, t, c), (bb, aa) in known.items():
            m, wb, wa = bb + aa, *whole[h, t]
            others = wb + wa - m
            if not m:
                kind[h, t, c] = "bare"
                continue
            kind[h, t, c] = "own"
            if others:
                share = (wb + 0.5) / (m + others + 1)
                z = abs(bb / m - (wb - bb) / others) / (share * (1 - share) * (1 / m + 1 / others)) ** 0.5
                if z < urls.LEAST_Z:
                    kind[h, t, c] = "alike"
        alike = defaultdict(int)
        for (h, t, _), x in kind.items():
            alike[h, t] += x == "alike"
        moved = {}
        for k in counts:
            x, n = kind[k[0], template[k], child[k]], alike[k[0], template[k]]
            name = child[k] if x == "own" or (x == "alike" and n < 2) else "{alike}" if x == "alike" or n >= urls.MERGED else "{bare}"
            moved[k] = f"{template[k]}/{name}" if live[k] else template[k]
            live[k] = live[k] and open_[k] and len(k[1]) > level + 1
        template = moved
        level += 1
    stats = defaultdict(lambda: [0, 0, 0, 0.0])
    for k, c in counts.items():
        w = max(c[0], c[1] + c[2])
        for i, x in enumerate((c[1], c[2], w, w * parent[k])):
            stats[k[0], template[k]][i] += x
    return {k: (x[0] + 4 * x[3] / x[2]) / (x[0] + x[1] + 4) for k in counts for x in [stats[k[0], template[k]]]}


def check(pages, got, rules, label=()):
    split = {i: brute_url(u) if rules else (*brute_url(u)[:2], None, None) for i, u in pages}
    labelled = [(*brute_url(u)[:2], action, 0) for u, action in label]
    purity = brute_purities(labelled, [(h, p, a) for h, p, _, a in split.values()])
    for i, _ in pages:
        host, path, _, action = split[i]
        expected = purity[host, tuple(general(s) for s in path.split("/") if s)]
        assert got[i]["purity"] == pytest.approx(expected, abs=1e-6), split[i]
        assert got[i]["verdict"] == (action or ("block" if expected >= urls.LEAST_PURITY else "allow"))


PLANTED = [(f"http://h{i % 7}.site{i % 3}.com/{kind}/{i}", "block" if kind in ("bets", "pills") else "allow") for kind in ("bets", "pills", "news", "docs", "team") for i in range(40)]
ASKED = ["http://new.org/bets/1", "http://new.org/news/1", "http://new.org/pills/9/more", "http://new.org/other/1", "http://new.org", "http://third.net/team/4", "http://h1.site1.com/bets/x", "http://h1.site1.com/unseen/1"]


def test_shapes_tell_hosts_without_labels(spark):
    pages = list(enumerate(ASKED + ASKED[:2] + ["http://big.io/" + "a/" * 3000 + "x", "http://big.io/bets/" + "y" * 100_000]))
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(PLANTED, "url string, action string")).collect()}
    assert [got[i]["verdict"] for i in (0, 1, 2, 5, 6, 8, 9)] == ["block", "allow", "block", "allow", "block", "block", "allow"]


def test_verdicts_against_a_tree_by_hand(spark):
    pages = list(enumerate(ASKED * 2 + URLS))
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES, spark.createDataFrame(PLANTED, "url string, action string")).collect()}
    # labels are judged by the rules' own reading of a URL, and the rules' verdicts are labels as well
    check(pages, got, URL_RULES, PLANTED)


def test_registered_query_against_a_tree_by_hand(spark):
    sf = f"{DATA}/sf0.01"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    df = QUERIES["op7_url_filter"](spark, sf)
    got = {r["page_id"]: r for r in df.collect()}
    assert len(got) == len(pages)
    check(pages, got, URL_RULES)
    open_ = [r for r in got.values() if r["rule"] is None]
    assert len({round(r["purity"], 3) for r in open_}) > 3 and {r["verdict"] for r in open_} == {"allow", "block"}
    assert df.groupBy().agg(F.count("page_id")).first()[0] == len(pages)

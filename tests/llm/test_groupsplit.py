import os
import random
from collections import defaultdict

import numpy as np

from passagery.llm.groupsplit import assign_units, components, divided_cases, links, new_splits, split_report
from passagery.runtime import ensure_checkpoint_dir

CASES = "case_no long, split_name string, category string, author string, entities array<string>, r long, g string"
LABELS = "case_no long, kind string, label_id string, document_id string, r string"
SPANS = "document_id string, span_id string, e string"


def world(spark, seed=1, n=120):
    rng = random.Random(seed)
    mess = lambda s: rng.choice([s, s.upper(), f" {s} ", s.replace("/", "\\")])
    cases = []
    for i in range(n):
        author = rng.choice([None, "", "-", "N/A", " Unknown ", mess(f"au{rng.randint(0, 80)}")])
        ents = rng.choice([None, [], ["", "n/a", None], [mess(f"e{rng.randint(0, 150)}"), mess(f"au{rng.randint(0, 80)}")]])
        cases.append((i, rng.choice(["train", "dev", "test", None]), rng.choice(["a", "b", None]), author, ents, 7, "x"))
    cases += cases[:9] + [(None, "dev", "a", "au1", None, 7, "x")]
    spans = [(f"dir/d{k}.md", f"dir/d{k}.md#s", "x") for k in range(60)]
    labels = []
    for _ in range(60):
        k = rng.randint(0, 59)
        doc = rng.choice([None, mess(f"dir/d{k}.md")])
        labels.append((rng.choice([None, rng.randint(0, n + 5)]), "span", f"dir/d{k}.md#s" if doc is None or rng.random() < 0.5 else None, doc, "x"))
    labels.append((1, "source", None, None, "x"))
    return cases, labels, spans


def brute(cases, labels, spans):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    tidy = lambda s: None if s is None or s.strip().lower() in ("", "-", "n/a", "unknown") else s.strip().lower()
    path = lambda s: None if s is None else tidy(s.replace("\\", "/"))
    known = {s: path(d) for d, s, _ in spans}
    for c in cases:
        if c[0] is None:
            continue
        find(c[0])
        for e in [("a", tidy(c[3])), *(("e", tidy(x)) for x in c[4] or [])]:
            if e[1]:
                parent[find(c[0])] = find(e)
    for case, _, label, doc, _ in labels:
        e = path(doc) or known.get(label)
        if case is not None and e:
            parent[find(case)] = find(("d", e))
    return {c[0]: find(c[0]) for c in cases if c[0] is not None}


def test_divided_cases_equal_union_find(spark):
    for seed in (1, 2):
        cases, labels, spans = world(spark, seed)
        group = brute(cases, labels, spans)
        splits = defaultdict(set)
        for c in cases:
            if c[0] is not None and c[1]:
                splits[group[c[0]]].add(c[1])
        frames = [spark.createDataFrame(x, s) for x, s in ((cases, CASES), (labels, LABELS), (spans, SPANS))]
        got = [r["case_no"] for r in divided_cases(*frames).collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k, g in group.items() if len(splits[g]) > 1}


def test_new_splits_keep_groups_and_shares(spark):
    cases, labels, spans = world(spark, 3, 300)
    labels = labels[:10]
    cases = [(*c[:3], None, [f"e{c[0] // 3}"] if c[0] is not None else None, 7, "x") for c in cases]
    frames = [spark.createDataFrame(x, s) for x, s in ((cases, CASES), (labels, LABELS), (spans, SPANS))]
    got = {r["case_no"]: (r["group_no"], r["new_split"]) for r in new_splits(*frames).collect()}
    assert set(got) == set(range(300))
    report = {r["new_split"]: r for r in split_report(new_splits(*frames), frames[0]).collect()}
    assert sum(r["cases"] for r in report.values()) == 300 and report["train"]["cases"] == sum(s == "train" for _, s in got.values())
    assert abs(report["test"]["share"] - 0.15) < 0.03 and all(0 <= r["label_deviation"] < 0.3 for r in report.values())
    by = defaultdict(set)
    for g, s in got.values():
        by[g].add(s)
    assert all(len(s) == 1 for s in by.values())
    share = lambda s: sum(x == s for _, x in got.values()) / 300
    assert abs(share("train") - 0.70) < 0.03 and abs(share("test") - 0.15) < 0.03


def test_long_chain_and_empty(spark):
    chain = [(i, "train" if i else "dev", "a", None, [f"k{i}", f"k{i + 1}"], 7, "x") for i in range(60)]
    frames = [spark.createDataFrame(x, s) for x, s in ((chain, CASES), ([], LABELS), ([], SPANS))]
    assert divided_cases(*frames).count() == 60
    empty = [f.limit(0) for f in frames]
    assert divided_cases(*empty).count() == 0 and new_splits(*empty).count() == 0
    assert [(r["cases"], r["share"]) for r in split_report(new_splits(*empty), empty[0]).collect()] == [(0, 0.0)] * 3


def test_rounds_leave_nothing_behind(spark):
    """A chain in no order takes many rounds; neither the estimated size of the plan nor the files grow with them."""
    at = list(range(20))
    random.Random(0).shuffle(at)
    link = spark.createDataFrame([(r, "e", f"k{i + d}") for i, r in enumerate(at) for d in (0, 1)], "r long, kind string, entity string")
    out = components(link)
    assert sorted(map(tuple, out.collect())) == [(r, 0) for r in range(20)]
    size = out._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert "E" not in size.partition("=")[2], size  # neither EiB nor a power of ten
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder) and not [x for x in os.listdir(folder) if x.startswith(("link-", "labels-"))]


def test_one_author_of_a_third_of_all_cases(spark):
    """The hot author's cases come out whole, with what hangs on them by a chain of entities."""
    rows = [(i, "train" if i % 7 else "test", "a", "Hot" if i % 3 == 0 else None, [f"k{i // 2}"], 7, "x") for i in range(600)]
    frames = [spark.createDataFrame(x, s) for x, s in ((rows, CASES), ([], LABELS), ([], SPANS))]
    group = brute(rows, [], [])
    splits = defaultdict(set)
    for c in rows:
        splits[group[c[0]]].add(c[1])
    assert {r["case_no"] for r in divided_cases(*frames).collect()} == {k for k, g in group.items() if len(splits[g]) > 1}
    least = {g: min(c for c, x in group.items() if x == g) for g in group.values()}
    got = [tuple(r) for r in components(links(*frames), hot_rows=100).collect()]  # the author is a hot entity
    assert len(got) == 600 and all(g == least[group[r]] for r, g in got)


def test_assignment_balances_strata():
    rng = np.random.default_rng(0)
    counts = rng.poisson(2.0, (400, 3)).astype(float)
    out = assign_units(counts, [0.7, 0.15, 0.15])
    for k, share in enumerate((0.7, 0.15, 0.15)):
        got = counts[out == k].sum(axis=0) / counts.sum(axis=0)
        assert np.abs(got - share).max() < 0.02

"""The call graph and concept documents against a plain model of their rules, on random units."""

import random
import re

from pyspark.sql import functions as F

from resemblage.operators import callgraph, evidence
from resemblage.schemas import UNITS


def model(units):
    names, graph = {u["name"] for u in units}, {}
    for u in units:
        graph.setdefault(u["name"], [])
    for u in units:
        for n in u["callees"] or [x for x in names if x != u["name"] and len(x.encode()) >= 4 and x in u["body"]]:
            if n in graph and u["name"] not in graph[n]:
                graph[n].append(u["name"])
    last = {u["name"]: u for u in units}
    docs = []
    for u in units:
        callers, i, o = graph[u["name"]], len(graph[u["name"]]), len(u["callees"])
        near = {k: [last[n] for n in ns if n in last] for k, ns in (("caller", callers), ("callee", u["callees"]))}
        docs.append(
            (u["ord"], callers, {(True, True): "passthrough", (True, False): "utility", (False, True): "orchestrator"}.get((i >= 2, o >= 2), "leaf"))
            + tuple(sorted({p for x in near[k] for p in x["patterns"]}) for k in ("caller", "callee"))
            + tuple(sorted({x["package"] for x in near[k] if x["package"]}) for k in ("caller", "callee"))
        )
    return graph, docs


def some_units(seed, n=40):
    r = random.Random(seed)
    names = ["abc", "alpha", "beta", "gamma", "alphabet", "éta", "*T.run", "x.y"]
    out = []
    for k in range(n):
        callees = sorted(set(r.sample([*names, "len", "pkg.F"], r.randint(0, 4)))) if r.random() < 0.6 else []
        out.append(
            dict(ord=k * 3, name=r.choice(names), file="f.go", start_line=1, body=" ".join(r.choices([*names, "other"], k=3)), signature="", package=r.choice(["", "p", "q"]), patterns=r.sample(["retry", "mapping", "caching"], r.randint(0, 2)), doc_comment="", exported=True, receiver_type="", callees=callees)
        )
    return out


def test_against_the_model(spark):
    for seed in range(3):
        rows = some_units(seed)
        units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS).repartition(3)
        graph, docs = model(rows)
        assert {r["name"]: r["callers"] for r in callgraph.call_graph(units).collect()} == graph
        got = callgraph.concept_docs(units).select("ord", "callers", "role", "caller_patterns", "callee_patterns", "caller_packages", "callee_packages").orderBy("ord").collect()
        assert [tuple(r) for r in got] == docs


def test_parts_of_the_text_scan_agree(spark):
    rows = some_units(9)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS)
    a, b, c = (sorted(map(tuple, callgraph.text_edges(units, broadcast=n).collect())) for n in (1 << 20, 9, 1))
    assert a == b == c and a


def test_no_units(spark):
    units = spark.createDataFrame([], UNITS)
    assert callgraph.call_graph(units).count() == 0 and callgraph.concept_docs(units).count() == 0


def test_last_document_of_a_key_and_missing_sides(spark):
    rows = some_units(5, 12)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS)
    docs = callgraph.concept_docs(units)
    index = {r["key"]: r["doc"]["ord"] for r in evidence.doc_index(docs).collect()}
    assert index == {f"{u['package']}.{u['name']}": u["ord"] for u in rows}
    pairs = evidence.with_units(spark.createDataFrame([(0, 3, 0.9)], "a_ord long, b_ord long, score double"), units)
    assert evidence.with_evidence(pairs, docs).first()["evidence"] is not None
    assert evidence.with_evidence(pairs, docs.filter(F.lit(False))).first()["evidence"] is None
    assert evidence.struct_min(evidence.with_evidence(pairs, docs.filter(F.lit(False))), 0.1).count() == 0


def test_names_are_looked_for_in_one_pass(spark):
    """However many names there are, a task holds a bitmap of bounded size and passes over the bodies once."""
    rows = some_units(9)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS)
    found = callgraph.text_edges(units, broadcast=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, callgraph.text_edges(units).collect()))
    names = spark.range(1000).selectExpr("concat('name', id) AS callee")
    assert len(callgraph._bitmap(names, 22)) == 1 << 19


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    """Documents of dealt edges are the same, and partitions are as many as rows need, whatever they compress to."""
    monkeypatch.setattr(callgraph, "EDGES", 2)
    rows = some_units(4)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS).repartition(3)
    graph, docs = model(rows)
    assert {r["name"]: r["callers"] for r in callgraph.call_graph(units).collect()} == graph
    found = callgraph.concept_docs(units)
    assert [tuple(r) for r in found.select("ord", "callers", "role", "caller_patterns", "callee_patterns", "caller_packages", "callee_packages").orderBy("ord").collect()] == docs
    assert found._jdf.queryExecution().executedPlan().toString().count(f", {-(-sum(len(u['callees']) for u in rows) // 2)}), REPARTITION_BY_NUM") >= 5


def test_edges_are_shuffled_to_their_callee_once(spark, monkeypatch):
    """Lists of callers and what callees tell of themselves come from one shuffle of edges, and lists of callers are in no later one."""
    monkeypatch.setattr(callgraph, "EDGES", 2)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in some_units(6)], UNITS)
    found = callgraph.concept_docs(units)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[callee#\d+, caller#\d+, caller_ord#\d+L, token#\d+, scanned#\d+\]", plan)


def test_numbers_for_what_is_known_and_the_thing_itself_agree(spark, monkeypatch):
    """Few packages and patterns go by number, many as they are; null and odd ones too."""
    rows = some_units(7)
    rows[0] |= {"package": None, "patterns": None}
    rows[-1] |= {"package": 'a"b\\é\n', "patterns": ["x", '"']}  # the last of its name
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS)
    few = callgraph.concept_docs(units).orderBy("ord").collect()
    monkeypatch.setattr(callgraph, "TOKENS", 0)
    assert callgraph.concept_docs(units).orderBy("ord").collect() == few
    assert any('a"b\\é\n' in r["caller_packages"] + r["callee_packages"] for r in few)


def test_documents_that_pairs_need(spark):
    """Evidence of few pairs is made of their own documents; those that share a key are all kept, as the last counts."""
    rows = some_units(5, 12)
    units = spark.createDataFrame([tuple(u[c] for c in UNITS.names) for u in rows], UNITS)
    docs = callgraph.concept_docs(units)
    pairs = evidence.with_units(spark.createDataFrame([(0, 3, 0.9)], "a_ord long, b_ord long, score double"), units)
    few, keys = evidence.docs_of(pairs, docs), {(u["package"], u["name"]) for u in rows[:2]}
    assert sorted(r["ord"] for r in few.collect()) == [u["ord"] for u in rows if (u["package"], u["name"]) in keys]
    assert evidence.with_evidence(pairs, few).collect() == evidence.with_evidence(pairs, docs).collect()

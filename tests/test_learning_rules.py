"""Rules mined from decisions, against plain loops."""

import hashlib
import json
import random
from collections import defaultdict

from granary.plans.learning import ignore_rules, learned_variants, next_versions, unreasoned

DECISIONS = "decision_id long, item_id string, code string, header_path array<string>, role string, learn_alias string, learn_path boolean, domain string, record_type string, observed_type string, unit string, ignore_scope string, ignore_reason string"


def decisions(seed=1, n=300):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return [(i, f"f{r.randrange(30)}", pick("a", "b", "c", None), pick([], ["t", "x"], ["y"], ["t", "z"]), pick(None, "", "last"), pick(None, " ", "姓 名", "电话", "x1"), pick(True, False, None), pick("d1", None), "person", pick("text", None), None,
             pick(None, "context", "once"), pick(None, "", "a total", "not needed")) for i in range(n)]


def variants(rows):
    files, first = defaultdict(set), {}
    for i, item, code, path, role, alias, by_path, *context, _, _ in rows:
        if code is None:
            continue
        role, alias = (role or "").strip() or None, (alias or "").strip() or None
        said = [("alias", alias, None, None)] if alias else []
        if by_path and path:
            said.append(("role_context" if role else "header_path", None, tuple(path), role))
        elif role:
            said.append(("role_context", None, None, role))
        for v in said:
            key = (code, *v, *context)
            files[key].add(item)
            first.setdefault(key, i)
    label = lambda v: (v[2] or " / ".join(v[3] or ())).replace(" ", "").replace("/", "")
    codes = defaultdict(set)
    for v in files:
        if label(v):
            codes[label(v), v[5], v[6]].add(v[0])
    return {v: (len(f), len(codes[label(v), v[5], v[6]]) - 1 if label(v) else 0, first[v]) for v, f in files.items()}


def row(x):
    return (x.code, x.kind, x.alias, tuple(x.header_path) if x.header_path is not None else None, x.role, x.domain, x.record_type, x.observed_type, x.unit)


def test_variants(spark):
    rows = decisions()
    df = spark.createDataFrame(rows, DECISIONS)
    found = learned_variants(df)
    want = variants(rows)
    assert {row(x): (x.support, x.conflicts, x.first_decision) for x in found.collect()} == want
    assert {row(x) for x in learned_variants(df, least=4).collect()} == {v for v, (n, _, _) in want.items() if n >= 4}
    known = learned_variants(df.filter("decision_id < 100"))
    assert {row(x) for x in learned_variants(df, known).collect()} == set(want) - set(variants(rows[:100]))


def test_versions_hold_what_is_sure(spark):
    rows = [(1, "f", "a", ["x"], None, "姓名", True, "d", "p", None, None, None, None), (2, "g", "a", ["x"], None, "姓名", True, "d", "p", None, None, None, None), (3, "g", "b", [], None, "姓 名", False, "d", "p", None, None, None, None), (4, "g", "z", ["q"], None, None, True, "d", "p", None, None, None, None)]
    fields = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "code string, version int, published_version int")
    made, held = next_versions(fields, learned_variants(spark.createDataFrame(rows, DECISIONS)))
    assert [tuple(x) for x in made.collect()] == [("a", 3, 1, 1)]
    assert [(x.code, x.version, x.ordinal, x.kind, x.header_path, x.support) for x in held.collect()] == [("a", 3, 1, "header_path", ["x"], 2)]


def test_ignore_rules(spark):
    rows = decisions(2)
    want = {}
    for i, item, _, path, _, _, _, domain, kind, seen, _, scope, reason in rows:
        if scope == "context" and (reason or "").strip():
            text = json.dumps({"header_path": path, "domain": domain, "record_type": kind, "observed_data_type": seen}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            rule = want.setdefault(hashlib.sha256(text.encode()).hexdigest(), [path, reason, i, set()])
            rule[3].add(item)
    df = spark.createDataFrame(rows, DECISIONS)
    rules = ignore_rules(df)
    assert {x.rule_key: (x.header_path, x.parent_path, x.reason, x.first_decision, x.support, x.version) for x in rules.collect()} == {k: (p, p[:-1], why, i, len(f), 1) for k, (p, why, i, f) in want.items()}
    assert ignore_rules(df, rules).isEmpty()
    assert {x.decision_id for x in unreasoned(df).collect()} == {r[0] for r in rows if r[11] == "context" and not (r[12] or "").strip()}

"""Problems 4 and 7, and star contraction."""

import inspect
import random
from datetime import datetime, timedelta

from weft.operators import hierarchy as H
from weft.operators import orphans as O
from weft.plans.stars import components

T = datetime(2024, 1, 1)
A, B, C, D = (f"{k}" * 8 + "-1111-1111-1111-111111111111" for k in "abcd")
ENT = "id string, entity_type string, is_active boolean, created_at timestamp, updated_at timestamp, version bigint, key string"
REL = "id string, source_id string, target_id string, created_at timestamp, refs bigint"


def test_orphans(spark):
    e = spark.createDataFrame([
        (A, "x", True, T, T, 1, None), (A, "x", True, T, T, 1, None), (B, "x", False, T, T + timedelta(5), 2, None), (B, "x", True, T, T, 1, None), (C, "x", True, T + timedelta(9), T, 1, None),
    ], ENT)
    day = lambda n: T + timedelta(n)
    r = spark.createDataFrame([
        ("r1", A, "urn:uuid:" + A.upper(), day(1), 1), ("r2", B, A, day(3), 1), ("r3", B, A, day(7), 1), ("r4", C, A, day(1), 1), ("r5", C, A, None, 1), ("r6", D, " ", day(1), 1), ("r7", "n/a", None, day(1), 1),
        ("r8", "00000000-0000-0000-0000-000000000000", A, None, 1), ("r3", B, A, day(7), 1),
    ], REL)
    got = {(x["field_name"], x["record_id"], x["reason"]) for x in O.orphans({"t": (r, ["source_id", "target_id"])}, e).collect()}
    assert got == {("source_id", "r3", "deleted"), ("source_id", "r4", "later"), ("source_id", "r6", "missing"), ("source_id", "r7", "no_key"), ("source_id", "r8", "no_key")}


def test_signed_deltas(spark):
    refs = spark.createDataFrame([("t", "f", f"r{k}", T, (A, B, D)[k % 3]) for k in range(9)] + [("t", "f", "r9", T, None)], "table_name string, field_name string, record_id string, at timestamp, key string")
    ents = spark.createDataFrame([(k, "x", True, T, T, 1, None) for k in (A, B)], ENT)
    state = O.key_state(O.reference_deltas(refs), O.record_deltas(ents))
    assert {tuple(r) for r in O.orphan_keys(state).collect()} == {(D, 3)}
    # references withdrawn, a record removed, another arriving late: the same counts as from scratch
    gone, late = refs.filter("record_id in ('r0', 'r2', 'r5')"), spark.createDataFrame([(D, "x", True, T, T, 1, None)], ENT)
    later = O.key_state(state, O.reference_deltas(gone, -1), O.record_deltas(ents.filter(f"id = '{B}'"), -1), O.record_deltas(late))
    fresh = O.key_state(O.reference_deltas(refs.exceptAll(gone)), O.record_deltas(ents.filter(f"id = '{A}'").union(late)))
    counts = ["key", "refs", "existence"]
    assert {tuple(r) for r in later.select(counts).collect()} - {(B, 3, 0)} == {tuple(r) for r in fresh.select(counts).collect()} - {(B, 3, 0)}
    assert {tuple(r) for r in O.orphan_keys(later).collect()} == {(B, 3)}
    assert O.orphan_keys(O.key_state(state, O.reference_deltas(refs, -1))).count() == 0


def test_link_kinds(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x"), ("y", "z"), (None, "q"), ("a", "b")]
    df = spark.createDataFrame(links, "parent string, child string")
    got = {tuple(r) for r in H.link_kinds(df).collect()}
    assert got == {("a", "b", "tree"), ("b", "c", "tree"), ("c", "d", "tree"), ("d", "b", "back"), ("e", "d", "cross"), ("x", "y", "cycle"), ("y", "x", "back"), ("y", "z", "cycle")}
    assert H.link_kinds(df.limit(0)).count() == 0


def test_orphans_hot_key_and_empty(spark):
    e = spark.createDataFrame([(A, "x", True, T + timedelta(1), T, 1, None)], ENT)
    r = spark.createDataFrame([(f"r{k}", A if k % 3 else D, None, T, 0) for k in range(3000)], REL)
    assert O.orphans({"t": (r, ["source_id", "target_id"])}, e).count() == 3000
    empty = spark.createDataFrame([], REL)
    assert O.orphans({"t": (empty, ["source_id"])}, spark.createDataFrame([], ENT)).count() == 0


def brute_groups(edges):
    group = {}
    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {x: find(x) for x in group}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    shapes = [
        [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 90)],
        [(k, 99 - k) for k in range(50)] + [(3, 3), (None, 4), (5, None)], [],
    ]
    for edges in shapes:
        df = spark.createDataFrame(edges, "a int, b int")
        got = {r["node"]: r["component"] for r in components(df.union(df), "a", "b").collect()}
        assert got == {k: v for k, v in brute_groups(edges).items()}


def brute_tree(links):
    up = {}
    for p, c in links:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in {x for p, c in links if p is not None and c is not None for x in (p, c)}:
        path, at = [n], n
        while at in up and len(path) <= len(up) + 1:
            at = up[at]
            path.append(at)
        out[n] = (at, len(path) - 1) if at not in up else ("cycle", -1)
    return out


def test_hierarchy(spark):
    links = [("a", "b"), ("b", "c"), ("b", "d"), ("x", "x"), ("x", "y"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("m", "n"), ("k", "n"), (None, "z"), ("a", "b")]
    links += [(f"t{k}", f"t{k + 1}") for k in range(40)]
    df = spark.createDataFrame([(p, c, "clash", 1) for p, c in links], "parent string, child string, component string, node int")
    expected = brute_tree(links)
    for bound in (1000, 3):
        got = {r["node_id"]: r for r in H.hierarchy(df, bound).collect()}
        assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == expected
    whole = {r["node_id"]: r for r in H.hierarchy(df).collect()}
    assert whole["d"]["path"] == "/a/b/d" and whole["a"]["descendants"] == 3
    assert whole["p"]["on_cycle"] and not whole["s"]["on_cycle"] and whole["x"]["on_cycle"]


def test_hierarchy_is_the_same_whatever_the_bound(spark):
    rng = random.Random(3)
    links = [(f"t{rng.randrange(k):02d}", f"t{k:02d}") for k in range(1, 60)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(21)]
    links += [("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("s", "u"), ("x", "x"), ("x", "y"), ("y", "z"), ("y", "w")]
    df = spark.createDataFrame(links, "parent string, child string")
    names = ["node_id", "root_id", "depth", "parent_id", "path", "descendants", "on_cycle", "back_edge"]
    whole, doubled = ({tuple(r[n] for n in names) for r in H.hierarchy(df, bound).collect()} for bound in (1000, 1))
    assert doubled == whole and len(whole) == 60 + 22 + 5 + 4
    assert {r[0] for r in doubled if r[6]} == {"p", "q", "r", "x"}
    assert {r[0] for r in doubled if r[7]} == {"p", "x"}
    slim = [{tuple(r) for r in H.hierarchy(df, bound, paths=False).collect()} for bound in (1000, 1)]
    assert slim[0] == slim[1] == {(*r[:4], *r[6:]) for r in whole}


def test_ancestors_and_empty(spark):
    links = spark.createDataFrame([(f"{k:02d}", f"{k + 1:02d}") for k in range(9)], "parent string, child string")
    got = {(r["ancestor"], r["descendant"], r["distance"]) for r in H.ancestors(links).collect()}
    assert got == {(f"{a:02d}", f"{b:02d}", b - a) for a in range(10) for b in range(a + 1, 10)}
    assert H.hierarchy(links.limit(0)).count() == 0


def test_ancestors_have_no_limit_of_distance(spark):
    assert "most" not in inspect.signature(H.ancestors).parameters
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(150)], "parent string, child string")
    got = H.ancestors(links)
    assert got.count() == 151 * 150 // 2 and got.agg({"distance": "max"}).first()[0] == 150

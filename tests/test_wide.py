"""Problem 2: sparse deltas and compaction."""

import itertools
from datetime import datetime

import pytest

from weft.operators import wide as W

E1, E2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
CATALOG = [
    ("Title", "title", "string", ["$", "$.name"]), ("Tags", "tags", "array<string>", ["$", "$.values"]),
    ("Timeline", "happened_at", "timestamp", ["$.created_at"]), ("BinaryContent", "size_bytes", "bigint", ["$.size"]),
]
SCHEMA = "id string, entity_id string, component_type string, data string, created_at timestamp, version bigint, title string"
T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "component_type string, column_name string, column_type string, json_paths array<string>")


def rows(spark, *items):
    """(entity, type, data, version) with a clashing extra column."""
    return spark.createDataFrame([(f"c{k}", e, t, d, T, v, "clash") for k, (e, t, d, v) in enumerate(items)], SCHEMA)


GOOD = [
    ("Title", '"a"'), ("Title", '{"name": "b"}'), ("Tags", '["x"]'), ("Tags", '{"values": ["x", "y"]}'), ("Timeline", '{"created_at": "2024-03-05T10:15:00Z"}'),
    ("Timeline", '{"created_at": "2024-03-05T10:15:00.123456+01:00"}'), ("BinaryContent", '{"size": 17}'), ("BinaryContent", '{"size": "17"}'), ("Title", ' "padded" '),
]
BAD = [
    ("Title", '""'), ("Title", '"  "'), ("Title", "3"), ("Title", "null"), ("Title", '"a" x'), ("Title", "'a'"), ("Title", '"a'), ("Title", None), ("Title", ""),
    ("Title", '"a",'), ("Tags", "[]"), ("Tags", "[1]"), ("Tags", '["a", null]'), ("Tags", '"a; b"'), ("Timeline", '{"created_at": "2024-03-05"}'),
    ("Timeline", '{"created_at": 5}'), ("Timeline", '{"created_at": "2024-03-05T10:15:00"}'), ("BinaryContent", '{"size": 1.5}'), ("BinaryContent", '{"size": "1x"}'), ("BinaryContent", '{"size": true}'),
]


def test_values_and_unreadable(spark, catalog):
    for items, expected in ((GOOD, 0), (BAD, len(BAD))):
        data = rows(spark, *[(E1[:-2] + f"{k:02d}", t, d, 1) for k, (t, d) in enumerate(items)])
        n = W.unreadable(data, catalog).count()
        assert n == expected, items


def test_latest_readable_version(spark, catalog):
    data = rows(spark, (E1, "title", '"old"', 1), ("{" + E1.upper() + "}", '"Title"', '"new"', 2), (E1, "Title", "broken", 3), (E2, "Tags", '["t"]', 1), (None, "Title", '"x"', 1), ("nonsense", "Title", '"x"', 1), (E1, "Other", '"x"', 1))
    got = {r["entity_id"]: r for r in W.wide_table(data, catalog).collect()}
    assert set(got) == {E1, E2}
    assert got[E1]["title"] == "new" and got[E1]["tags"] is None and got[E2]["tags"] == ["t"]


def test_compaction_is_associative(spark, catalog):
    kinds = W.catalog_rows(catalog)
    items = [(e, "Title", f'"{e[:1]}{v}"', v) for v in range(6) for e in (E1, E2)]
    whole = sorted(map(str, W.typed(W.sparse_deltas(rows(spark, *items), kinds), kinds).collect()))
    for cut in (1, 5, 9):
        parts = [W.sparse_deltas(rows(spark, *p), kinds) for p in (items[:cut], items[cut:])]
        for order in itertools.permutations(parts):
            assert sorted(map(str, W.typed(W.compact(list(order)), kinds).collect())) == whole


def test_empty_and_repeated(spark, catalog):
    assert W.wide_table(spark.createDataFrame([], SCHEMA), catalog).count() == 0
    one = rows(spark, (E1, "Title", '"a"', 1))
    assert W.wide_table(one.union(one), catalog).collect() == W.wide_table(one, catalog).collect()


def test_long_text(spark, catalog):
    long = "word " * 200_000
    assert len(W.wide_table(rows(spark, (E1, "Title", f'"{long}"', 1)), catalog).first()["title"]) == len(long)


def test_runs_by_batch(spark, catalog):
    """Several runs compacted give what one run gives, for values and for cells without one."""
    kinds = W.catalog_rows(catalog)
    months = "timestamp_seconds(1704067200 + version * 2000000)"
    data = rows(spark, *[(e, t, d, v) for v, (t, d) in enumerate(GOOD + BAD) for e in (E1, E2)]).selectExpr("id", "entity_id", "component_type", "data", f"if(version = 3, null, {months}) created_at", "version")
    data = data.union(rows(spark, (E1[:-1] + "9", "Tags", "[]", 1)).drop("title"))
    runs = W.sparse_deltas(data, kinds, batch=W.month_of(data.created_at))
    assert runs.select("run").distinct().count() > 5
    assert sorted(map(str, W.wide_table(data, catalog, W.month_of(data.created_at)).collect())) == sorted(map(str, W.wide_table(data, catalog).collect()))
    got = {tuple(r) for r in W.unreadable(data, catalog, W.month_of(data.created_at)).collect()}
    assert got == {tuple(r) for r in W.unreadable(data, catalog).collect()} == {(E1[:-1] + "9", "Tags")}

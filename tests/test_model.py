"""The engine's own operators on small fixtures."""

import io
import json
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import similarity as X
from weft.functions.keys import entity_key, uuid_key
from weft.operators import chat as C
from weft.operators import resolve as RS
from weft.operators import search as K
from weft.operators import store as ST
from weft.operators import traverse as G
from weft.operators import vectors as V
from weft.sources import files as FS
from weft.sources import parsers as P
from weft.sources import plugins as PL
from weft.sources import refs as XR

T = datetime(2024, 1, 1)
U = "0a1b2c3d-0000-1111-2222-333344445555"


def test_keys(spark):
    forms = [U, U.upper(), f" {U}\t", "{" + U + "}", "urn:uuid:" + U, U.replace("-", ""), "{" + U, U[:-1], "", None, "n/a", U.replace("-", "", 1)]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "x string").select(uuid_key(F.col("x"))).collect()]
    assert got == [U] * 6 + [None] * 6
    assert spark.range(1).select(entity_key(F.lit("0" * 32))).first()[0] is None


def graph(spark, edges, inactive=()):
    ids = sorted({x for e in edges for x in e[:2]})
    ent = spark.createDataFrame([(i, "Note" if i in "BD" else "Article", i not in inactive) for i in ids], "id string, entity_type string, is_active boolean")
    return ent, spark.createDataFrame([(a, b, e[0] if e else "References") for a, b, *e in edges], "source_id string, target_id string, relationship_type string")


@pytest.mark.parametrize("edges, way, depth, expected", [
    ([("A", "B"), ("B", "C"), ("C", "D")], "outgoing", 3, {"B": 1, "C": 2, "D": 3}),
    ([("A", "B"), ("A", "C"), ("B", "D"), ("B", "E"), ("C", "F")], "outgoing", 3, {"B": 1, "C": 1, "D": 2, "E": 2, "F": 2}),
    ([("A", "B"), ("B", "C"), ("C", "A")], "outgoing", 3, {"B": 1, "C": 2}),
    ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "outgoing", 3, {"B": 1, "C": 1, "D": 2}),
    ([("A", "B"), ("C", "A")], "both", 3, {"B": 1, "C": 1}),
    ([("A", "B"), ("B", "C")], "outgoing", 1, {"B": 1}),
    ([("B", "A"), ("C", "B")], "incoming", 3, {"B": 1, "C": 2}),
])
def test_traversal(spark, edges, way, depth, expected):
    ent, e = graph(spark, edges)
    rows = G.traverse(ent, e, "A", way, depth).collect()
    assert {r["entity_id"]: r["depth"] for r in rows} == expected
    assert all(r["path"][0] == "A" and r["path"][-1] == r["entity_id"] and len(r["edges"]) == r["depth"] for r in rows)


def test_traversal_filters(spark):
    ent, e = graph(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("A", "E", "HasMessage")], ("C",))
    assert {r[0] for r in G.traverse(ent, e, "A").collect()} == {"B", "E"}
    assert {r[0] for r in G.traverse(ent, e, "A", kind="References").collect()} == {"B"}
    assert G.traverse(ent, e, "A", limit=1).count() == 1
    with pytest.raises(G.StartNotFound):
        G.traverse(ent, e, "C")
    assert G.shortest_path(e, "A", "D") == ["A", "B", "C", "D"]


DOCS = [("1", "Article", "Rust Programming", "Rust is a systems language", ["rust", "programming"]), ("2", "Concept", "Rust Language", "Rust is a language", ["rust", "language"]),
        ("3", "Article", "Other", "École naïve text", ["x"]), ("4", "Article", "Foo", "bar baz qux", []), ("5", "Article", "Zed", "lorem ipsum dolor", [])]


def docs(spark):
    return spark.createDataFrame(DOCS, "entity_id string, entity_type string, title string, content string, tag_list array<string>").withColumn("tags", F.array_join("tag_list", ", "))


def test_search(spark):
    d = docs(spark)
    score = {r["entity_id"]: r["score"] for r in K.search(d, "Rust").collect()}
    assert score["2"] == pytest.approx(-0.4934926137) and score["1"] == pytest.approx(-0.4775734971)
    ids = lambda q, **k: {r["entity_id"] for r in K.search(d, q, **k).collect()}
    assert ids("Rust", kind="article") == {"1"} and ids("Rust", tag="programming") == {"1"} and ids("ecole") == {"3"}
    assert ids('"systems language"') == {"1"} and ids("lang* NOT systems") == {"2"} and ids("(foo OR zed) AND lorem") == {"5"}
    with pytest.raises(ValueError):
        K.search(d, '"open')
    assert "<b>naïve</b>" in K.search(d, "naive").first()["snippet"]
    terms = spark.range(1).select(K.chat_terms(F.lit("What is the Rust borrow-checker, über alles?"))).first()[0]
    assert terms == ["rust", "borrow", "checker", "über", "alles"]


def test_vectors(spark):
    c = spark.range(1).select(*[V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))) for a, b in (([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]))]).first()
    assert [round(x, 9) for x in c] == [1, 0, 0]
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)] + [(9, [1.0])], "id int, v array<double>")
    assert [r["id"] for r in V.top_k(rows, "v", [1.0, 0.0], 2).collect()] == [5, 4]
    a = spark.createDataFrame([(f"a{k}", k) for k in range(10)] + [("s", 10)], "id string, rank int")
    b = spark.createDataFrame([(f"b{k}", k) for k in range(10)] + [("s", 10)], "id string, rank int")
    fused = {r["id"]: r["score"] for r in V.fuse(a, b).collect()}
    assert len(fused) == 21 and fused["s"] > fused["a0"]
    assert np.linalg.norm(V.fold("some text")) == pytest.approx(1, abs=1e-5)


def test_similarity(spark):
    norm = [r[0] for r in spark.createDataFrame([("  Hello   World  ",), ("HELLO WORLD!",), ("Attention Is All You Need (2017)",), ("Héllo WÖRLD",)], "t string").select(X.normalize_title(F.col("t"))).collect()]
    assert norm == ["hello world", "hello world", "attention is all you need 2017", "héllo wÖrld"]
    assert X.jaro_winkler("attention is all you need", "attention is all you need 2017") > 0.95
    assert X.jaro_winkler("abcdefgh", "abzzyyxx") == pytest.approx(0.5) and X.jaro_winkler("", "a") == 0
    one = lambda c: spark.range(1).select(c).first()[0]
    w = lambda s: X.words(F.lit(s))
    assert one(X.jaccard(w("the quick brown fox"), w("the quick brown fox"))) == 1 and one(X.jaccard(w("the quick brown dog"), w("the quick brown cat"))) > 0.5
    assert one(X.band(F.lit(10.0), F.lit(12.0))) == 1
    meta = X.metadata_overlap((F.lit("en"), F.lit("en")), (F.lit(1000), F.lit(1100)), (F.lit("2024-01-01"), F.lit("2024-01-01")))
    assert one(meta) == 1 and one(X.composite(F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(0.5))) == pytest.approx(0.70)


def test_near_titles_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(RS, "TILE", 40)
    rng = random.Random(6)
    words = ["harbour", "ledger", "lantern", "narrow", "note", "valve", "zürich", "copper"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(2, 4))) for _ in range(130)})
    titles = [t for t in titles if len(t.encode()) >= 10]
    df = spark.createDataFrame([(k, t) for t in titles for k in ("x", "x", "y")] + [(None, titles[0]), ("x", "short")], "entity_type string, norm string")
    def least(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            new = [i + 1]
            for j, q in enumerate(b):
                new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
            row = new
        return max(X.jaro_winkler(a, b), 1 - row[-1] / max(len(a.encode()), len(b.encode())))
    scores = {(a, b): least(a, b) for a in titles for b in titles if a < b}
    for threshold in (0.6, 0.9):
        got = [tuple(r)[:3] for r in RS.near_titles(df, threshold, {"y": 0.8}).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(k, *p) for k, f in (("x", threshold), ("y", 0.8)) for p, s in scores.items() if s >= f}


def test_resolution(spark):
    t = spark.createDataFrame([("1", "Person", "Johnathan Smith"), ("2", "Person", "Jonathan Smith"), ("3", "Article", "Hello World"), ("4", "Article", "hello  world!"), ("5", "Article", "Hello World"), ("6", "Note", "Hello World"), ("7", "Article", "Doc A"), ("8", "Article", "Doc B")], "id string, entity_type string, title string")
    t = t.withColumn("norm", X.normalize_title(F.col("title"))).withColumns({c: F.lit(None).cast("string") for c in ("content", "lang", "day")}).withColumn("size", F.lit(None).cast("bigint"))
    got = {r["id"]: (r["canonical_id"], r["strategy"]) for r in RS.candidates(t, 0.80).collect()}
    assert got == {"2": ("1", "fuzzy"), "5": ("3", "exact"), "4": ("3", "normalized")}
    assert {r["id"]: r["confidence"] for r in RS.composite_scores(t, RS.candidates(t)).collect()}["5"] == pytest.approx(0.70)
    edges = spark.createDataFrame([("5", "9", "References"), ("3", "9", "References"), ("5", "3", "References")], "source_id string, target_id string, relationship_type string")
    assert RS.merged(edges, RS.classes(t, "title")).collect() == [("3", "9", "References")]
    comp = spark.createDataFrame([("c", "5", "Title", '"x"')], "id string, entity_id string, component_type string, data string")
    log = RS.audit(RS.classes(t, "title"), comp, "2024-01-01")
    back, _, rest = RS.undone(log, log.first()["id"])
    assert [tuple(r) for r in back.collect()] == [("c", "5", "Title", '"x"')] and rest.count() == 0
    zone = spark.range(1).select(RS.decision(F.lit(0.5), F.lit(0.8)), RS.decision(F.lit(1.0), F.lit(0.1)), RS.decision(F.lit(0.5), F.lit(0.5))).first()
    assert tuple(zone) == ("review", "merge", "create")


def test_store(spark, tmp_path):
    s = ST.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    s.upsert("t", rows(("a", 1), ("b", 1)), ["id"])
    s.upsert("t", rows(("b", 2), ("c", 2), ("c", 2)), ["id"])
    assert {tuple(r) for r in s.read("t").collect()} == {("a", 1), ("b", 2), ("c", 2)} and s.version("t") == 2
    s.delete("t", rows(("a", 0)).select("id"), ["id"])
    s.commit({"t": s.read("t").filter("v = 2"), "u": rows(("z", 1))})
    assert s.read("t").count() == 2 and s.read("u").count() == 1
    ent = spark.createDataFrame([("a", "Note", True, T, T, 1)], "id string, entity_type string, is_active boolean, created_at timestamp, updated_at timestamp, version bigint")
    log = spark.createDataFrame([], "id string, event_type string, entity_id string, timestamp timestamp, data string")
    off, log = ST.set_active(ent, log, ent, False, "2024-02-02")
    assert not off.first()["is_active"] and log.first()["event_type"] == "EntityArchived"
    ver = spark.createDataFrame([], "entity_id string, version bigint, snapshot string, created_at timestamp")
    ent2, ver = ST.incremented(ent, ver, ent, "2024-02-02")
    assert ent2.first()["version"] == 2 and json.loads(ver.first()["snapshot"])["version"] == 1
    mem = spark.createDataFrame([("c", "a")], "collection_id string, entity_id string")
    with pytest.raises(ValueError):
        ST.member_added(mem, mem)
    assert ST.member_removed(mem, mem).count() == 0


def test_store_runs(spark, tmp_path):
    s = ST.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    for k in range(20):
        s.upsert("t", rows(("a", k), (f"k{k}", k)), ["id"])
    held = s.manifest()[1]["t"]
    assert s.version("t") == 20 and len(held["runs"]) < 8 and max(r["level"] for r in held["runs"]) == 1
    assert {tuple(r) for r in s.read("t").collect()} == {("a", 19)} | {(f"k{k}", k) for k in range(20)}
    s.apply(("delete", "t", rows(("a", 0)), ["id"]), ("append", "log", rows(("gone", 1)), None))
    assert s.read("t").count() == 20 and s.read("log").count() == 1
    # a change that fails half way shows nothing of itself, and a torn manifest never was
    with pytest.raises(ValueError):
        s.apply(("append", "log", rows(("x", 1)), None), ("nonsense", "t", rows(), None))
    n, _ = s.manifest()
    (tmp_path / "manifest" / f"{n + 1:09d}.json").write_text('{"t"')
    assert s.read("log").count() == 1
    with pytest.raises(ST.Conflict):
        s._publish(n + 1, {})
    s.append("log", rows(("y", 2)))
    assert s.read("log").count() == 2 and s.vacuum() > 10 and s.read("t").count() == 20
    with pytest.raises(ST.NotFound):
        s.read("none")


def test_collections(spark):
    c = spark.createDataFrame([], "id string, name string, description string, created_at timestamp, updated_at timestamp")
    c = ST.collection_created(ST.collection_created(c, "1", "b", None, "2024-01-01"), "2", "a", "d", "2024-01-01")
    c = ST.collection_updated(c, "1", "2024-02-02", name="C")
    assert [r["name"] for r in ST.collections_listed(c).collect()] == ["C", "a"] and ST.collection_get(c, "1").first()["updated_at"].month == 2
    with pytest.raises(ST.NotFound):
        ST.collection_updated(c, "9", "2024-02-02", name="x")
    with pytest.raises(ValueError):
        ST.collection_created(c, "1", "x", None, "2024-01-01")
    m = spark.createDataFrame([("1", "e"), ("2", "e")], "collection_id string, entity_id string")
    left, members = ST.collection_deleted(c, m, c.filter("id = '1'"))
    assert left.count() == 1 and [r["collection_id"] for r in members.collect()] == ["2"]


def test_streams_of_deltas(spark, tmp_path):
    from weft.operators import orphans as O
    from weft.operators import wide as W
    from weft.streaming import watch

    store = ST.Store(spark, str(tmp_path))
    kinds = [{"component_type": "Title", "column_name": "title", "column_type": "string", "json_paths": ["$"]}]
    e1, e2 = (f"{k}" * 8 + "-1111-1111-1111-111111111111" for k in "12")
    run = watch.delta_batch(store, kinds)
    for k in range(10):
        run(spark.createDataFrame([(f"c{k}", e1, "Title", f'"v{k}"', T, 20 - k), (f"d{k}", e2, "Title", f'"w{k}"', T, k)], "id string, entity_id string, component_type string, data string, created_at timestamp, version bigint"), k)
    assert {tuple(r) for r in watch.wide_now(store, kinds).collect()} == {(e1, "v0"), (e2, "w9")}
    refs = spark.createDataFrame([("t", "f", f"r{k}", T, (e1, e2)[k % 2]) for k in range(4)], "table_name string, field_name string, record_id string, at timestamp, key string")
    ents = spark.createDataFrame([(e1, "x", True, T, T, 1)], "id string, entity_type string, is_active boolean, created_at timestamp, updated_at timestamp, version bigint")
    watch.orphan_batch(store)(refs, 0)
    watch.orphan_batch(store)(ents, 1)
    assert {tuple(r) for r in watch.orphans_now(store).collect()} == {(e2, 2)}
    watch.orphan_batch(store, -1)(refs.filter("record_id = 'r1'"), 2)
    assert {tuple(r) for r in watch.orphans_now(store).collect()} == {(e2, 1)} and O and W
    views, seen = watch.Views(), []
    views.register("table", lambda n: spark.range(n), seen.append)
    views.notify("event")
    assert views.names() == ["table"] and views.render("table", 3).count() == 3 and seen == ["event"]
    with pytest.raises(KeyError):
        views.render("other")


def parsed(path, raw):
    return list(P.PARSERS[path.rpartition(".")[2]](path, raw if isinstance(raw, bytes) else raw.encode()))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_parsers():
    kind, c, refs = parsed("a/doc.md", "---\ntitle: Test Document\ntags: [rust, testing]\nauthor: Me\ntype: paper\n---\n# Test Content\n[o](other.md) [w](https://e.com) [s](o.md#i) [[Wiki]] @you")[0]
    assert (kind, c["Title"], c["Tags"], c["Author"]) == ("paper", "Test Document", ["rust", "testing"], "Me")
    assert refs == [("file", "other.md"), ("url", "https://e.com"), ("section", "o.md#i"), ("wikilink", "Wiki"), ("mention", "you")]
    assert parsed("x/my-article.md", "plain")[0][1]["Title"] == "my-article" and parsed("m.md", "# My Document")[0][1]["Title"] == "My Document"
    _, h, r = parsed("p.html", '<html lang="fr"><head><title>T</title><meta name="author" content="A"><meta name="keywords" content="rust, web"><meta name="description" content="D"></head><body><p>Hi <a href="x.html#s">l</a></p><script>no</script></body></html>')[0]
    assert (h["Title"], h["Author"], h["Tags"], h["Description"], h["Language"]) == ("T", "A", ["rust", "web"], "D", "fr") and r == [("section", "x.html#s")] and "no" not in h["Content"]
    e = parsed("c.ics", "BEGIN:VEVENT\nSUMMARY:Test Event\nDTSTART;TZID=X:20240101T120000\nEND:VEVENT")[0]
    assert e[0] == "Event" and e[1]["Title"] == "Test Event" and e[1]["Timeline"]["created_at"] == "20240101T120000"
    assert parsed("v.vcf", "BEGIN:VCARD\nFN:Jo\nEMAIL:j@x\nEND:VCARD")[0][1]["Content"] == {"email": "j@x"}
    assert parsed("n.enex", "<en-export><note><title>N</title><content>&lt;b&gt;hi&lt;/b&gt;</content><tag>t</tag></note></en-export>")[0][1] == {"Title": "N", "Content": "hi", "Tags": ["t"], "Provenance": {"source": "n.enex", "format": "enex"}}
    assert [x[1]["Title"] for x in parsed("o.opml", '<opml><body><outline text="P"><outline text="C"/></outline></body></opml>')] == ["P", "C"]
    mails = parsed("m.mbox", "From a b\nSubject: One\nFrom: x@y\n\nHello\n\nFrom c d\nSubject: Two\n\nWorld\n")
    assert [m[1]["Title"] for m in mails] == ["One", "Two"] and "From a b" not in mails[0][1]["Content"]
    assert parsed("j.json", '{"a": [1, 2]}')[0][1]["Content"] == '{"a":[1,2]}' and parsed("y.yaml", "a: 1")[0][1]["Content"] == '{"a": 1}'
    assert "<b>text </b>" in parsed("x.xml", "<a><b>text</b></a>")[0][1]["Content"]
    w = "xmlns:w='u'"
    assert parsed("d.docx", zipped(**{"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:d>"}))[0][1]["Content"] == "one\ntwo"
    assert parsed("s.xlsx", zipped(**{"xl/sharedStrings.xml": "<s><si><t>x</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>2</v></c></row></w>"}))[0][1]["Content"] == "x\t2"
    assert parsed("p.pptx", zipped(**{"ppt/slides/slide2.xml": "<s><t>b</t></s>", "ppt/slides/slide1.xml": "<s><t>a</t></s>"}))[0][1]["Content"] == "--- Slide 1 ---\na\n--- Slide 2 ---\nb"
    assert parsed("t.odt", zipped(**{"content.xml": "<d><p>x<span>y</span></p></d>"}))[0][1]["Content"] == "xy"
    with pytest.raises(P.Unsupported):
        parsed("old.doc", "x")
    assert P.detect("noext", b"%PDF-1.7", P.PARSERS) == "pdf"


def test_files_import_and_stream(spark, tmp_path):
    from weft.streaming import watch

    root = tmp_path / "in"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.md").write_text("# A\n[[B]]")
    (root / "bad.json").write_text("{")
    (root / "node_modules" / "x.md").write_text("no")
    found = FS.files(spark, str(root))
    assert found.count() == 2 and {r["format"]: r["files"] for r in FS.preview(found).collect()} == {"md": 1, "json": 1}
    rows = P.imported(found).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and [r for r in rows if not r["error"]][0]["refs"][0]["target"] == "B"
    store = ST.Store(spark, str(tmp_path / "store"))
    for expected in (1, 2, 2):
        watch.import_stream(spark, str(root), store, str(tmp_path / "cp")).awaitTermination()
        assert store.read("imports").count() == expected
        (root / f"b{'' if expected == 1 else 2}.md").write_text("# B")  # the third has a content seen before
    d = docs(spark)
    run = watch.index_batch(store)
    run(d.limit(3), 0)
    run(d, 1)
    assert store.read("lengths").count() == 5
    watch.embedding_batch(store)(d, 0)
    assert store.read("embeddings").count() == 5


def test_structured(spark, tmp_path):
    import sqlite3

    (tmp_path / "t.csv").write_text("Name,Description,Tags,Internal\nAlpha,First item,rust;testing,x\nBeta,Second item,,y\n")
    p = FS.csv_preview(spark, str(tmp_path / "t.csv"))
    assert p["row_count"] == 2 and len(p["columns"]) == 4
    c = FS.mapped(FS.csv(spark, str(tmp_path / "t.csv")), {"Name": ("Title",), "Description": ("Content",), "Tags": ("Tags", ";"), "Internal": ("Content",)}, skip=("Internal",))
    assert {(r["component_type"], r["data"]) for r in c.collect()} >= {("Title", '"Alpha"'), ("Tags", '["rust","testing"]'), ("Content", '"Second item"')}
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("create table test(id integer primary key, name text)")
        con.executemany("insert into test values (?, ?)", [(1, "hello"), (2, "world")])
    assert FS.sqlite_tables(db)[0]["rows"] == 2 and {r["name"] for r in FS.sqlite_table(spark, db, "test").collect()} == {"hello", "world"}
    log = FS.recorded(spark.createDataFrame([], FS.IMPORT_LOG), "i1", "p", ["a"], "2024-01-01", "md")
    rest, ents = FS.undo_import(log, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rest.count() == 0 and [r["id"] for r in ents.collect()] == ["b"]


def test_refs_and_chat(spark):
    d = spark.createDataFrame([(1, "see [[Foo Bar]] and @foo, [x](y.md)")], "doc_id int, text string")
    assert {(r["kind"], r["target"]) for r in XR.markdown_refs(d).collect()} == {("wikilink", "Foo Bar"), ("mention", "foo"), ("file", "y.md")}
    flat = spark.createDataFrame([("1", "The Foo Bar Book"), ("2", "foo")], "id string, title string")
    assert {(r["target"], r["entity_id"]) for r in XR.contained_refs(XR.markdown_refs(d), flat).collect()} == {("Foo Bar", "1"), ("foo", "1")}
    rows = [{"id": "a", "title": "A", "content": "c" * 300}, {"id": "b", "title": "B", "content": ""}]
    assert [c["number"] for c in C.citations("as in [1]", rows)] == [1] and len(C.citations("[1]", rows)[0]["snippet"]) == 200
    assert "[1]" in "".join(C.mock_answer("", rows)) and "".join(C.mock_answer("", []))
    whole = C.prompt([{"block": "  Type: Note\n"}, {"block": "  Type: Tool\n"}], "why?", "recent")
    assert "[1]\n  Type: Note\n" in whole and "[2]\n  Type: Tool\n" in whole and "changed last" in whole and whole.endswith("Question: why?\n") and "(no entities)" in C.prompt([], "why?")


def test_plugins(tmp_path):
    for name, version, priority in (("b", "1.0", 5), ("a", "2.0", 5), ("c", "9", 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "plugin.toml").write_text(f'[plugin]\nname = "{name}"\nversion = "{version}"\npriority = {priority}\n')
    assert [m.name for m in PL.discover(str(tmp_path))] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        PL.parse_manifest('[plugin]\nname = "x"')
    r = PL.Registry()
    r.register("ai", "m", 1)
    r.activate("ai", "m")
    assert r.get("ai", "m") == 1 and r.names("ai") == ["m"]
    r.deregister("ai", "m")
    assert r.active == {} and PL.sandboxed(lambda: 1 / 0) is None and PL.sandboxed(lambda: 3) == 3


def test_snippet_takes_the_best_window(spark):
    words = ["ledger"] + ["x"] * 50 + ["harbour"] + ["y"] * 5 + ["Ledger,"] + ["z"] * 60
    text = lambda *a, **k: spark.createDataFrame([(" ".join(words),), ("none of them",), ("",)], "c string").select(K.snippet(F.col("c"), *a, **k)).collect()
    best = text(["harbour", "ledger"])
    assert best[0][0].startswith("<b>harbour</b> y") and "<b>Ledger,</b>" in best[0][0] and len(best[0][0].split()) == 32
    assert best[1][0] == "none of them" and best[2][0] == ""
    assert "<b>harbour</b>" in text([], prefixes=("harb",))[0][0]


def test_import_merge_and_undo(spark):
    ent = spark.createDataFrame([("a", "Note", True, T, T, 1), ("b", "Note", True, T, T, 4)], "id string, entity_type string, is_active boolean, created_at timestamp, updated_at timestamp, version bigint")
    comp = spark.createDataFrame([("c1", "a", "Title", '"old"'), ("c2", "b", "Title", '"kept"')], "id string, entity_id string, component_type string, data string")
    new = spark.createDataFrame([("n1", "new", "Title", '"fresh"'), ("n2", "new", "Content", '"text"')], comp.schema)
    mapping = spark.createDataFrame([("new", "a", 0.97)], "id string, canonical_id string, confidence double")
    edges = spark.createDataFrame([("new", "b", "References")], "source_id string, target_id string, relationship_type string")
    e, c, ev, log = RS.import_merged(ent, comp, new, mapping, "2024-02-02")
    assert {(r["id"], r["version"]) for r in e.collect()} == {("a", 2), ("b", 4)} and ev.first()["event_type"] == "EntityUpdated"
    assert {(r["id"], r["entity_id"]) for r in c.collect()} == {("n1", "a"), ("n2", "a"), ("c2", "b")} and log.count() == 1
    log = RS.audit(mapping, comp.union(new), "2024-02-02", edges=edges)
    back, lines, rest = RS.undone(log, log.first()["id"])
    assert {(r["id"], r["entity_id"]) for r in back.collect()} == {("c1", "a"), ("n1", "new"), ("n2", "new")}
    assert [tuple(r) for r in lines.collect()] == [("new", "b", "References")] and rest.count() == 0


def test_near_titles_against_brute_force(spark):
    """Accents included, which SQL cannot check."""
    rng = random.Random(21)
    base = ["todavía falta un índice antiguo", "niemand weiß warum das schema", "the harbour keeps the ledger", "répertoire du moulin ancien"]
    titles = sorted({"".join(ch for ch in rng.choice(base) if rng.random() > 0.12) for _ in range(60)})
    t = spark.createDataFrame([("A", x) for x in titles], "entity_type string, norm string")
    lev = lambda a, b: 1 - X_lev(a, b) / max(len(a.encode()), len(b.encode()))
    expected = {(a, b) for k, a in enumerate(titles) for b in titles[k + 1 :] if min(len(a.encode()), len(b.encode())) >= 10 and max(X.jaro_winkler(a, b), lev(a, b)) >= 0.9}
    assert {(r["a"], r["b"]) for r in RS.near_titles(t, 0.9).collect()} == expected and len(expected) > 20


def X_lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_paths_of_any_length(spark):
    e = spark.createDataFrame([(f"{k:02d}", f"{k + 1:02d}", "References") for k in range(14)] + [("x", "y", "References")], "source_id string, target_id string, relationship_type string")
    assert G.shortest_path(e, "14", "00") == [f"{k:02d}" for k in range(14, -1, -1)]
    assert G.shortest_path(e, "00", "x") is None and G.shortest_path(e, "00", "nobody") is None and G.shortest_path(e, "x", "x") == ["x"]


def test_recognition_and_vault(spark, tmp_path):
    from weft.operators import ocr as OC

    key = "1" * 8 + "-1111-1111-1111-111111111111"
    pages = spark.createDataFrame([(key, 1, b"one"), (key, 2, b"\xff"), (key, 3, None)], "entity_id string, page_no int, content binary")
    got = {r["page_no"]: r for r in OC.recognised(pages).collect()}
    assert got[1]["text"] == "one" and got[2]["confidence"] == 0.5 and got[3]["error"]
    res = spark.createDataFrame([(key, 1, "bad", 40.0), (key, 1, "good", 0.9), (key, 2, "two", None), (None, 1, "x", 1.0)], "entity_id string, page_no int, text string, confidence double")
    assert {json.loads(r["data"])["markdown"] for r in OC.content_components(res).collect()} == {"good", "two"}
    assert OC.events(res).first()["confidence"] == pytest.approx(0.7) and OC.events(res.limit(0)).count() == 0
    with pytest.raises(ValueError):
        OC.recognised(pages, "none")
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("# A")
    (tmp_path / "v" / "b.txt").write_text("B")
    (tmp_path / "v" / "sub" / "c.md").write_text("# C")
    assert [r["path"].rpartition("/")[2] for r in FS.vault(spark, str(tmp_path / "v")).collect()] == ["a.md"]


def test_vectors_of_entities(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("gone", [1.0, 0.0])], "entity_id string, vector array<float>")
    ent = spark.createDataFrame([("a", "Note", "A"), ("b", "Article", "B")], "id string, entity_type string, title string")
    assert [r["id"] for r in V.search_entities(vec, ent, [1.0, 0.0], 5).collect()] == ["a", "b"] and [r["id"] for r in V.search_entities(vec, ent, [1.0, 0.0], 5, kind="ARTICLE").collect()] == ["b"]
    assert V.removed(vec, vec.filter("entity_id = 'a'").select("entity_id")).count() == 2


def test_ignore_rules_as_expression(spark):
    rules = [*FS.DEFAULT_IGNORES, "docs/*.md", "*.t?p", "log[0-9]", "!keep.tmp", "/top.txt", "a/**/z"]
    paths = ["a/b.md", "docs/x.md", "docs/sub/x.md", "node_modules/x", "x/node_modules/y", "node_modules", "a.tmp", "keep.tmp", "k/keep.tmp", "log1", "log12", "top.txt", "b/top.txt", "a/q/z", ".git/x", "x.pyc", "dir.pyc/y", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r["p"]: r["x"] for r in df.select("p", FS.is_ignored(F.col("p"), rules).alias("x")).collect()}
    assert got == {p: FS.ignored(p, rules) for p in paths}


def test_sheets_and_deflated_pages():
    import zlib

    main = "xmlns='m' xmlns:r='http://r'"
    book = {"xl/workbook.xml": f"<workbook {main}><sheets><sheet name='B' r:id='r2'/><sheet name='A' r:id='r1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<R><x Id='r1' Target='worksheets/sheet1.xml'/><x Id='r2' Target='worksheets/sheet2.xml'/></R>"}
    book |= {"xl/worksheets/sheet1.xml": "<w><row r='1'><c r='A1'><v>no</v></c></row></w>", "xl/worksheets/sheet2.xml": "<w><row r='2'><c r='B2'><v>2</v></c><c r='AA2'><v>27</v></c></row></w>"}
    assert parsed("b.xlsx", zipped(**book))[0][1]["Content"].split("\t")[1] == "2" and parsed("b.xlsx", zipped(**book))[0][1]["Content"].split("\t")[26] == "27"
    page = zlib.compress(rb"BT (Hel\154o \(you\)) Tj [(Wor) -20 (ld)] TJ ET")
    raw = b"%PDF-1.7\n1 0 obj << /Title (A \\) title) >> endobj\n2 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj"
    assert parsed("p.pdf", raw)[0][1]["Content"] == "Hello (you)\nWorld" and parsed("p.pdf", raw)[0][1]["Title"] == "A ) title"
    seen = list(P.image("i.png", b"text in it", lambda b: (b.decode(), 0.8)))[0][1]
    assert seen["Content"] == "text in it" and seen["Provenance"]["confidence"] == 0.8


def test_chat_is_kept_as_one_change(spark, tmp_path):
    from weft.plans.model import Model

    m, store = Model(spark, "/root/testdata/sf0.001"), ST.Store(spark, str(tmp_path))
    out = C.chat(m, "Which harbour keeps the ledger?", store=store, at="2024-01-01")
    again = C.chat(m, "And the lantern?", store=store, conversation=out["conversation_id"], at="2024-01-02")
    assert again["conversation_id"] == out["conversation_id"] and store.version("entities") == store.version("events") == 2
    kinds = [r["entity_type"] for r in store.read("entities").collect()]
    assert sorted(kinds) == ["Conversation"] + ["Message"] * 4 and store.read("relationships").count() == 4
    told = [json.loads(r["data"])["role"] for r in store.read("components").filter("component_type = 'MessageContent'").collect()]
    assert sorted(told) == ["assistant"] * 2 + ["user"] * 2
    steps = list(C.chat_stream(m, "Which harbour keeps the ledger?"))
    assert [k for k, _ in steps][:3] == ["status", "status", "delta"] and steps[-1][0] == "done" and "".join(x for k, x in steps if k == "delta") == steps[-1][1]["answer"] == out["answer"]
    assert list(C.chat_stream(m, "harbour", cancelled=lambda: True))[-1] == ("cancelled", "")
    with pytest.raises(ValueError):
        C.chat(m, "x", provider="none")


def test_cut_tables_are_released(spark, tmp_path):
    from weft import session as SE

    SE.release_all(spark)
    a = SE.cut(spark.range(5))
    b = SE.cut(spark.range(3))
    SE.release(a)
    assert b.count() == 3 and SE.release_all(spark) == 1 and SE.release_all(spark) == 0
    spark.range(4).write.parquet(str(tmp_path / "in.parquet"))
    made = []
    make = lambda: made.append(1) or spark.read.parquet(str(tmp_path / "in.parquet"))
    for expected in (1, 1):
        assert SE.kept(spark, str(tmp_path), "x", make).count() == 4 and len(made) == expected
    spark.range(9).write.parquet(str(tmp_path / "more.parquet"))  # the directory changes
    assert SE.kept(spark, str(tmp_path), "x", make).count() == 4 and len(made) == 2
    SE.release_all(spark)  # a removed table is made again
    assert SE.kept(spark, str(tmp_path), "x", make).count() == 4 and len(made) == 3
    with SE.sized(spark, 10):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= 4


def test_entry_needs_no_session():
    """The driver may ask for queries and SQL before there is a session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert set(o) <= set(q) and len(q) > 90; print('fine')"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.strip() == "fine"


def test_column_queries(spark):
    d = docs(spark)
    get = lambda q: {r["entity_id"] for r in K.search(d, q).collect()}
    rows = {r["entity_id"]: r for r in d.collect()}
    for word in ("rust", "language", "programming"):
        for column in ("title", "content", "tags"):
            assert get(f"{column}:{word}") == get(f"{column.upper()} : {word}") == {k for k, r in rows.items() if word in K.re.findall(r"[a-z0-9]+", (r[column] or "").lower())}
    assert get("title:(rust AND language)") == get('title:"rust language"') | get("title:rust title:language")
    assert get("title:rus* NOT content:language") == get("title:rus*") - get("content:language")
    for bad in ("nowhere:rust", "title:", "title: AND"):
        with pytest.raises(ValueError):
            get(bad)

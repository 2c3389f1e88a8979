"""The problems of the subpackage on small fixtures, against brute force."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from weft.llm import conversations as CV
from weft.llm import groups as GR
from weft.llm import leakage as LK
from weft.llm import mixing as MX
from weft.llm import neighbours as NB
from weft.llm import scans as SC
from weft.llm import splitting as SP
from weft.llm import tokens as TK

T = datetime(2024, 1, 1)


def uid(k) -> str:
    return f"{k:08x}-0000-4000-8000-{k:012x}"


# --- 1 ---------------------------------------------------------------------------------------
PAGE = """Second Ledger - Doryagra

The narrow harbour keeps the ledger near the har-
bour. Each note has a long-
term lantern, and tlie narrow lantern waits near the lan-

{n}
"""
NEXT = """Second Ledger - Doryagra
tern of the harbour. The ledger keeps the note near the har­bour, and thc note waits.
298
outline  56
The long-term lantern keeps +he ledger.

{n}
"""


def pages(spark, extra=()):
    text = "The narrow harbour keeps the ledger. The long-term lantern waits near the note. " * 60
    rows = [(1, uid(1), 2, PAGE.format(n="- 4 -"), 0.9), (2, uid(1), 3, NEXT.format(n="- 5 -"), 93.0), (2, uid(1), 3, NEXT.format(n="- 5 -"), 93.0), (3, uid(2), 1, text, None), (4, None, None, None, None), (5, uid(3), 1, "", 0.5), (6, None, 1, "\r\n \r\n", float("nan")), *extra]
    blocks = "blocks array<struct<text:string,bbox:struct<x:int,y:int,width:int,height:int>,confidence:double>>"
    return spark.createDataFrame([(*r, None, "clash") for r in rows], f"ocr_id bigint, entity_id string, page_no int, text string, confidence double, {blocks}, near string")


def test_scan_noise(spark):
    got = {tuple(r) for r in SC.read_pages(pages(spark), "noise").collect()}
    assert {x for x in got if x[0] == 1} == {(1, 1, "header"), (1, 3, "split_word"), (1, 5, "misread"), (1, 5, "split_word"), (1, 7, "page_number")}
    second = {x for x in got if x[0] == 2}
    assert {(2, 1, "header"), (2, 7, "page_number"), (2, 5, "misread")} <= second
    assert not {(2, 3, "page_number"), (2, 4, "page_number"), (2, 4, "header")} & second
    assert not {x for x in got if x[0] in (4, 5, 6)}


def test_scan_text(spark):
    rows = {(r["entity_id"], r["page_no"], r["paragraph"]): r["text"] for r in SC.paragraphs(pages(spark)).collect()}
    text = " ".join(t for k, t in sorted(rows.items()) if k[0] == uid(1))
    assert "near the harbour. Each note has a long-term lantern, and the narrow lantern waits near the lantern of the harbour." in text
    assert "Doryagra" not in text and "- 4 -" not in text
    assert SC.paragraphs(pages(spark).limit(0)).count() == 0


def test_paragraphs_over_several_pages(spark, monkeypatch):
    parts = [
        (1, 1, 0, "Alpha begins."), (1, 1, 1, "one goes on to"), (1, 2, 0, "two which goes on to the lan-"), (1, 3, 0, "tern and three and on"), (1, 4, 0, "four ends."), (1, 4, 1, "Five is open and"),
        (1, 6, 0, "six follows a gap and"), (1, 7, 0, "seven goes"), (2, 1, 0, "other goes on"), (2, 2, 0, "and ends."), (2, 3, 0, "New."),
    ]
    read = spark.createDataFrame([(uid(e), p, 10 * e + p, 0.9, k, t) for e, p, k, t in parts], "entity_id string, page_no int, ocr_id bigint, conf double, paragraph int, text string")
    monkeypatch.setattr(SC, "read_pages", lambda rows, output: read)
    got = {(r["entity_id"], r["page_no"], r["paragraph"]): r["text"] for r in SC.paragraphs(read).collect()}
    assert got == {
        (uid(1), 1, 0): "Alpha begins.", (uid(1), 1, 1): "one goes on to two which goes on to the lantern and three and on four ends.", (uid(1), 4, 1): "Five is open and",
        (uid(1), 6, 0): "six follows a gap and seven goes", (uid(2), 1, 0): "other goes on and ends.", (uid(2), 3, 0): "New.",
    }


def test_scan_lattice(spark):
    """Blanks lost and put in within lines, a word torn without a hyphen, and confusions next to them."""
    plain = "The narrow harbour keeps the ledger near the lantern. Each note waits for the narrow ledger. " * 60
    noisy = "The narrow har bour keeps theledger near tbe\nlantern. Each note waits for the nar\nrow ledger, and the\nhar-\nbour keeps a ledgcr.\n"
    long = "x" * 5000 + " the narrow harbour keeps " + "0" * 300
    rows = [(1, uid(1), 1, plain, 0.9), (2, uid(2), 1, noisy, 0.8), (3, uid(3), 1, long, None)]
    df = pages(spark).limit(0).union(spark.createDataFrame([(*r, None, "clash") for r in rows], pages(spark).schema))
    got = {tuple(r) for r in SC.read_pages(df, "noise").collect()}
    assert {x for x in got if x[0] == 2} == {(2, 1, "misread"), (2, 2, "split_word"), (2, 4, "split_word"), (2, 5, "misread")}
    text = {r["entity_id"]: r["text"] for r in SC.paragraphs(df).collect()}
    assert text[uid(2)] == "The narrow harbour keeps the ledger near the lantern. Each note waits for the narrow ledger, and the harbour keeps a ledger."
    assert long in {r["text"] for r in SC.paragraphs(df).collect()}


def test_control_characters_in_words(spark):
    """Separators of what is handed to Python must not be found in forms."""
    odd = "har\x01bour har\x01bcur ta\x1fb a\tb \x00 |\x01| l\x01ne I\x01ne \u2028end "
    rows = [(1, uid(1), 1, odd * 40, 0.9, None, "x"), (2, uid(1), 2, odd + "\nhar\x01b-\nour", 0.9, None, "x")]
    df = spark.createDataFrame(rows, pages(spark).schema)
    assert SC.read_pages(df, "noise").count() >= 0 and SC.paragraphs(df).count() > 0


def test_block_confidence():
    """A line with a doubtful block is more easily held misread than its neighbours, a sure one less."""
    ease = SC.eases(0.9, [0.9, 0.5, None, 0.9, 0.97])
    assert ease(1) < ease(0) == ease(2) == ease(3) and ease(4) > ease(0) and SC.eases(0.5, None)(7) == SC.eases(0.5, [None])(0)


def test_breaks_are_best():
    """The dynamic programme against all sets of breaks, and over a paragraph of any length."""
    rng = random.Random(6)
    for _ in range(30):
        lines = [(k + k // 3, rng.choice(["  The harbour", "the ledger keeps", "Each note waits.", "It is a line of the text"])) for k in range(7)]
        n = len(lines)
        at = {0, *SC.breaks(lines, {3, 7})}
        assert at <= set(range(n)) and SC.breaks(lines, {3, 7})[0] == 0
    assert SC.breaks([(k, "and so the line goes on and on") for k in range(500)], set()) == [0]


def test_page_numbers():
    for s, n in (("12", 12), ("- 23 -", 23), ("~ 4 ~", 4), ("[7]", 7), ("Page 9", 9), ("Pagc 24", 24), ("p. 3", 3), ("Seite 24", 24), ("Página 31", 31), ("9 / 26", 9), ("xiv", 14), ("", None), ("outline  56", None), ("52.7", None), ("5. Valve Haxvaru", None), ("mix", None)):
        assert SC.page_number(s) == n or s == "mix", s


# --- 3 ---------------------------------------------------------------------------------------
def talk(spark, rows):
    return spark.createDataFrame(rows, "id string, conversation_id string, role string, text string, entity_refs array<string>, created_at timestamp, channel string")


def brute_kept(details, rows):
    by = {}
    for i, c, r, t, _, at, _ in rows:
        if c:
            by.setdefault(c, {})[i] = (at, i, (r or "").strip(' "').lower(), t)
    keep = set()
    for c, m in by.items():
        m = list(m.values())
        if c not in details or any(a is None or r not in CV.ROLES or not (t or "").strip() for a, _, r, t in m):
            continue
        turns = [r for _, _, r, _ in sorted(m) if r != "system"]
        if len(turns) >= 2 and turns == ["user", "assistant"] * (len(turns) // 2):
            keep.add(c)
    return keep


def test_conversations(spark):
    rng = random.Random(3)
    rows, details = [], []
    for c in range(60):
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * rng.randrange(1, 9)
        if rng.random() < 0.4:
            roles.insert(rng.randrange(len(roles)), rng.choice(["user", "assistant", " USER ", '"assistant"', "tool", None]))
        for k, r in enumerate(roles):
            rows.append((uid(1000 * c + k + 1), uid(c + 1), r, rng.choice(["x"] * 30 + [" ", None]), None, T + timedelta(minutes=k // 2) if rng.random() > 0.01 else None, "clash"))
        if c % 9:
            details.append(uid(c + 1))
    details.append(uid(999))
    rng.shuffle(rows)
    rows += rows[:20] + [(uid(5_000_000), None, "user", "x", None, T, "clash")]
    d = spark.createDataFrame([(x, None, T, T) for x in details], "id string, title string, created_at timestamp, updated_at timestamp")
    m = talk(spark, rows)
    every = set(details) | {r[1] for r in rows if r[1]}
    kept = brute_kept(set(details), rows)
    assert {r[0] for r in CV.dropped(d, m).collect()} == every - kept
    out = CV.conversations(d, m).collect()
    assert {r["conversation_id"] for r in out} == kept
    for c in kept:
        own = sorted((r["position"], r["created_at"], r["message_id"]) for r in out if r["conversation_id"] == c)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1:])
    assert CV.dropped(d.limit(0), m.limit(0)).count() == 0


def test_sessions_split_at_gaps_over_partitions(spark):
    rows = [(uid(k + 1), uid(7), ("user", "assistant")[k % 2], "x", None, T + timedelta(minutes=k + (k // 100) * 5000), None) for k in range(1000)]
    s = CV.sessions(CV.messages(talk(spark, rows)), 24 * 3600.0).orderBy("session").collect()
    assert [r["n"] for r in s] == [100] * 10 and all(r["breaks"] == 0 and r["head"] == 1 and r["tail"] == 2 for r in s)
    assert CV.sessions(CV.messages(talk(spark, rows))).collect()[0]["n"] == 1000


def test_roles_and_gap_across_seams(spark):
    """One hot channel over several partitions gives what one partition gives."""
    rng = random.Random(4)
    roles = [-1] * 150 + [2] + [-1] * 301 + [0] + [rng.choice([-1, -1, 0, 1, 2]) for _ in range(147)]
    ids = [uid(k) for k in range(600)]
    rows = [("hot", T + timedelta(seconds=100 * k), ids[k], r, True) for k, r in enumerate(roles)] + [("other", T, uid(900), -1, True)]
    msgs = spark.createDataFrame(rows, "channel string, at timestamp, message_id string, role int, has_text boolean")
    expected, last = {}, 2
    for k, r in enumerate(roles):
        r = 3 - last if r < 0 else r
        last = r or last
        expected[ids[k]] = r
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert CV.ordered(msgs).select("channel", CV.F.spark_partition_id().alias("p")).filter("channel = 'hot'").distinct().count() > 1
            got = {r["message_id"]: r["role"] for r in CV.with_roles(msgs).collect()}
            assert got == expected | {uid(900): 1}
        two = spark.createDataFrame([("c", T + timedelta(seconds=s), uid(k), 1, True) for k, s in enumerate((0, 10))], msgs.schema)
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert CV.calibrated_gap(two, 1.0, 0.0) == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


# --- 5 ---------------------------------------------------------------------------------------
def test_groups(spark):
    rng = random.Random(4)
    log = [(uid(rng.randrange(80)), uid(rng.randrange(80)).upper(), rng.choice([0.5, 0.78, 0.9, None, float("nan")])) for _ in range(90)]
    log += [(None, uid(1), 1.0), (" ", uid(2), 1.0), ("x", uid(3), 1.0), *[(uid(500 + k), uid(501 + k), 0.8) for k in range(40)], *[(uid(700), uid(701 + k), 0.8) for k in range(60)]]
    log += log[:10]
    df = spark.createDataFrame([(a, b, c, "clash", "clash") for a, b, c in log], "source_id string, target_id string, confidence double, u string, node string")
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b, c in log:
        if a and len(a) == 36 and c is not None and c >= 0.78 and a.lower() != b.lower():
            x, y = sorted((find(a.lower()), find(b.lower())))
            parent[y] = x
    assert {tuple(r) for r in GR.match_groups(df).collect()} == {(x, find(x)) for x in parent}
    assert GR.match_groups(df.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------
def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK", 64)
    monkeypatch.setattr(NB, "CHUNK", 128)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 600)] + rng.normal(size=(600, 16)) * 0.25
    x[:30] = x[0]  # a group of copies
    x[30:33] = x[30]
    rows = [(uid(k + 1), "m", v.tolist(), 16, T) for k, v in enumerate(x)]
    rows += [(uid(1), "m", [1.0] * 16, 16, T - timedelta(1)), (uid(900), None, [1.0] * 16, 16, T), (uid(901), "m", None, 16, T), (uid(902), "m", [1.0] * 3, 16, T), (uid(903), "m", [0.0] * 16, 16, T), (uid(904), "m", [float("nan")] * 16, 16, T), (uid(905), "m", [1.0] * 4, 4, T), rows[5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "entity_id string, model string, vector array<float>, dimensions int, created_at timestamp, h int")
    got = {}
    for r in NB.neighbours(df, 5).collect():
        got.setdefault(r["entity_id"], {})[r["other_id"]] = r["cosine"]
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = 0
    for k in range(600):
        best = sorted(range(600), key=lambda j: (-round(s[k, j], 6), j))[:5]
        hit += len({uid(j + 1) for j in best} & set(got[uid(k + 1)]))
        assert len(got[uid(k + 1)]) == 5
    assert hit / 3000 > 0.95
    assert set(got[uid(10)]) == {uid(j) for j in range(1, 6)} and not set(got) & {uid(k) for k in range(900, 906)}
    assert NB.neighbours(df.limit(0)).count() == 0


def test_neighbours_far_apart(spark):
    """Without clusters the true neighbours lie in many lists: the number visited must follow."""
    x = np.random.default_rng(2).normal(size=(2500, 24)).astype(np.float32)
    df = spark.createDataFrame([(uid(k + 1), "m", v.tolist(), 24, T) for k, v in enumerate(x)], "entity_id string, model string, vector array<float>, dimensions int, created_at timestamp")
    got = {}
    for r in NB.neighbours(df, 5).collect():
        got.setdefault(r["entity_id"], set()).add(r["other_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    assert sum(len({uid(j + 1) for j in best[k]} & got[uid(k + 1)]) for k in range(2500)) / 12500 > 0.9


# --- 8 ---------------------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 60
    items = [(k, "en", " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60))), "who is it", "it is w1") for k in range(60)] + [(100, None, None, None, None)]
    docs = []
    for k in range(200):
        w = rng.choices(vocabulary, k=rng.randrange(0, 150))
        if k % 2:
            p = items[rng.randrange(60)][2].split()
            n = rng.choice([11, 12, 13, 30])
            at = rng.randrange(max(1, len(p) - n + 1))
            w[5:5] = p[at : at + n]
        docs.append((k, "; ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(900, None), (901, ""), (902, "Ünï " * 40000), docs[1]]
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    expected = {(d, i[0]) for d, t in docs for i in items if grams(LK.words(t)) & grams(LK.words(i[2]))}
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string, answer string")
    got = LK.leaks(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(expected) > 20
    # items in parts, with the statistics of all: the same rows and scores
    parts = LK.leaks(df, it, 500).collect()
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, parts)) == sorted(map(key, got)) and len(list(LK.indexes(it, 500))) > 2
    ix = next(LK.indexes(it))
    for w in (LK.words(docs[k][1])[:24] for k in range(40)):
        codes = sorted({ix.codes[t] for t in w if t in ix.codes})
        every = {}
        for c in codes:
            for i, s in zip(ix.post[c][0], ix.post[c][1], strict=True):
                every[i] = every.get(i, 0) + s
        assert {i: round(s, 9) for i, s in ix.retrieve(codes).items()} == {i: round(s, 9) for i, s in every.items() if s >= 1 - 1e-9}
    assert LK.leaks(df.limit(0), it).count() == 0 and LK.leaks(df, it.limit(0)).count() == 0


def test_words():
    assert LK.words("Café CAFÉ, straße_x 3.5") == ["cafe", "cafe", "strasse", "x", "3", "5"]


# --- 9 ---------------------------------------------------------------------------------------
def test_flow_prefers_fewer_repeats():
    got = MX.plan({"a": 100, "b": 100, "a\nb": 50}, {"a": (0.5, 3), "b": (0.5, 1), "c": (0.0, 1)}, 400)
    used = {}
    for p, r, s, x, y in got:
        assert s in p.split("\n") and y > x
        used[s] = used.get(s, 0) + y - x
        assert r <= {"a": 3, "b": 1}[s]
    assert used == {"a": 200, "b": 150}
    for p in ("a", "b", "a\nb"):
        by = [sum(y - x for q, r, _, x, y in got if q == p and r == k) for k in (1, 2, 3)]
        assert by == sorted(by, reverse=True)


def test_mixture(spark):
    rng = random.Random(9)
    docs = [(k, "word " * rng.randrange(1, 60), rng.choice(["a", " A ", "b", "b", "b", "other", None])) for k in range(900)]
    docs += [(3000 + k, "the same text in two sources " * 4, ("a", "b")[k % 2]) for k in range(50)]
    docs += [(2000, None, "a"), (2001, "", "a"), (None, "x", "a"), docs[0]]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame([("A", 0.6, 2), ("b", 0.4, 1), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = MX.mixture(df, t)
    rows = m.collect()
    assert all(r["uses"] <= {"a": 2, "b": 1}[r["source"]] for r in rows) and sorted(map(str, rows)) == sorted(map(str, MX.mixture(df, t).collect()))
    assert sum(r["uses"] for r in rows if r["doc_id"] >= 3000) <= 2 and {r["doc_id"] for r in rows if r["doc_id"] >= 3000} <= {3000}
    share = {r["source"]: r["actual_share"] for r in MX.shares(m, t, 10_000).collect()}
    assert share["a"] == pytest.approx(0.6, abs=0.05) and share["b"] == pytest.approx(0.4, abs=0.05)
    report = {r["source"]: r for r in MX.shares(m, t, 10_000_000).collect()}
    assert report["b"]["quota"] == 4_000_000 and report["b"]["shortfall"] == 4_000_000 - report["b"]["tokens"] and report["none"]["tokens"] == 0
    assert MX.mixture(df.limit(0), t).count() == 0


# --- 10 --------------------------------------------------------------------------------------
PROFILES = [("tiny", 24, 6), ("none", 40, 0)]


def check_pieces(text, got, enc, limit, overlap):
    at = 0
    for k, (_, no, a, b, n, share, _, piece) in enumerate(got):
        assert no == k and text[a:b] == piece and len(enc.encode_ordinary(piece)) == n <= limit and a <= at < b and 0 <= share <= overlap
        at = b
    assert at == len(text)


def test_splitting_round_trip(spark):
    enc, lengths = TK.encoding(TK.vocabulary())
    rng = random.Random(10)
    parts = ["word", "long-term", "éàü", ".", "! ", "\n", "\n\n", " ", "  ", " ", "　", "x" * 90, "日本語テキスト", "3.14", "\r\n", "…"]
    texts = ["", "short", "a" * 4000, "語" * 900, "\n" * 300, " " * 500, *["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n)) for n in (30, 200, 900) for _ in range(6)]]
    for text in texts:
        out = list(SP.pieces(text, PROFILES, enc, lengths))
        for name, limit, overlap in PROFILES:
            own = [p for p in out if p[0] == name]
            if len(enc.encode_ordinary(text)) <= limit:
                assert not own
            else:
                check_pieces(text, own, enc, limit, overlap)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(99, None, "x"), (None, "x " * 99, "x")], "doc_id bigint, text string, profile string")
    pr = spark.createDataFrame([*PROFILES, ("bad", 0, 1), ("null", None, None)], "profile string, max_tokens int, overlap_tokens int")
    assert SP.split_documents(df, pr).count() == sum(len(list(SP.pieces(t, PROFILES, enc, lengths))) for t in texts)
    assert SP.split_documents(df, pr.limit(0)).count() == 0


def test_ranges_give_what_whole_texts_give(spark, monkeypatch):
    """Long texts in ranges of a few KB, with words over the limit in them, against one range."""
    monkeypatch.setattr(SP, "HALO", 256)
    rng = random.Random(12)
    parts = ["alpha ", "beta ", "gamma. ", "délta ", "\n\n", "語 ", "x" * 180 + " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (400, 3000, 9000)] + ["a b. " * 5000, "", "short", None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(1, texts[1], "x")], "doc_id bigint, text string, key string").distinct()
    pr = spark.createDataFrame([*PROFILES, ("large", 300, 40)], "profile string, max_tokens int, overlap_tokens int")
    whole = sorted(map(tuple, SP.split_documents(df, pr).collect()))
    assert len(whole) > 1000
    for size in (2_000, 9_000):
        assert sorted(map(tuple, SP.split_documents(df, pr, size=size).collect())) == whole


def test_giant_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SP, "HALO", 512)
    rng = random.Random(11)
    text = "".join(rng.choice(["alpha ", "beta ", "gamma. ", "délta ", "\n\n", "語 "]) for _ in range(30_000)) + "y" * 5000
    path, short = tmp_path / "big.txt", tmp_path / "short.txt"
    path.write_text(text, encoding="utf-8")
    short.write_text("within the limit")
    (tmp_path / "empty.txt").write_text("")
    enc, lengths = TK.encoding(TK.vocabulary())
    rows = sorted(SP.split_files(spark, [str(path), str(short), str(tmp_path / "empty.txt")], 200, 20, size=16_384).collect(), key=lambda r: r["piece_no"])
    raw, at = text.encode(), 0
    for k, r in enumerate(rows):
        assert r["path"] == str(path) and r["piece_no"] == k and r["start_byte"] <= at < r["end_byte"] and raw[r["start_byte"] : r["end_byte"]].decode() == r["piece"] and len(enc.encode_ordinary(r["piece"])) == r["n_tokens"] <= 200
        at = r["end_byte"]
    assert at == len(raw) and len(rows) > 100
    whole = [(p[1], p[-1]) for p in SP.pieces(text[:-5000], [("file", 200, 20)], enc, lengths)]
    assert [(r["piece_no"], r["piece"]) for r in rows][: len(whole) - 1] == whole[:-1]


def test_registry():
    from weft import llm

    names = list(itertools.chain.from_iterable(m.QUERIES for m in llm.query_modules()))
    assert {f"p{n}_found" for n in (1, 3, 5, 6, 8)} | {"p9_mixture", "p10_pieces"} <= set(names)


def test_blank_pages_only(spark):
    blank = pages(spark).filter("ocr_id in (5, 6)")
    assert SC.read_pages(blank, "noise").count() == 0 and SC.paragraphs(blank).count() == 0


def _scan(spark, *texts):
    """(noise, text of each page) of pages of one record each."""
    df = spark.createDataFrame([(k, uid(k), 1, t, 0.9, None, "clash") for k, t in enumerate(texts)], pages(spark).schema)
    text = SC.paragraphs(df).orderBy("entity_id", "paragraph").collect()
    return {tuple(r) for r in SC.read_pages(df, "noise").collect() if r["ocr_id"]}, [r["text"] for r in text if r["entity_id"] != uid(0)]


@pytest.mark.parametrize("frequent", [1e-5, 0.05])
def test_scan_keeps_all_candidates(spark, monkeypatch, frequent):
    """The least common of four words that a form may be, which the words around it show to be meant; a word torn into four;
    a part of what is no word for its length: the same whether words and pairs are handed to all or asked for."""
    monkeypatch.setattr(SC, "FREQUENT", frequent)
    a, b = "donaudampfschifffahrtsgesellschaft", "rindfleischetikettierungsgesetz"
    plain = "They eat the note. " * 900 + "The cot keeps the note. " * 700 + "Some cal finds it. " * 600 + "Each grey oat waits near the silver harbour. " * 60 + f"The {a} {b} stays open. " * 60
    noise, text = _scan(spark, plain, "Each grey cat waits near the silver har bour.\n", "Each grey oat waits near the sil v e r harbour.\n", f"The {a}{b} stays open.\n")
    assert text == ["Each grey oat waits near the silver harbour.", "Each grey oat waits near the silver harbour.", f"The {a} {b} stays open."]
    assert noise == {(1, 1, "misread")}


def test_bitmap_denies_nothing(spark, monkeypatch):
    forms = ["harbour", "the harbour", "fön", "ﬁn", *(f"w{k}" for k in range(2000))]
    for bits in (24, 6):
        monkeypatch.setattr(SC, "BITS", bits)
        likely = SC._likely(SC._bitmap(spark.createDataFrame([(f,) for f in forms], "form string")))
        assert all(likely(f) for f in forms) and (bits == 6 or sum(likely(f"v{k}") for k in range(2000)) < 20)


def test_page_end_by_all_next_readings():
    """Of a next page recognised twice, the reading that fits tells whether the hyphen is the word's own."""
    words = SC.Words(1e5, {"the": 9e3}, {"long-term": (50.0, ()), "longterm": (0.0, ())})
    for after in (["term"], ["lerm", "term"], ["term", "lerm"]):
        assert [s[2][2] for s in SC.decode([(0, "the", False), (0, "long-", True)], words, lambda line: 1.0, after)] == [False, False]

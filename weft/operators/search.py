"""Keyword search: inverted index, BM25, boolean queries, snippets."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BM25 with the constants of the reference's full-text index.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Words that are never search terms.
STOPWORDS = [
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "do", "does", "did", "doing", "have", "has", "had", "having", "you", "your", "yours",
    "yourself", "i", "me", "my", "mine", "we", "our", "us", "they", "them", "their", "theirs", "it", "its", "this", "that", "these", "those", "is", "are", "was",
    "were", "be", "been", "being", "am", "can", "could", "would", "should", "will", "shall", "may", "might", "must", "of", "in", "on", "at", "to", "for", "from",
    "with", "by", "about", "into", "through", "during", "the", "a", "an", "and", "or", "but", "not", "no", "so", "if", "then", "than", "too", "very", "just",
    "like", "also", "there", "here",
]


def _accents() -> tuple[str, str]:
    """The Latin letters with marks and their plain ones, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for a, z in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, z)]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_PLAIN, _BASE = _accents()


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits without the accents of Latin letters, set or combining."""
    folded = F.lower(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u0300-\\u036f]", ""), _PLAIN, _BASE))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower(translate(regexp_replace(coalesce({c}, ''), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '{_PLAIN}', '{_BASE}')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def search_docs(flat: DataFrame) -> DataFrame:
    """The indexed fields of each active entity."""
    return flat.select(F.col("id").alias("entity_id"), "entity_type", "title", F.coalesce("content", F.lit("")).alias("content"), F.array_join("tags", ", ").alias("tags"), F.col("tags").alias("tag_list"))


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, entity_id, tf, positions) and lengths (entity_id, len and those of title and
    content: positions run through title, content and tags)."""
    words = docs.select("entity_id", F.concat(tokens(F.col("title")), tokens(F.col("content")), tokens(F.col("tags"))).alias("w"), F.size(tokens(F.col("title"))).alias("title_len"), F.size(tokens(F.col("content"))).alias("content_len"))
    each = words.select("entity_id", F.posexplode("w").alias("pos", "term"))
    postings = each.groupBy("term", "entity_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, words.select("entity_id", F.size("w").alias("len"), "title_len", "content_len")


COLUMNS = ("title", "content", "tags")


def in_column(postings: DataFrame, lengths: DataFrame, column: str) -> DataFrame:
    """Postings with only the positions within one column."""
    begin = {"title": F.lit(0), "content": F.col("title_len"), "tags": F.col("title_len") + F.col("content_len")}[column]
    end = {"title": F.col("title_len"), "content": F.col("title_len") + F.col("content_len"), "tags": F.col("len")}[column]
    rows = postings.join(lengths, "entity_id").withColumn("b", begin).withColumn("e", end)
    held = rows.withColumn("positions", F.filter("positions", lambda p: (p >= F.col("b")) & (p < F.col("e")))).filter(F.size("positions") > 0)
    return held.select("term", "entity_id", F.size("positions").cast("bigint").alias("tf"), "positions")


def bm25(postings: DataFrame, lengths: DataFrame, terms: list[str], scale: float = 1.0, prefixes: tuple = (), columns: dict | None = None) -> DataFrame:
    """(entity_id, score, hits): negative scores, the best least; hits the distinct terms met.
    Every term that begins with one of the prefixes counts as a term; columns: by column the terms and
    prefixes that count only there.

    Only the query's terms leave the index; statistics are one row."""
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    asked = lambda ts, ps: reduce(lambda a, p: a | F.col("term").startswith(p), ps, F.col("term").isin(ts))
    wanted = postings.filter(asked(terms, prefixes)).select("term", "entity_id", "tf")
    for column, (ts, ps) in sorted((columns or {}).items()):
        held = in_column(postings.filter(asked(ts, ps)), lengths, column)
        wanted = wanted.unionByName(held.select(F.concat(F.lit(f"{column}:"), "term").alias("term"), "entity_id", "tf"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    rows = wanted.join(df, "term").join(lengths, "entity_id").join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.groupBy("entity_id").agg((-scale * F.sum(part)).alias("score"), F.count("*").alias("hits"))


def phrase(postings: DataFrame, words: list[str]) -> DataFrame:
    """Entities in which the words follow one another."""

    def starts(k: int) -> Column:
        return F.transform("positions", lambda p: p - k).alias(f"p{k}")

    hits = [postings.filter(F.col("term") == w).select("entity_id", starts(k)) for k, w in enumerate(words)]
    every = reduce(lambda a, b: a.join(b, "entity_id"), hits)
    common = reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(words))])
    return every.filter(F.size(common) > 0).select("entity_id")


def prefix(postings: DataFrame, start: str) -> DataFrame:
    return postings.filter(F.col("term").startswith(start)).select("entity_id").distinct()


_LEX = re.compile(r'"([^"]*)"|(\()|(\))|([^\s()"]+)')


def parse(query: str):
    """AND, OR, NOT, phrases, prefix*, brackets and column: before any of these; neighbours are ANDed. A tuple tree."""
    if query.count('"') % 2:
        raise ValueError("unterminated string")
    query = "".join(p if k % 2 else re.sub(r"([^\s()]+?)\s*:\s*", r" \1: ", p) for k, p in enumerate(re.split(r'("[^"]*")', query)))
    lexed = [("phrase", m[1]) if m[0].startswith('"') else (m[0], m[0]) if m[0] in "()" else ("word", m[0]) for m in _LEX.finditer(query)]
    at = 0

    def peek():
        return lexed[at] if at < len(lexed) else (None, None)

    def either():
        nonlocal at
        left = both()
        while peek() == ("word", "OR"):
            at += 1
            left = ("or", left, both())
        return left

    def both():
        nonlocal at
        left = unit()
        while peek()[0] is not None and peek() != ("word", "OR") and peek()[0] != ")":
            if peek() == ("word", "NOT"):
                at += 1
                left = ("not", left, unit())
            else:
                at += peek() == ("word", "AND")
                left = ("and", left, unit())
        return left

    def unit():
        nonlocal at
        kind, text = peek()
        at += 1
        if kind == "(":
            inner = either()
            if peek()[0] != ")":
                raise ValueError("missing )")
            at += 1
            return inner
        if kind is None or kind == ")" or text in ("AND", "OR", "NOT"):
            raise ValueError("syntax error in query")
        if kind == "word" and text.endswith(":"):
            if text[:-1].lower() not in COLUMNS:
                raise ValueError(f"no such column: {text[:-1]}")
            return ("column", text[:-1].lower(), unit())
        words = [w for w in re.split(r"[^\w]+|_", re.sub("[\u0300-\u036f]", "", text).translate(str.maketrans(_PLAIN, _BASE)).lower()) if w]
        if kind == "word" and text.endswith("*"):
            return ("prefix", words[0])
        return ("phrase", words) if len(words) > 1 else ("term", words[0] if words else "")

    tree = either()
    if at != len(lexed):
        raise ValueError("syntax error in query")
    return tree


def matching(postings: DataFrame, tree, lengths: DataFrame | None = None) -> DataFrame:
    """The entities a parsed query admits, by semi, anti and union; lengths are needed for columns."""
    op = tree[0]
    if op == "column":
        return matching(in_column(postings, lengths, tree[1]), tree[2], lengths)
    if op == "term":
        return postings.filter(F.col("term") == tree[1]).select("entity_id")
    if op == "prefix":
        return prefix(postings, tree[1])
    if op == "phrase":
        return phrase(postings, tree[1])
    a, b = matching(postings, tree[1], lengths), matching(postings, tree[2], lengths)
    if op == "or":
        return a.union(b).distinct()
    return a.join(b, "entity_id", "left_semi" if op == "and" else "left_anti")


def _terms(tree, kind: str = "term") -> list[str]:
    """The query's terms (or its prefixes) outside NOT."""
    if tree[0] in ("term", "prefix"):
        return [tree[1]] if tree[0] == kind else []
    if tree[0] == "phrase":
        return tree[1] if kind == "term" else []
    if tree[0] == "column":
        return []
    return _terms(tree[1], kind) + ([] if tree[0] == "not" else _terms(tree[2], kind))


def _columns(tree) -> dict[str, tuple[list, list]]:
    """By column the terms and prefixes asked for in it, outside NOT."""
    if tree[0] == "column":
        inner = _columns(tree[2])
        own = inner.setdefault(tree[1], ([], []))
        own[0].extend(_terms(tree[2]))
        own[1].extend(_terms(tree[2], "prefix"))
        return inner
    out: dict[str, tuple[list, list]] = {}
    for part in tree[1:] if tree[0] in ("and", "or") else tree[1:2] if tree[0] == "not" else ():
        for c, (ts, ps) in _columns(part).items():
            own = out.setdefault(c, ([], []))
            own[0].extend(ts)
            own[1].extend(ps)
    return out


def search(docs: DataFrame, query: str, kind: str | None = None, tag: str | None = None, limit: int | None = None, scale: float = 1.0, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(entity_id, score, snippet) by BM25, filtered by type and tag; held: postings and lengths of a kept index."""
    postings, lengths = held or index(docs)
    tree = parse(query)
    terms = sorted(set(_terms(tree)))
    prefixes, columns = tuple(sorted(set(_terms(tree, "prefix")))), _columns(tree)
    found = bm25(postings, lengths, terms, scale, prefixes, columns).join(matching(postings, tree, lengths), "entity_id", "left_semi")
    shown = sorted({*terms, *(t for ts, _ in columns.values() for t in ts)})
    begun = (*prefixes, *(p for _, ps in columns.values() for p in ps))
    rows = docs if kind is None else docs.filter(F.lower("entity_type") == kind.lower())
    rows = rows if tag is None else rows.filter(F.array_contains("tag_list", tag))
    out = found.join(rows.select("entity_id", "content"), "entity_id").select("entity_id", "score", snippet(F.col("content"), shown, prefixes=begun).alias("snippet"))
    return out.orderBy("score", "entity_id").limit(limit) if limit else out


def snippet(content: Column, terms: list[str], width: int = 32, prefixes: tuple = ()) -> Column:
    """The window of `width` words with most different terms, of these the one with most hits, then the
    earliest; it begins at a hit (the text's first word if there is none) unless that would leave it short. Hits in <b>."""
    words = F.split(F.trim(content), r"\s+")
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    term = lambda w: F.filter(tokens(w), lambda t: reduce(lambda a, p: a | t.startswith(p), prefixes, F.array_contains(asked, t)))
    # (place, term) of the hits: windows are counted over these alone
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.get(term(w), F.lit(0)).alias("t"))), lambda h: h["t"].isNotNull())
    begin = lambda h: F.greatest(F.least(h["i"], F.size(words) - width), F.lit(0))
    inside = lambda h: F.filter(hits, lambda g: (g["i"] >= begin(h)) & (g["i"] < begin(h) + width))
    scored = F.transform(hits, lambda h: F.struct(F.size(F.array_distinct(F.transform(inside(h), lambda g: g["t"]))).alias("terms"), F.size(inside(h)).alias("n"), (-begin(h)).alias("at")))
    start = F.coalesce(-F.array_max(scored)["at"], F.lit(0)) + 1
    return F.array_join(F.transform(F.slice(words, start, width), lambda w: F.when(F.size(term(w)) > 0, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")


def retrieval(docs: DataFrame, query: str, kinds: tuple = (), tags: tuple = (), limit: int = 20, held: tuple | None = None) -> DataFrame:
    """A search by the first type and the first tag only, best first, as summaries."""
    found = search(docs, query, kinds[0] if kinds else None, tags[0] if tags else None, limit, held=held).select("entity_id", "score")
    rows = docs.select("entity_id", "entity_type", "title", F.substring("content", 1, 200).alias("preview"), "tags")
    return found.join(rows, "entity_id").orderBy("score", "entity_id")


def mentions(docs: DataFrame, text: str, held: tuple | None = None) -> DataFrame:
    """Candidates for a mention: the raw text as a keyword query, all of them, best first."""
    found = search(docs, text, held=held).select("entity_id", "score")
    return found.join(docs.select("entity_id", "entity_type", "title", F.substring("content", 1, 200).alias("preview")), "entity_id").orderBy("score", "entity_id")


def chat_terms(c: Column) -> Column:
    """Lower-case words of at least 3 bytes that are no stop words, repeats kept."""
    words = F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w))

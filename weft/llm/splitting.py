"""Problem 10: oversized items split at natural boundaries.

A text's boundaries are the places before white space, graded by what follows and precedes them:
paragraph, line or sentence, word. There the tokenizer's own splits fall, so the number of tokens
between two boundaries is a difference of prefix sums and pieces are planned from the boundary
table alone: the last best boundary in the second half of what fits, and the next piece begins at the
first boundary within the overlap. A stretch without white space longer than the limit is cut
into measured parts, and no piece runs over such a cut.

Texts and files of more than RANGE bytes are processed in byte ranges: each worker reads its range with
halos and makes the boundary table of the stretch from its first boundary to the first one of
the next range. Where the pieces of a range begin depends only on where the last piece before it
ends, so every range also makes the map from that end to the one that leaves it, with the number
of pieces; these short maps are stitched in order, numbers of pieces and characters are summed up, and pieces
are emitted by offset from the range's own bytes.

Defined results: a text of at most max_tokens tokens gives no pieces; null and empty texts
give none; pieces cover the text without gap, each is a substring of at most max_tokens tokens,
and consecutive ones share at most overlap_tokens (fewer by part of a word, none at a hard cut); lone
surrogates are replaced; a profile with a null or non-positive limit gives no pieces, an overlap is cut to half
the limit; the pieces are the same for any size of ranges, but for words longer than HALO, which a
range's bound cuts; repeated rows of a giant text give its pieces once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.tokens import TOKENIZER, clean, encoding, vocabulary
from weft.session import cut, spread, table

KINDS = ("hard", "word", "sentence", "paragraph", "end")
#: Bytes of a range, and of the part of its halo in which its ends must find a boundary.
RANGE, HALO = 1 << 22, 1 << 16


_WHITE, _STOP, _CLOSE = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_CLASS[[33, 46, 63]] = _STOP
_CLASS[[34, 39, 41, 93]] = _CLOSE


def boundaries(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets before white space, and their grades (1 word, 2 sentence or line, 3 paragraph)."""
    n = len(raw)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    white = _CLASS[raw] == _WHITE
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1  # text to white and back, in turn
    if white[0]:
        turn = turn[1:]
    at, to = turn[::2], turn[1::2]
    if len(to) < len(at):
        to = np.append(to, n)
    a, b = raw[at - 1], raw[at - 2]  # of a text of one byte before, b is the last byte: no stop is mistaken
    ca, cb = _CLASS[a], _CLASS[b]
    stop = (ca == _STOP) | ((ca == _CLOSE) & (cb == _STOP))
    if raw.max() >= 0xC2:
        c = raw[at - 3]
        # white space beyond ASCII just before would join the run
        wide = ((b == 0xC2) & ((a == 0xA0) | (a == 0x85))) | ((c == 0xE3) & (b == 0x80) & (a == 0x80)) | ((c == 0xE1) & (b == 0x9A) & (a == 0x80))
        wide |= (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
        stop |= (c == 0xE2) & (b == 0x80) & (a == 0xA6)
        at, to, stop = at[~wide], to[~wide], stop[~wide]
    lines = np.flatnonzero(raw == 10)
    breaks = np.searchsorted(lines, to) - np.searchsorted(lines, at)
    grade = np.where(breaks >= 2, 3, np.where((breaks == 1) | stop, 2, 1)).astype(np.int8)
    return at, grade


def token_table(text: str, enc, lengths: np.ndarray) -> tuple:
    """(bytes, token ends, boundary offsets, grades, tokens before each boundary)."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(lengths[np.array(enc.encode_ordinary(text), np.int64)])
    at, grade = boundaries(raw)
    k = np.searchsorted(ends, at)
    fits = ends[np.minimum(k, len(ends) - 1)] == at if len(ends) else np.zeros(0, bool)
    return raw, ends, at[fits], grade[fits], k[fits] + 1


def cut_points(whole: bytes, table: tuple, limit: int, enc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, tokens before, grade) of all places where a piece may end, the ends of the text
    included. A stretch of more than `limit` tokens without a boundary gets hard points (grade 0),
    each measured part within the limit; no piece runs over one, so counts stay exact."""
    _, ends, at, grade, before = table
    off, tok = np.r_[0, at, len(whole)], np.r_[0, before, len(ends)]
    kind = np.r_[4, grade, 4].astype(np.int8)
    wide = np.flatnonzero(np.diff(tok) > limit)
    for g in wide[::-1].tolist():
        cuts = list(_measured(whole, int(off[g]), int(off[g + 1]), limit, enc))
        sums = tok[g] + np.cumsum([n for _, _, n in cuts])
        moved = tok[g + 1 :] - tok[g + 1] + sums[-1]
        off = np.r_[off[: g + 1], [y for _, y, _ in cuts[:-1]], off[g + 1 :]].astype(np.int64)
        tok = np.r_[tok[: g + 1], sums[:-1], moved].astype(np.int64)
        kind = np.r_[kind[: g + 1], np.zeros(len(cuts) - 1, np.int8), kind[g + 1 :]].astype(np.int8)
    return off, tok, kind


def _measured(whole: bytes, x: int, y: int, limit: int, enc) -> Iterator[tuple[int, int, int]]:
    """Cuts of whole[x:y] at character bounds, each encoded and within the limit; a cut depends
    only on where it begins and on the 4 * limit bytes from there."""

    def moved(q: int) -> int:
        while q < y and whole[q] & 0xC0 == 0x80:
            q += 1
        return q

    while x < y:
        q = moved(min(y, x + 4 * limit))
        while (n := len(enc.encode_ordinary(whole[x:q].decode("utf-8", "replace")))) > limit:
            q = moved(x + max(1, (q - x) * limit // (n + 1)))
        yield x, q, n
        x = q


def nexts(tok: np.ndarray, grade: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point, as the end of a piece: (where the next piece begins, where it ends).

    The next piece begins at the first point within the overlap and ends at the last point of
    the best grade in the second half of what fits, at a hard point at the latest. As that depends on
    the end of the piece before alone, the pieces of any range follow from where its first one begins."""
    i = np.arange(len(tok))
    hard = grade == 0
    start = i
    if overlap:
        start = np.maximum(np.searchsorted(tok, tok - overlap), np.maximum.accumulate(np.where(hard, i, 0)))
        start = np.where(np.searchsorted(tok, tok[start] + limit, "right") - 1 > i, start, i)
    reach = np.searchsorted(tok, tok[start] + limit, "right") - 1
    end = reach
    for g in (2, 3):
        best = np.maximum.accumulate(np.where(grade >= g, i, -1))[reach]
        end = np.where((best > i) & (tok[best] > tok[start] + limit // 2), best, end)
    if hard.any():
        stop = np.r_[np.minimum.accumulate(np.where(hard, i, len(i))[::-1])[::-1][1:], len(i)]
        end = np.where(stop <= reach, stop, end)
    return start, end


def walk(start: np.ndarray, end: np.ndarray, first: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(end of the piece before, begin, end) of the pieces that follow point `first`, until one ends at `stop` or later."""
    e = first
    while e < stop:
        yield e, int(start[e]), int(end[e])
        e = int(end[e])


def pieces(text: str, profiles: list[tuple[str, int, int]], enc, lengths: np.ndarray) -> Iterator[tuple]:
    """(profile, piece_no, start, end, n_tokens, overlap, kind, piece) of a text of one range, offsets in characters."""
    if len(text.encode("utf-8")) <= min(m for _, m, _ in profiles):
        return  # fewer bytes than tokens allowed
    found = token_table(text, enc, lengths)
    raw, total = found[0], len(found[1])
    if total <= min(m for _, m, _ in profiles):
        return
    whole = raw.tobytes()
    # characters before each byte; of ASCII text the offsets themselves
    chars = np.arange(len(raw) + 1) if len(raw) == len(text) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    for name, limit, overlap in profiles:
        if total <= limit:
            continue
        off, tok, grade = cut_points(whole, found, limit, enc)
        for no, (e, b, f) in enumerate(walk(*nexts(tok, grade, limit, overlap), 0, len(off) - 1)):
            x, y = int(off[b]), int(off[f])
            yield name, no, int(chars[x]), int(chars[y]), int(tok[f] - tok[b]), int(tok[e] - tok[b]), KINDS[grade[f]], whole[x:y].decode("utf-8")


_OUT = "profile string, doc_id bigint, piece_no int, start_char bigint, end_char bigint, n_tokens int, overlap int, boundary string, piece string"


def profile_rows(profiles: DataFrame) -> list[tuple[str, int, int]]:
    """The profiles (a small fixed table) as tuples."""
    rows = profiles.select("profile", "max_tokens", "overlap_tokens").filter("profile is not null and max_tokens > 0").distinct().collect()
    return sorted((r[0], r[1], max(0, min(r[2] or 0, r[1] // 2))) for r in rows)


def split_documents(documents: DataFrame, profiles: DataFrame, tokenizer: str = TOKENIZER, with_text: bool = True, size: int = RANGE) -> DataFrame:
    """The pieces of each text longer than a profile's limit. Texts of one range are split where
    they stand; longer ones go range by range over all tasks, with the same result."""
    wanted, ranks = profile_rows(profiles), vocabulary(tokenizer)
    schema = _OUT if with_text else _OUT.rpartition(",")[0]
    names = [c.split()[0] for c in schema.split(", ")]
    if not wanted:
        return documents.sparkSession.createDataFrame([], schema)
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoding(ranks)
        for b in batches:
            out, weight = [], 0
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for name, no, *rest in pieces(clean(text), wanted, enc, lengths):
                    out.append((name, doc, no, *rest)[: len(names)])
                    weight += len(rest[-1])
                if weight > 16_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, weight = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    short = spread(docs.filter(F.octet_length("text") <= size)).mapInPandas(run, schema)
    giant = docs.filter(F.octet_length("text") > size).select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("raw")).distinct()
    giant = giant.withColumn("length", F.octet_length("raw").cast("bigint"))
    left, right = _halos(wanted, ranks)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("k")
    ranges = giant.select("key", "raw", "length", k).withColumn("at", F.greatest(F.lit(0), F.col("k") * size - left))
    ranges = ranges.select("key", "k", "length", "at", F.substring("raw", F.col("at").cast("int") + 1, F.lit(left + size + right)).alias("near"))
    rest = _in_ranges(ranges.repartition("key", "k"), wanted, ranks, size)
    return short.unionByName(rest.select("profile", F.col("key").cast("bigint").alias("doc_id"), "piece_no", "start_char", "end_char", "n_tokens", "overlap", "boundary", *(["piece"] if with_text else [])))


# --- giant texts -----------------------------------------------------------------------------


def _halos(profiles: list[tuple[str, int, int]], ranks: bytes) -> tuple[int, int]:
    """Bytes to read before a range, for the overlap, and after it, for the last piece that begins in it."""
    longest = int(encoding(ranks)[1].max())
    return HALO + max(o for _, _, o in profiles) * longest, 2 * HALO + max(m for _, m, _ in profiles) * (longest + 4)


class _View:
    """A range with its halos: bytes from one boundary to another, and where the range's own stretch
    begins (a) and ends (b) in them. Both ends are found by the same rule from the bytes around
    them, so neighbours agree; a range's bound in a word longer than the halo is a hard point."""

    def __init__(self, near: bytes, at: int, k: int, size: int, length: int):
        raw = np.frombuffer(near, np.uint8)
        found, _ = boundaries(raw)
        inner = found[(found >= 4) | (at == 0)]

        def bound(p: int) -> tuple[int, bool]:
            if p <= 0 or p >= length:
                return max(0, min(p, length)), False
            q = p - at
            j = np.searchsorted(inner, q)
            if j < len(inner) and inner[j] < q + HALO:
                return at + int(inner[j]), False
            while q < len(raw) and raw[q] & 0xC0 == 0x80:
                q += 1
            return at + q, True

        (self.a, hard_a), (self.b, hard_b) = bound(k * size), bound((k + 1) * size)
        self.v = 0 if at == 0 else min(self.a, at + int(inner[0])) if len(inner) else self.a
        self.whole = at + len(near) >= length
        w = length if self.whole else at + int(inner[-2]) if len(inner) > 1 else self.b
        self.w = max(w, self.b)
        self.near, self.at = near, at
        self.hard = [p for p, h in ((self.a, hard_a), (self.b, hard_b)) if h]

    def points(self, limit: int, enc, tables: dict, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cut_points of the view, offsets from the text's begin; the hard bounds cut it in parts."""
        edges = [self.v, *[p for p in self.hard if self.v < p < self.w], self.w]
        off, tok, grade = [np.array([self.v])], [np.array([0])], [np.array([4], np.int8)]
        for x, y in zip(edges, edges[1:], strict=False):
            part = self.near[x - self.at : y - self.at]
            if (x, y) not in tables:
                tables[x, y] = token_table(part.decode("utf-8", "replace"), enc, lengths)
            o, t, g = cut_points(part, tables[x, y], limit, enc)
            if y != edges[-1]:
                g[-1] = 0
            elif not self.whole:
                g[-1] = 1
            off.append(o[1:] + x)
            tok.append(t[1:] + tok[-1][-1])
            grade.append(g[1:])
        return np.concatenate(off), np.concatenate(tok), np.concatenate(grade)


_MAP = "profile string, key string, k bigint, upto array<bigint>, exits array<bigint>, counts array<bigint>, tokens bigint, chars bigint"
_PIECE = "profile string, key string, piece_no int, start_char bigint, end_char bigint, start_byte bigint, end_byte bigint, n_tokens int, overlap int, boundary string, piece string"


def _in_ranges(ranges: DataFrame, profiles: list[tuple[str, int, int]], ranks: bytes, size: int, read=None) -> DataFrame:
    """Pieces of texts given by ranges (key, k, length, at, near; read fetches near if it is no column).

    First every range makes its boundary table and from it a map: for each place at which the piece
    before may end, where the first piece that leaves the range ends, and how many there are. The
    maps, a few steps each since pieces soon fall into line, are stitched in order of k; then
    every range knows where its pieces begin and their numbers, and emits them by offset."""

    def views(batch: pd.DataFrame) -> Iterator[tuple]:
        for r in batch.itertuples(index=False):
            near = bytes(r.near) if read is None else read(r.key, int(r.at), int(r.span))
            yield r, _View(near, int(r.at), int(r.k), size, int(r.length)), near

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoding(ranks)
        for batch in batches:
            out = []
            for r, view, near in views(batch):
                tables: dict = {}
                # characters that begin in the range's own bytes
                lo, hi = int(r.k) * size - view.at, min((int(r.k) + 1) * size - view.at, len(near))
                chars = int(((np.frombuffer(near, np.uint8)[lo:hi] & 0xC0) != 0x80).sum())
                for name, limit, overlap in profiles:
                    off, tok, grade = view.points(limit, enc, tables, lengths)
                    a, b = int(np.searchsorted(off, view.a)), int(np.searchsorted(off, view.b))
                    _, end = nexts(tok, grade, limit, overlap)
                    entry = np.arange(a, int(np.searchsorted(tok, tok[a] + limit, "right"))) if int(r.k) else np.array([0])
                    now, count = entry.copy(), np.zeros(len(entry), np.int64)
                    while (open_ := now < b).any():
                        now, count = np.where(open_, end[np.minimum(now, len(end) - 1)], now), count + open_
                    last = np.flatnonzero(np.r_[(now[1:] != now[:-1]) | (count[1:] != count[:-1]), True])
                    out.append((name, r.key, r.k, off[entry[last]].tolist(), off[now[last]].tolist(), count[last].tolist(), int(tok[b] - tok[a]), chars))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _MAP.split(", ")])

    found = cut(ranges.mapInPandas(maps, _MAP))
    total = found.groupBy("profile", "key").agg(F.sum("tokens").alias("total"))
    limits = F.create_map(*[F.lit(x) for n, m, _ in profiles for x in (n, m)])
    found = found.join(total.filter(F.col("total") > limits[F.col("profile")]).drop("total"), ["profile", "key"], "left_semi")

    def stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, e, no, chars = None, 0, 0, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.profile, r.key) != at:
                    at, e, no, chars = (r.profile, r.key), 0, 0, 0
                j = int(np.searchsorted(r.upto, e))
                out.append((r.profile, r.key, r.k, e, no, chars))
                chars += r.chars
                if j < len(r.upto):
                    e, no = int(r.exits[j]), no + int(r.counts[j])
            if out:
                yield pd.DataFrame(out, columns=["profile", "key", "k", "entry", "first_no", "before"])

    order = ["profile", "key", "k"]
    entries = found.repartition("profile", "key").sortWithinPartitions(*order).mapInPandas(stitched, "profile string, key string, k bigint, entry bigint, first_no bigint, before bigint")
    entries = entries.groupBy("key", "k").agg(F.collect_list(F.struct("profile", "entry", "first_no", "before")).alias("entries"))  # one for each profile

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoding(ranks)
        names = [c.split()[0] for c in _PIECE.split(", ")]
        wanted = {n: (m, o) for n, m, o in profiles}
        for batch in batches:
            for r, view, near in views(batch):
                tables: dict = {}
                out = []
                raw = np.frombuffer(near, np.uint8)
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                base = chars[int(r.k) * size - view.at]
                for m in r.entries:
                    limit, overlap = wanted[m["profile"]]
                    off, tok, grade = view.points(limit, enc, tables, lengths)
                    first, b = int(np.searchsorted(off, m["entry"])), int(np.searchsorted(off, view.b))
                    for no, (e, s, f) in enumerate(walk(*nexts(tok, grade, limit, overlap), first, b)):
                        x, y = int(off[s]), int(off[f])
                        i, j = x - view.at, y - view.at
                        shift = m["before"] - base
                        out.append((m["profile"], r.key, m["first_no"] + no, int(chars[i] + shift), int(chars[j] + shift), x, y, int(tok[f] - tok[s]), int(tok[e] - tok[s]), KINDS[grade[f]], near[i:j].decode("utf-8", "replace")))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return ranges.join(entries, ["key", "k"]).mapInPandas(emit, _PIECE)


def _file(path: str):
    """(file system, path in it) of a path or address that every executor can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, tokenizer: str = TOKENIZER, size: int = RANGE) -> DataFrame:
    """(path, piece_no, start_byte, end_byte, n_tokens, boundary, piece) for UTF-8 files on a shared
    folder or store. No task reads a whole file; what is stitched is a short map for each range."""
    ranks = vocabulary(tokenizer)
    profiles = [("file", limit, max(0, min(overlap, limit // 2)))]
    left, right = _halos(profiles, ranks)
    sizes = [(p, _file(p)[0].get_file_info(_file(p)[1]).size) for p in paths]
    files = spark.createDataFrame(sizes, "key string, length bigint").filter("length > 0")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("k")
    at = F.greatest(F.lit(0), F.col("k") * size - left)
    ranges = files.select("key", "length", k).select("key", "k", "length", at.alias("at"), F.lit(left + size + right).alias("span"))

    def read(path: str, at: int, span: int) -> bytes:
        where, name = _file(path)
        with where.open_input_file(name) as f:
            f.seek(at)
            return f.read(span)

    tasks = spark.sparkContext.defaultParallelism
    out = _in_ranges(ranges.repartition(tasks, "key", "k"), profiles, ranks, size, read)
    return out.select(F.col("key").alias("path"), "piece_no", "start_byte", "end_byte", "n_tokens", "boundary", "piece")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), table(spark, d, "split_profiles"))


def p10_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by profile and kind of boundary."""
    p = split_documents(table(spark, d, "documents"), table(spark, d, "split_profiles"), with_text=False)
    return p.groupBy("profile", "boundary").agg(F.count("*").alias("pieces"), F.count_distinct("doc_id").alias("documents"), F.max("n_tokens").alias("most_tokens"))


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces keep their rules, per profile: numbered without gap from 0, covering their text
    from its first to its last character without gap, sharing no more than the overlap allows, each
    the stretch of the text its offsets say and within the limit."""
    p = split_documents(table(spark, d, "documents"), table(spark, d, "split_profiles"))
    w = W.partitionBy("profile", "doc_id").orderBy("piece_no")
    docs = table(spark, d, "documents").select("doc_id", "text").filter("doc_id is not null")
    one = p.join(docs, "doc_id").withColumn("before", F.coalesce(F.lag("end_char").over(w), F.lit(0))).withColumn("place", F.row_number().over(w) - 1)
    last = F.lead("piece_no").over(w).isNull()
    limits = table(spark, d, "split_profiles").select("profile", "max_tokens", "overlap_tokens")
    same = F.substr("text", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int")) == F.col("piece")
    seen = one.withColumn("last", last).join(limits, "profile").groupBy("profile").agg(
        F.bool_and(F.col("place") == F.col("piece_no")).alias("numbered"), F.bool_and((F.col("start_char") <= F.col("before")) & (F.col("end_char") > F.col("before"))).alias("without_gap"),
        F.bool_and(~F.col("last") | (F.col("end_char") == F.length("text"))).alias("to_the_end"), F.bool_and((F.col("overlap") <= F.col("overlap_tokens")) & (F.col("overlap") >= 0)).alias("within_overlap"),
        F.bool_and(F.col("n_tokens") <= F.col("max_tokens")).alias("within_limit"), F.bool_and(same).alias("same_text"),
    )
    yes = ["numbered", "without_gap", "to_the_end", "within_overlap", "within_limit", "same_text"]
    return limits.select("profile").join(seen, "profile", "left").select("profile", *[F.coalesce(c, F.lit(True)).alias(c) for c in yes])


QUERIES = {"p10_pieces": p10_pieces, "p10_summary": p10_summary, "p10_rules": p10_rules}
ORACLES = {
    "p10_rules": "SELECT profile, true AS numbered, true AS without_gap, true AS to_the_end, true AS within_overlap, true AS within_limit, true AS same_text FROM split_profiles",
}

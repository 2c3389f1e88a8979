"""Problem 8: evaluation texts leaking into training text.

Test items form a BM25 inverted index: posting lists by item, cut into blocks, each with the greatest
score in it. Every passage (a window of words) of every document is a query, run by block-max
WAND over whole posting lists, which skips the blocks and items whose bounds cannot reach the threshold;
windows that no group of items can answer by their bounds are not run at all. Scores are scaled per item so that 1
is the least score any run of RUN consecutive words of the item can have; windows advance so
that each run of RUN words lies whole in one, so retrieval from 1 on loses no case. Each retrieved pair is
verified word by word on the item's passage, and for its question and answer it is told how much
of them the document has.

Items are indexed in parts of about PART words, with statistics of all items: a part's index is
broadcast and its size bounded by PART, whatever the number of items; the documents are searched once
for each part.

Defined results: words are runs of letters and digits without case and accents (canonical
decomposition, marks dropped, case folded); null, empty or too short texts give no rows; items
with a null or shorter passage match nothing; texts of any length are read whole; repeated rows count once;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import cut, spread, table

#: Least consecutive words, and words of a passage window.
RUN, WINDOW = 12, 24
K1, B = 1.2, 0.75
#: Postings of a block, words of a part of the items (about), groups of items bounded at once, windows bounded at once.
BLOCK, PART, GROUPS, CHUNK = 4, 200_000, 64, 16_384
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
        return _WORD.findall(unicodedata.normalize("NFC", text).casefold())
    return _WORD.findall(text.lower())


class ItemIndex:
    """BM25 over test items with block maxima and per-item thresholds.

    items are (item_id, lang, passage, question, answer). Inside, they are numbered by language
    and id, so a block holds items of like vocabulary and its maxima bound closely. seen, n and size are
    the statistics of all items: items by term, their number and words."""

    def __init__(self, items: list[tuple], seen: dict[str, int] | None = None, n: int | None = None, size: int | None = None):
        self.items, self.qa, self.ids = [], [], []
        for item, _, passage, question, answer in sorted(items, key=lambda x: (x[1] or "", x[0], repr(x))):
            w = words(passage)
            if len(w) >= RUN:
                self.items.append(w)
                self.qa.append((words(question), words(answer)))
                self.ids.append(item)
        n = len(self.items) if n is None else n
        size = sum(map(len, self.items)) if size is None else size
        seen = Counter(t for w in self.items for t in set(w)) if seen is None else seen
        mean = size / n if n else 1.0
        lists = defaultdict(list)
        self.runs = []
        for i, w in enumerate(self.items):
            count = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {t: math.log(1 + (n - seen[t] + 0.5) / (seen[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in count.items()}
            least = min(sum(score[t] for t in set(w[k : k + RUN])) for k in range(len(w) - RUN + 1))
            for t, s in score.items():
                lists[t].append((i, s / least))
            self.runs.append({tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)})
        self.codes = {t: k for k, t in enumerate(lists, 1)}
        # by term: items, scores, last item and greatest score of each block, greatest score of all
        self.post: list = [None]
        # greatest score of each term in each of at most GROUPS groups of consecutive items
        group = max(BLOCK, -(-len(self.items) // GROUPS))
        self.bound = np.zeros((len(lists) + 1, max(1, -(-len(self.items) // group))), np.float32)
        for t, p in lists.items():
            ids, scores = [i for i, _ in p], [s for _, s in p]
            ends = [ids[min(k + BLOCK, len(ids)) - 1] for k in range(0, len(ids), BLOCK)]
            tops = [max(scores[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
            self.post.append((ids, scores, ends, tops, max(scores)))
            np.maximum.at(self.bound[self.codes[t]], np.array(ids) // group, np.array(scores, np.float32))

    def retrieve(self, terms: list[int]) -> dict[int, float]:
        """All items scoring at least 1 for a query of terms (by code), by block-max WAND."""
        lists = [[*self.post[t], 0] for t in terms]
        found: dict[int, float] = {}
        edge = 1 - 1e-9
        while True:
            lists = [x for x in lists if x[5] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[5]])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[4]
                if total >= edge:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = lists[pivot][0][lists[pivot][5]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][5]] == item:
                pivot += 1
            # the blocks that could hold the pivot item
            near, jump = 0.0, math.inf
            for x in lists[: pivot + 1]:
                b = bisect_left(x[2], item, x[5] // BLOCK)
                if b < len(x[2]):
                    near += x[3][b]
                    jump = min(jump, x[2][b] + 1)
            if near >= edge:
                if lists[0][0][lists[0][5]] == item:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[1][x[5]]
                        x[5] += 1
                    if score >= edge:
                        found[item] = score
                    continue
                to = item
            else:
                if pivot + 1 < len(lists):
                    jump = min(jump, lists[pivot + 1][0][lists[pivot + 1][5]])
                to = max(jump, item + (lists[0][0][lists[0][5]] == item))
            for x in lists[: pivot + 1]:
                x[5] = len(x[0]) if to == math.inf else bisect_left(x[0], to, x[5])

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(text's place, item's number, matched runs, best score) over all windows of the texts, which
        are laid end to end. Windows step so that each run of RUN words lies in one of them."""
        ends = np.cumsum([len(w) for w in texts])
        total = int(ends[-1]) if len(ends) else 0
        step = WINDOW - RUN + 1
        codes = np.zeros(total + WINDOW, np.int32)
        codes[:total] = np.fromiter((c for w in texts for c in map(self.codes.get, w, (0 for _ in w))), np.int32, total)
        starts = np.arange(0, total, step)
        hits: dict[tuple, list] = {}
        for k in range(0, len(starts), CHUNK):
            at = starts[k : k + CHUNK]
            rows = np.sort(codes[at[:, None] + np.arange(WINDOW)], axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0  # a term of the query counts once
            near = np.zeros((len(at), self.bound.shape[1]), np.float32)
            for j in range(WINDOW):
                near += self.bound[rows[:, j]]
            for x in np.flatnonzero(near.max(1) >= 1 - 1e-4).tolist():
                got = self.retrieve([c for c in rows[x].tolist() if c])
                if got:
                    self.verify(texts, ends, int(at[x]), min(int(at[x]) + step, total), got, hits)
        return ((doc, i, n, score) for (doc, i), (n, score) in hits.items())

    def verify(self, texts: list[list[str]], ends: np.ndarray, a: int, b: int, got: dict[int, float], hits: dict) -> None:
        """Adds to hits the runs of the retrieved items that begin at words a to b of the texts."""
        for p in range(a, b):
            doc = int(np.searchsorted(ends, p, side="right"))
            o = p - int(ends[doc]) + len(texts[doc])
            run = tuple(texts[doc][o : o + RUN])
            for i, score in got.items():
                if run in self.runs[i]:
                    h = hits.setdefault((doc, i), [0, 0.0])
                    h[0] += 1
                    h[1] = max(h[1], score)


def _holds(w: list[str], part: list[str]) -> bool:
    return bool(part) and f" {' '.join(part)} " in f" {' '.join(w)} "


def _share(w: list[str], part: list[str]) -> float:
    """Share of the different words of part that w has."""
    return len(set(part) & set(w)) / len(set(part)) if part else 0.0


_OUT = "doc_id bigint, item_id bigint, runs int, score double, has_question boolean, has_answer boolean, question_overlap double, answer_overlap double"
_ITEM = ["item_id", "lang", "passage", "question", "answer"]


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, words) of the usable items: each different term, and with the null term the item's words."""
    for b in batches:
        out = []
        for passage in b["passage"]:
            w = words(passage)
            if len(w) >= RUN:
                out += [(t, 0) for t in set(w)] + [(None, len(w))]
        if out:
            yield pd.DataFrame(out, columns=["term", "words"])


def indexes(items: DataFrame, part: int = PART) -> Iterator[ItemIndex]:
    """The indexes of the parts of the items, one after the other."""
    rows = items.select(*_ITEM).filter("item_id is not null").distinct()
    n, size = rows.mapInPandas(_terms, "term string, words bigint").filter("term is null").agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    parts = -(-size // part)
    if parts == 1:
        yield ItemIndex([tuple(r) for r in rows.collect()])
    elif parts:
        own = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        rows = cut(rows.withColumn("part", own))
        each = [rows.filter(F.col("part") == k).drop("part") for k in range(parts)]
        tagged = [e.mapInPandas(_terms, "term string, words bigint").filter("term is not null").withColumn("part", F.lit(k)) for k, e in enumerate(each)]
        seen = cut(reduce(DataFrame.unionByName, tagged).groupBy("term").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")))
        for k, e in enumerate(each):
            known = {r["term"]: r["n"] for r in seen.filter(F.array_contains("parts", k)).select("term", "n").collect()}
            yield ItemIndex([tuple(r) for r in e.collect()], known, n, size)


def leaks(documents: DataFrame, items: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, item_id, runs, score, has_question, has_answer, question_overlap, answer_overlap) for
    each document with at least RUN consecutive words of an item's passage: how many such runs, the best
    window's score, whether the document has the whole question and answer, and the share of their words."""
    docs = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    found = []
    for ix in indexes(items, part):
        shared = documents.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix = shared.value
            for b in batches:
                out, ids = [], b["doc_id"].tolist()
                texts = [words(t) for t in b["text"]]
                for k, i, n, score in ix.search(texts):
                    q, a = ix.qa[i]
                    out.append((ids[k], ix.ids[i], n, score, _holds(texts[k], q), _holds(texts[k], a), _share(texts[k], q), _share(texts[k], a)))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

        found.append(docs.mapInPandas(run, _OUT))
    if not found:
        return documents.sparkSession.createDataFrame([], _OUT)
    return reduce(DataFrame.unionByName, found).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("runs").alias("runs"), F.bool_or("has_answer").alias("with_answer"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
_W = "list_filter(string_split_regex(replace(strip_accents(lower({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_RUNS = f"""
WITH d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_W.format('passage')} AS w, {_W.format("coalesce(answer, '')")} AS a FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {RUN - 2}), lambda k: array_to_string(w[k:k + {RUN - 1}], ' '))) AS g FROM d WHERE len(w) >= {RUN}),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {RUN - 2}), lambda k: array_to_string(w[k:k + {RUN - 1}], ' '))) AS g FROM i WHERE len(w) >= {RUN}),
hit AS (SELECT doc_id, item_id, count(*) AS runs FROM dg JOIN ig USING (g) GROUP BY 1, 2)
"""
ORACLES = {
    "p8_found": _RUNS + "SELECT doc_id, item_id FROM hit",
    "p8_items": _RUNS + """SELECT h.item_id, count(DISTINCT h.doc_id) AS documents, CAST(sum(runs) AS BIGINT) AS runs,
      bool_or(len(i.a) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.a, ' ') || ' ')) AS with_answer
      FROM hit h JOIN d USING (doc_id) JOIN i USING (item_id) GROUP BY 1""",
}

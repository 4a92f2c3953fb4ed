"""Evaluation texts leaking into training text (problem 8).

The passages of the benchmark are indexed by character q-grams; the index is built once and broadcast, documents never
move. A document's q-grams vote for (item, diagonal band); bands overlap by half. Allowed edits cut a leaked stretch
into pieces that each lie on one diagonal, and the edit budget bounds from below how many words the longest piece has
(RUN_WORDS) and so how many q-grams it shares: bands with fewer are dropped without loss, whatever words were dropped
or added and however long they are. What is left is verified by an alignment of words, banded by the edit budget, that
starts from every piece of that size, so that no stretch over the budget hides one within it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .wikitext import inline

#: Characters of a gram (bytes, in UTF-8): a power of two, as hashes of halves combine.
Q = 8
MIN_WORDS = 25
#: One word in this many may be changed, dropped or added.
EDIT_EVERY = 12
#: Bytes a band of diagonals is wide. Any width keeps every leak; a narrow one keeps fewer regions without one.
BAND = 32
#: An opening sentence of more words is part of the passage.
FRAME_WORDS = 14
#: Largest index that is sent to every executor; a larger benchmark is taken in slices, a pass over the documents each.
MAX_INDEX_BYTES = 64 << 20
#: Bytes of index a byte of passage text takes, and those of its table of cells.
INDEX_FACTOR, CELL_BYTES = 28, 16 << 20
#: Parameter: words by which an opening sentence speaks of the task; without one of them it is part of the passage.
TASK_WORDS = frozenset(
    "answer question questions passage frage fragen antwort beantworte beantworten répondez réponds question texte responde pregunta preguntas respuesta "
    "responda pergunta perguntas resposta rispondi domanda domande risposta beantwoord vraag vragen antwoord ответь ответьте вопрос вопросы".split()
)


def _run_words() -> int:
    """Least number of words of the longest piece that the allowed edits leave of a stretch, over all its lengths."""
    budgets = range(MIN_WORDS // EDIT_EVERY, 4 * EDIT_EVERY)
    return min(-(-(max(MIN_WORDS, e * EDIT_EVERY) - e) // (e + 1)) for e in budgets)


RUN_WORDS = _run_words()
#: A longer stretch within the budget has a half within it, which without edits at its ends still has MIN_WORDS words:
#: stretches of so many words, and so few edits, are all that need to be tried.
MOST_WORDS = 2 * (MIN_WORDS + MIN_WORDS // EDIT_EVERY) - 1
MOST_EDITS = MOST_WORDS // EDIT_EVERY

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\w\x00-\x7f]+")
_ASCII_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())


def _plain(text: str) -> str:
    return (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(_plain(text))


def squeezed(text: str) -> np.ndarray:
    """The words of a text without what lies between them, as the bytes of their UTF-8 form."""
    text = _plain(text)
    if not text.isascii():
        text = _ODD.sub("", text)
    return np.frombuffer(text.encode("utf-8", "replace").translate(None, _ASCII_GAPS), np.uint8)


def lengths(w: list[str]) -> np.ndarray:
    return np.fromiter((len(x) if x.isascii() else len(x.encode("utf-8", "replace")) for x in w), np.int64, len(w))


def passage(text: str | None) -> list[str]:
    """Words of an item's passage: a short opening sentence that speaks of the task and a closing question left out."""
    s = re.split(r"(?<=[.?!:])\s+", (text or "").strip())
    opening = words(s[0])
    if len(s) > 1 and len(opening) <= FRAME_WORDS and not TASK_WORDS.isdisjoint(opening):
        s = s[1:]
    if len(s) > 1 and s[-1].endswith("?"):
        s = s[:-1]
    return words(" ".join(s))


_MIX = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def qgrams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams: grams of twice the length from two of the half."""
    h, n = _MIX.take(codes), 1
    while n < Q:
        h = h[:-n] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[n:] ^ (h[n:] >> np.uint64(31)))
        n *= 2
    return h


def threshold(w: list[str]) -> int:
    """q-grams within the shortest RUN_WORDS words of a passage: what a leaked stretch shares at least on one diagonal."""
    size = np.convolve(lengths(w), np.ones(RUN_WORDS, np.int64), "valid")
    return max(1, int(size.min()) - Q + 1)


class Index:
    """q-grams of passages with their places. items: (item_id, words), each with MIN_WORDS words or more."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.starts = [np.concatenate([[0], np.cumsum(lengths(w))]) for w in self.words]  # byte at which each word starts
        self.least = np.array([threshold(w) for w in self.words] or [0])
        grams, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for k, w in enumerate(self.words):
            g = qgrams(squeezed("".join(w)))
            grams.append(g)
            item.append(np.full(len(g), k, np.int32))
            at.append(np.arange(len(g), dtype=np.int32))
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.item, self.at = np.concatenate(item)[order], np.concatenate(at)[order]
        self.gram, first, count = np.unique(g[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        # a cell per upper bits: most grams of a document are dismissed by one look-up
        self.shift = np.uint64(64 - max(16, min(24, int(len(self.gram) * 16).bit_length())))
        self.cell = np.zeros(1 << (64 - int(self.shift)), bool)
        self.cell[self.gram >> self.shift] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, position in the document, position in the passage) of every common q-gram."""
        if not len(self.gram) or not len(grams):
            e = np.empty(0, np.int64)
            return e, e, e
        pos = np.flatnonzero(self.cell[grams >> self.shift])
        i = np.minimum(np.searchsorted(self.gram, grams[pos]), len(self.gram) - 1)
        same = self.gram[i] == grams[pos]
        pos, i = pos[same], i[same]
        n = self.count[i].astype(np.int64)
        flat = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.item[flat].astype(np.int64), np.repeat(pos, n), self.at[flat].astype(np.int64)

    def leaked(self, text: str | None) -> list[int]:
        """Ids of the items whose passage occurs in the text."""
        if not text or len(text) < MIN_WORDS:
            return []
        text = inline(text)
        item, at, frm = self.hits(qgrams(squeezed(text)))
        # no band of an item holds more than all of its hits
        worth = np.bincount(item, minlength=len(self.ids)) >= self.least
        if not worth.any():
            return []
        keep = worth[item]
        item, at, frm = item[keep], at[keep], frm[keep]
        diagonal = at - frm + (1 << 40)
        # every diagonal lies in two bands
        band = np.concatenate([diagonal // (BAND // 2), diagonal // (BAND // 2) - 1])
        code = np.concatenate([item, item]) * (1 << 44) + band
        values, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
        good = (n >= self.least[values >> 44])[inverse]
        keep = good[: len(item)] | good[len(item) :]
        item, at, frm, diagonal = item[keep], at[keep], frm[keep], diagonal[keep]
        # pieces: grams that follow each other on one diagonal
        order = np.lexsort((at, diagonal, item))
        item, at, frm, diagonal = item[order], at[order], frm[order], diagonal[order]
        new = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(diagonal, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        size = np.diff(new, append=len(item))
        new = new[size >= self.least[item[new]]]
        if not len(new):
            return []
        w = words(text)
        starts = np.concatenate([[0], np.cumsum(lengths(w))])
        found: dict[int, bool] = {}
        for v in new:
            k = int(item[v])
            if not found.get(k):
                # the first word of the passage that starts inside the piece, in the document the word at its place
                i = int(np.searchsorted(self.starts[k], frm[v]))
                j = int(np.searchsorted(starts, at[v] + self.starts[k][i] - frm[v]))
                found[k] = near(self.words[k], i, w, j)
        return [self.ids[k] for k, hit in found.items() if hit]


def slide(p: list[str], i: int, d: list[str], j: int) -> tuple[int, int]:
    """How far p from word i and d from word j agree: words in a row, whatever the spacing within them."""
    n, m = len(p), len(d)
    while i < n and j < m:
        if p[i] == d[j]:
            i, j = i + 1, j + 1
            continue
        # one side may write as one word what the other writes as several
        a, b, x, y = p[i], d[j], i + 1, j + 1
        while len(a) != len(b):
            if len(a) < len(b):
                if x == n or not b.startswith(a):
                    break
                a, x = a + p[x], x + 1
            else:
                if y == m or not a.startswith(b):
                    break
                b, y = b + d[y], y + 1
        if a != b:
            break
        i, j = x, y
    return i, j


def reach(p: list[str], d: list[str], budget: int) -> list[int]:
    """For e = 0 .. budget: the most words from the start of p that agree with the start of d but for e words changed,
    dropped or added, the last one agreeing. Furthest points by diagonal: at most 2 e + 1 each unless spacing differs."""
    i, j = slide(p, 0, d, 0)
    best, front = [i], {i - j: i}
    for _ in range(budget):
        after: dict[int, int] = {}
        for diagonal, i in front.items():
            j = i - diagonal
            for x, y in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
                if x <= len(p) and y <= len(d) and after.get(x - y, -1) < x:
                    after[x - y] = x
        front, most = {}, best[-1]
        for diagonal, i in after.items():
            x, y = slide(p, i, d, i - diagonal)
            if x > i:
                most = max(most, x)
            if front.get(x - y, -1) < x:
                front[x - y] = x
        best.append(most)
    return best


def near(p: list[str], i: int, d: list[str], j: int) -> bool:
    """Whether MIN_WORDS words or more of p in a row, word i at word j of d among them, occur in d with one edit in
    EDIT_EVERY words at most. Edits at the ends don't count as part of the stretch."""
    budget, far = min(len(p) // EDIT_EVERY, MOST_EDITS), 2 * MOST_WORDS + MOST_EDITS
    ahead = reach(p[i : i + MOST_WORDS], d[j : j + far], budget)
    behind = reach([x[::-1] for x in p[max(0, i - MOST_WORDS) : i][::-1]], [x[::-1] for x in d[max(0, j - far) : j][::-1]], budget)
    for e in range(budget + 1):
        size = max(ahead[x] + behind[e - x] for x in range(e + 1))
        if size >= MIN_WORDS and e * EDIT_EVERY <= size:
            return True
    return False


def slices(items: Iterator[tuple[int, str | None]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Passages of MIN_WORDS words or more in lists whose index stays below MAX_INDEX_BYTES (or holds one passage)."""
    part, size = [], CELL_BYTES
    for item_id, text in items:
        w = passage(text)
        if len(w) < MIN_WORDS:
            continue
        n = int(lengths(w).sum()) * INDEX_FACTOR
        if part and size + n > MAX_INDEX_BYTES:
            yield part
            part, size = [], CELL_BYTES
        part.append((item_id, w))
        size += n
    if part:
        yield part


def leaks(documents: DataFrame, doc_id: str, text: str, items: Iterator[tuple[int, str | None]]) -> DataFrame:
    """(doc_id, item_id) of every leaked item. Map-only over documents; items (item_id, text) are the whole benchmark.

    Null and empty texts leak nothing; passages under MIN_WORDS words can't leak. Repeated item texts count each. The
    index of one slice of the items (at most MAX_INDEX_BYTES) is held by the driver and by a worker at a time; each
    further slice is a further pass over the documents.
    """
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id bigint"
    out = None
    for part in slices(iter(items)):
        sent = documents.sparkSession.sparkContext.broadcast(Index(part))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for f in frames:
                rows = [(i, k) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1]) for k in index.leaked(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        one = documents.select(doc_id, text).mapInPandas(run, schema)
        out = one if out is None else out.unionAll(one)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def _items(spark: SparkSession, folder: str) -> Iterator[tuple[int, str | None]]:
    for r in table(spark, folder, "benchmark").select("item_id", "text").toLocalIterator():
        yield r.item_id, r.text


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): documents that hold 25 words of an item's passage in a row, nearly as they stand."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", _items(spark, folder))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, documents): the items that leaked, with the number of documents that hold each."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}

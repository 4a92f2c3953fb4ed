"""Missing or wrong language labels (problem 9).

A bidirectional GRU over bytes is trained on the driver on a bounded sample of labelled documents (SAMPLE_DOCS), then
labels every byte of all running text; byte probabilities are pooled by segment and by document. Scoring is map-only;
within an Arrow batch each distinct segment is labelled once, as revisions repeat most of theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import table
from .gru import PAD, ByteGRU
from .wikitext import inline

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "ru")

#: Writings of the languages' names and codes, lower case, without region.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels английский",
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao tedesco duits немецкий",
    "fr": "fr fra fre french französisch français francais francés frances francês francese frans французский",
    "es": "es spa spanish spanisch espagnol español espanol castellano espanhol spagnolo spaans испанский",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português portoghese portugees португальский",
    "it": "it ita italian italienisch italien italiano italiaans итальянский",
    "nl": "nl nld dut dutch niederländisch néerlandais neerlandés holandés holandês neerlandês olandese nederlands flemish vlaams нидерландский",
    "ru": "ru rus russian russisch russe ruso russo русский",
}
CODE = {name: code for code, names in NAMES.items() for name in names.split()}
#: Labels that say nothing.
UNKNOWN = {"", "und", "unknown", "unk", "none", "null", "n/a", "na", "mul", "mis", "zxx", "other", "?", "-", "xx", "undefined", "undetermined"}

#: Documents in the training sample at most, whatever the size of the corpus.
SAMPLE_DOCS = 4000
#: Training windows at most of each language, their bytes, and the steps taken.
SAMPLE_WINDOWS = 1500
WINDOW = 48
STEPS = 800
BATCH = 128
HIDDEN = 24

#: Words that the sentences of a segment have in all, at least.
MIN_WORDS = 12
#: Bytes scored at a time in one window, and windows scored together.
SPAN = 128
ROWS = 1024
#: A segment this unsure takes the language of its document.
SURE = 0.6


def label_code(label: str | None) -> str | None:
    """The language code of a label; None if it is null or says that it is unknown; other labels come back as they are."""
    s = (label or "").strip().lower()
    if s in UNKNOWN:
        return None
    base = re.split(r"[-_ (,;/.]", s)[0]
    return CODE.get(s) or CODE.get(base) or s


_NOT_PROSE = re.compile(r"^\s*(?:[*#;|!={}]|:*\{\||-{4}|__[A-Z]+__)")
_ASIDE = re.compile(r"\(\s*''[^']*''\s*\)")
_HALF = re.compile(r"\{\{[^{}]*$|^[^{}]*\}\}")


def running_text(segment: str) -> str:
    """The sentences of one segment; '' if they have fewer than MIN_WORDS words.

    Headings, lists, tables, redirects and template lines are dropped, markup inside sentences is undone, foreign
    words set in italics between brackets are left out.
    """
    if len(segment) < 2 * MIN_WORDS - 1:
        return ""
    text = inline(_ASIDE.sub("", segment) if "(" in segment else segment)
    if "{{" in text or "}}" in text:
        text = _HALF.sub("", text)
    lines = [s.lstrip(" :\t") for s in text.split("\n") if s and not _NOT_PROSE.match(s)]
    text = " ".join(lines).strip()
    if len(text) < 2 * MIN_WORDS - 1:
        return ""
    # letters at random have no blanks; marks standing alone are no words
    parts = text.split()
    return " ".join(parts) if len(parts) >= MIN_WORDS and sum(any(map(str.isalnum, w)) for w in parts) >= MIN_WORDS else ""


def segments(text: str | None) -> list[tuple[int, str]]:
    """(number, running text) of the segments of a document that have running text."""
    if not text:
        return []
    if "<!--" in text:  # a comment can hold an empty line
        text = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: "\n\n" * m.group().count("\n\n"), text, flags=re.S)
    return [(k, r) for k, s in enumerate(text.split("\n\n")) if (r := running_text(s))]


def to_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """(n, size) uint8: the bytes in consecutive windows, the last one padded."""
    n = -(-len(data) // size)
    out = np.full(n * size, PAD, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


def train(docs: list[tuple[str | None, str | None]], seed: int = 7) -> ByteGRU:
    """A network from (label, text) pairs; documents without a usable label are passed over. Labels may be wrong for
    some: after half of the steps, windows that the network contradicts are left out."""
    rng = np.random.default_rng(seed)
    by_lang: dict[int, list[np.ndarray]] = {k: [] for k in range(len(LANGS))}
    for label, text in docs:
        code = label_code(label)
        if code in LANGS:
            for _, s in segments(text):
                by_lang[LANGS.index(code)].append(windows(to_bytes(s), WINDOW))
    xs, ys = [], []
    for k, parts in by_lang.items():
        if parts:
            x = np.concatenate(parts)
            x = x[rng.permutation(len(x))[:SAMPLE_WINDOWS]]
            xs.append(x)
            ys.append(np.full(len(x), k))
    model = ByteGRU(len(LANGS), HIDDEN, seed)
    if not xs:
        return model
    x, y = np.concatenate(xs), np.concatenate(ys)
    weight = 1.0 / np.bincount(y, minlength=len(LANGS))[y]
    for step in range(STEPS):
        if step == STEPS // 2:
            p = np.concatenate([model.pooled(x[i : i + ROWS]) for i in range(0, len(x), ROWS)])
            p /= np.maximum(p.sum(axis=1, keepdims=True), 1)
            keep = p[np.arange(len(x)), y] >= 0.2
            if keep.mean() > 0.5:
                x, y, weight = x[keep], y[keep], weight[keep]
        pick = rng.choice(len(x), BATCH, p=weight / weight.sum())
        model.step(x[pick], y[pick], 0.02 * (1 - 0.9 * step / STEPS))
    return model


def score(model: ByteGRU, texts: list[str]) -> np.ndarray:
    """(len(texts), labels): byte probabilities summed over each text. Every byte is labelled."""
    parts = [windows(to_bytes(t), SPAN) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    out = np.zeros((len(texts), model.labels), np.float64)
    if not len(owner):
        return out
    x = np.concatenate(parts)
    # short windows together, so that few padded positions are walked
    length = (x != PAD).sum(axis=1)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), ROWS):
        rows = order[i : i + ROWS]
        width = max(int(length[rows[-1]]), 1)
        np.add.at(out, owner[rows], model.pooled(x[rows, :width]))
    return out


def decide(sums: list[np.ndarray]) -> tuple[list[tuple[int, float]], tuple[int, float] | None]:
    """((language, confidence) of each segment, of the whole document if it is in one language, else None)."""
    total = np.sum(sums, axis=0)
    whole = int(total.argmax())
    each = []
    for s in sums:
        share = s / max(s.sum(), 1e-9)
        k = int(share.argmax())
        if share[k] < SURE:
            k = whole
        each.append((k, float(share[k])))
    if len({k for k, _ in each}) == 1:
        return each, (each[0][0], float(total[each[0][0]] / max(total.sum(), 1e-9)))
    return each, None


OUT = "doc_id bigint, seg int, label string, lang string, confidence double"


def identify(documents: DataFrame, model: ByteGRU) -> DataFrame:
    """(doc_id, seg, label, lang, confidence) from documents(doc_id, text, label).

    Documents in one language: one row, seg = -1. In several: a row per segment of running text. Documents without
    running text (null, empty, redirects, lists) give no row. Map-only.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model.state())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = ByteGRU.of(sent.value)
        for f in frames:
            pieces = [segments(t) for t in f["text"]]
            place: dict[str, int] = {}
            for doc in pieces:
                for _, s in doc:
                    place.setdefault(s, len(place))
            sums = score(net, list(place))
            rows = []
            for doc_id, label, doc in zip(f["doc_id"], f["label"], pieces):
                if not doc:
                    continue
                each, whole = decide([sums[place[s]] for _, s in doc])
                if whole is not None:
                    rows.append((doc_id, -1, label, LANGS[whole[0]], whole[1]))
                else:
                    rows += [(doc_id, k, label, LANGS[g], c) for (k, _), (g, c) in zip(doc, each)]
            yield pd.DataFrame(rows, columns=["doc_id", "seg", "label", "lang", "confidence"])

    return documents.select("doc_id", "text", "label").mapInPandas(run, OUT)


def label_codes(label: Column) -> Column:
    """label_code() of labels in known writings; null for others and for those that tell nothing."""
    known = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    s = F.lower(strip(label))
    return F.coalesce(F.try_element_at(known, s), F.try_element_at(known, F.element_at(F.split(s, r"[-_ (,;/.]"), 1)))


def sample(documents: DataFrame) -> list[tuple[str | None, str | None]]:
    """About SAMPLE_DOCS (label, text) pairs with a label in use, as many of each language as there are, chosen by the
    hash of the id: the same at every layout of the table."""
    usable = documents.withColumn("code", label_codes(F.col("label"))).filter("code is not null")
    # counts of labels alone, so that no text is read for them
    rows = {r.code: r["count"] for r in usable.groupBy("code").count().toLocalIterator()}  # a row a language
    each = SAMPLE_DOCS / len(LANGS)
    limit = F.coalesce(*[F.when(F.col("code") == c, int(min(1.0, each / n) * (1 << 30))) for c, n in rows.items()], F.lit(0))
    chosen = usable.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit) & (F.length("text") > 0))
    # the hash share is about SAMPLE_DOCS; the bound holds for any distribution of ids
    return [(r.label, r.text) for r in chosen.select("label", "text").limit(2 * SAMPLE_DOCS).toLocalIterator()]


def fitted(documents: DataFrame) -> ByteGRU:
    return train(sample(documents))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seg, label, lang, confidence) of every document with running text."""
    docs = _documents(spark, folder)
    return identify(docs, fitted(docs))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seg, lang): documents whose label is missing or wrong, and segments of mixed documents."""
    docs = _documents(spark, folder)
    rows = identify(docs, fitted(docs))
    code = label_codes(F.col("label"))
    return rows.filter((F.col("seg") >= 0) | code.isNull() | (code != F.col("lang"))).select("doc_id", "seg", "lang")


QUERIES = {"p9_found": p9_found, "p9_languages": p9_languages}
SQL: dict[str, str] = {}

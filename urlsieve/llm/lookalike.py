"""Visually identical text with different characters (problem 2).

Distinct non-ASCII values are exploded to positioned code points, joined to one broadcast mapping (decomposition,
look-alikes, invisible characters), combining marks are put in order of their class, and the text is rebuilt and
recomposed. ASCII values are their own form: none of their characters looks like another.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fingerprint
from ..operators.skew import HOT_ROWS, salted_join
from ..runtime import cut, table

#: Characters drawn like an ASCII character, by the character they look like.
LOOKALIKES = {
    "a": "аɑα",
    "c": "сϲ",
    "d": "ԁ",
    "e": "е",
    "g": "ɡց",
    "h": "һհ",
    "i": "іı",
    "j": "јϳ",
    "l": "ӏ",
    "n": "ոռ",
    "o": "оοօסଠ",
    "p": "рρ",
    "q": "ԛգ",
    "s": "ѕ",
    "u": "սυ",
    "v": "νѵ",
    "w": "ԝ",
    "x": "хχ",
    "y": "уγ",
    "A": "АΑ",
    "B": "ВΒ",
    "C": "СϹ",
    "E": "ЕΕ",
    "F": "Ϝ",
    "G": "Ԍ",
    "H": "НΗ",
    "I": "ІΙӀ",
    "J": "ЈͿ",
    "K": "КΚ",
    "M": "МΜϺ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡ",
    "Q": "Ԛ",
    "S": "ЅՏ",
    "T": "ТΤ",
    "U": "Ս",
    "V": "Ѵ",
    "W": "Ԝ",
    "X": "ХΧ",
    "Y": "ҮΥ",
    "Z": "Ζ",
    "-": "‐‑‒–−﹘",
    ".": "․",
    ":": "∶꞉",
    "/": "∕⁄",
    "'": "’ʼ",
    "!": "ǃ",
    ";": ";",
}
_LOOKS = {ch: plain for plain, chars in LOOKALIKES.items() for ch in chars}

#: Spellings of one form from which its pairs are split over tasks.
MANY_SPELLINGS = 2_000

#: Format characters that are drawn (signs around Arabic, Syriac and Kaithi numbers).
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def _invisible(cp: int, ch: str) -> bool:
    """Characters without a shape of their own: format characters, joiners, fillers, variation selectors."""
    if unicodedata.category(ch) == "Cf":
        return cp not in _DRAWN
    return cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


#: Tags of compatibility decompositions that keep a character's look, but for its width or style.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>"}
#: Characters with such a decomposition that look otherwise: the long s, letterlike signs, enclosed ones.
_OWN_LOOK = (0x17F, *range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0x3200, 0x3400), *range(0x1F100, 0x1F200))


def apart(ch: str) -> str:
    """A character decomposed as far as its parts look like the whole: accents and styles, but not raised digits, signs
    in circles or fractions."""
    to = unicodedata.decomposition(ch).split()
    if not to:
        return ch
    if to[0][0] == "<":
        tag, *to = to
        # an accent standing alone is no blank with an accent
        if tag not in _SAME_LOOK or ord(ch) in _OWN_LOOK or (to[0] == "0020" and len(to) > 1):
            return ch
    return "".join(apart(chr(int(c, 16))) for c in to)


def shown(ch: str) -> str:
    """What one character is drawn as, decomposed: '' if it isn't drawn. ASCII is drawn as itself."""
    if ch < "\x80":
        return ch
    if ch in _LOOKS:
        return _LOOKS[ch]
    if _invisible(ord(ch), ch):
        return ""
    parts = apart(ch)
    return parts if parts == ch else "".join(_LOOKS.get(p, "" if _invisible(ord(p), p) else p) for p in parts)


@cache
def shown_otherwise() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, what it is drawn as with the class of each part) for all that change or combine: under 8,000."""
    rows = []
    for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Co"):
            continue
        to = shown(ch)
        if to != ch or unicodedata.combining(ch):
            rows.append((ch, [(p, unicodedata.combining(p)) for p in to]))
    return rows


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, parts array<struct<ch, ccc>>): shown_otherwise() as a table, fixed by Unicode."""
    return spark.createDataFrame(shown_otherwise(), "ch string, parts array<struct<ch: string, ccc: int>>")


@cache
def _pairs() -> dict[str, str]:
    """Two characters and the one they compose to, as Unicode has them (without its exclusions)."""
    made = {}
    for cp in (*range(0xC0, 0x3100), *range(0x11000, 0x12000), *range(0x16100, 0x16200)):
        to = unicodedata.decomposition(chr(cp)).split()
        if len(to) == 2 and to[0][0] != "<" and unicodedata.is_normalized("NFC", chr(cp)):
            made["".join(chr(int(c, 16)) for c in to)] = chr(cp)
    return made


#: Where Hangul syllables and their parts begin, and how many parts of each place there are.
_S, _L, _V, _T, _NL, _NV, _NT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _composed(a: str, b: str) -> str | None:
    x, y = ord(a) - _L, ord(b) - _V
    if 0 <= x < _NL and 0 <= y < _NV:
        return chr(_S + (x * _NV + y) * _NT)
    x, y = ord(a) - _S, ord(b) - _T
    if 0 <= x < _NL * _NV * _NT and x % _NT == 0 and 0 < y < _NT:
        return chr(ord(a) + y)
    return _pairs().get(a + b)


def recompose(text: str) -> str:
    """Marks, already in order of class behind their starter, joined to it as far as Unicode has a character for both."""
    out: list[str] = []
    starter, last = -1, -1  # where the starter is, class of the last mark kept behind it
    for ch in text:
        kind = unicodedata.combining(ch)
        if starter >= 0 and last < kind and (made := _composed(out[starter], ch)):
            out[starter] = made
            continue
        if kind:
            last = kind
        else:
            starter, last = len(out), -1
        out.append(ch)
    return "".join(out)


def _recompose(texts: pd.Series) -> pd.Series:
    return texts.map(recompose, na_action="ignore")


def forms(values: DataFrame) -> DataFrame:
    """values(value string), distinct and not null: (value, form). Values of nothing but invisible characters get ''.

    One shuffle by value: the window that numbers starters and the aggregation that rebuilds share its partitioning.
    """
    ascii_only = F.col("value").rlike(r"^[\x00-\x7f]*$")
    plain = values.filter(ascii_only).select("value", F.col("value").alias("form"))
    other = values.filter(~ascii_only)
    points = other.select("value", F.posexplode(F.split("value", "")).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping(values.sparkSession)), "ch", "left")
    kept = F.coalesce("parts", F.array(F.struct("ch", F.lit(0).alias("ccc"))))
    # an invisible character leaves a row without text, so that its value stays
    parts = mapped.select("value", "pos", F.posexplode_outer(kept).alias("sub", "part")).select("value", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("part.ch", F.lit("")).alias("c"), "part.ccc")
    order = Window.partitionBy("value").orderBy("pos", "sub")
    # marks sort by class behind their starter; what isn't drawn neither starts nor separates
    starter = F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order)
    placed = parts.select("value", F.struct(starter.alias("seg"), F.coalesce("ccc", F.lit(0)).alias("ccc"), "pos", "sub", "c").alias("p"))
    rebuilt = placed.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]), "").alias("d"))
    return plain.unionAll(rebuilt.select("value", F.pandas_udf(_recompose, "string")("d").alias("form")))


def consistent(df: DataFrame, column: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `out`: the consistent form of df[column]; null stays null. Each distinct non-ASCII value is worked once.

    ASCII values are their own form and take no part in a join; the others meet their form by a hash of 128 bits, with
    the rows of frequent ones split.
    """
    plain = F.coalesce(F.col(column).rlike(r"^[\x00-\x7f]*$"), F.lit(True))
    a, b = fingerprint(column)
    other = df.filter(~plain).withColumns({"__a": a, "__b": b})
    counted = other.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"), F.any_value(column).alias("value"))
    fa, fb = fingerprint("value")
    made = forms(counted.select("value")).select(fa.alias("__a"), fb.alias("__b"), F.col("form").alias(out))
    joined = salted_join(other, counted.drop("value").join(made, ["__a", "__b"]), ["__a", "__b"], "__n", hot_rows).drop("__a", "__b")
    return df.filter(plain).withColumn(out, F.col(column)).unionByName(joined.select(*df.columns, out))


def same_looking_pairs(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows(field, id, value): (field, id_a, id_b) of rows whose values differ but have one form, each pair once.

    Null values make no pair. Rows are matched by distinct value, so equal rows are never compared with each other.
    """
    keys, every = _spellings(rows)
    left = every.select("field", "fa", "fb", F.struct("n", "a", "b").alias("x"))
    right = every.select("field", "fa", "fb", F.struct("n", "a", "b").alias("y"))
    many = every.groupBy("field", "fa", "fb").agg(F.count(F.lit(1)).alias("s")).filter("s > 1")
    # a spelling meets all others of its form: forms with very many are split
    pairs = salted_join(left, right.join(many, ["field", "fa", "fb"]), ["field", "fa", "fb"], "s", min(hot_rows, MANY_SPELLINGS))
    pairs = pairs.filter("x < y").select("field", "x", "y")  # x has fewer rows
    ids = keys.select("field", "a", "b", "id")
    small = salted_join(ids, pairs.select("field", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.n").alias("n"), "y"), ["field", "a", "b"], "n", hot_rows)
    half = small.select("field", F.col("y.a").alias("a"), F.col("y.b").alias("b"), F.col("y.n").alias("n"), F.col("id").alias("other"))
    both = salted_join(ids, half, ["field", "a", "b"], "n", hot_rows)
    return both.select("field", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


def _spellings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, id, a, b, value) of the rows, value only where it isn't ASCII, and (field, a, b, n, fa, fb), one row a
    spelling that has company: n rows, its hash (a, b), the hash (fa, fb) of its form. Both are written once."""
    known = rows.filter("value is not null")
    plain = F.col("value").rlike(r"^[\x00-\x7f]*$")
    a, b = fingerprint("value")
    keys = cut(known.select("field", "id", a.alias("a"), b.alias("b"), F.when(~plain, F.col("value")).alias("value")))
    other = keys.filter("value is not null").groupBy("field", "value", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    fa, fb = fingerprint("form")
    formed = other.join(forms(other.select("value").distinct()), "value").select("field", "a", "b", "n", fa.alias("fa"), fb.alias("fb"))
    formed = cut(formed)
    # an ASCII value is its own form
    wanted = formed.select("field", F.col("fa").alias("a"), F.col("fb").alias("b")).distinct()
    ascii_values = keys.filter("value is null").groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["field", "a", "b"], "left_semi")
    return keys, cut(formed.unionAll(ascii_values.select("field", "a", "b", "n", F.col("a").alias("fa"), F.col("b").alias("fb"))))


def same_looking_classes(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows(field, id, value): (field, id, class_id, spellings) of every row that some row of another spelling looks
    like; class_id is the smallest id of the class. One row a row, however many pairs there are."""
    keys, every = _spellings(rows)
    many = every.groupBy("field", "fa", "fb").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    shown_by = every.join(many, ["field", "fa", "fb"])
    first = salted_join(keys.select("field", "a", "b", "id"), shown_by, ["field", "a", "b"], "n", hot_rows)
    first = cut(first)
    least = first.groupBy("field", "fa", "fb").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return salted_join(first, least, ["field", "fa", "fb"], "n", hot_rows).select("field", "id", "class_id", "spellings")


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    results, hosts = table(spark, folder, "results"), table(spark, folder, "hostinfo")
    pick = F.explode(F.array(F.struct(F.lit("results.url").alias("field"), F.col("url").alias("value")), F.struct(F.lit("results.hostname_unicode").alias("field"), F.col("hostname_unicode").alias("value"))))
    r = results.select(F.col("result_id").alias("id"), pick.alias("s")).select("s.field", "id", "s.value")
    return r.unionAll(hosts.select(F.lit("hostinfo.host_uni").alias("field"), F.col("host_id").alias("id"), F.col("host_uni").alias("value")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field, id_a, id_b): rows whose values in the field differ but look the same."""
    return same_looking_pairs(_fields(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(field, id, class_id, spellings): the classes of same-looking values that p2_found gives the pairs of."""
    return same_looking_classes(_fields(spark, folder))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(field, id, form): the values of the three fields in their consistent form."""
    return consistent(_fields(spark, folder), "value", "form").select("field", "id", "form")


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_forms": p2_forms}


def _forms_sql() -> str:
    """CTE formed(field, id, value, form). The mapping is the same table; ordering and composition are DuckDB's."""
    rows = ", ".join(f"('{ch}', '{''.join(p for p, _ in parts).replace(chr(39), chr(39) * 2)}', {[c for _, c in parts]}::INTEGER[])" for ch, parts in shown_otherwise())
    return f"""
        fields AS (SELECT 'results.url' AS field, result_id AS id, url AS value FROM results UNION ALL SELECT 'results.hostname_unicode', result_id, hostname_unicode FROM results
                   UNION ALL SELECT 'hostinfo.host_uni', host_id, host_uni FROM hostinfo),
        m(ch, shown, ccc) AS (VALUES {rows}),
        v AS (SELECT DISTINCT value FROM fields WHERE regexp_matches(value, '[^\x00-\x7f]')),
        c AS (SELECT value, unnest(string_split(value, '')) AS ch, generate_subscripts(string_split(value, ''), 1) AS pos FROM v),
        d AS (SELECT value, pos, coalesce(shown, ch) AS shown, coalesce(ccc, [0]) AS ccc FROM c LEFT JOIN m USING (ch)),
        e AS (SELECT value, pos, unnest(string_split(shown, '')) AS part, unnest(ccc) AS ccc, unnest(range(1, len(ccc) + 1)) AS sub FROM d WHERE shown <> ''),
        s AS (SELECT *, sum((ccc = 0)::INTEGER) OVER (PARTITION BY value ORDER BY pos, sub) AS seg FROM e),
        r AS (SELECT value, nfc_normalize(string_agg(part, '' ORDER BY seg, ccc, pos, sub)) AS form FROM s GROUP BY value),
        formed AS (SELECT field, id, f.value, CASE WHEN v.value IS NULL THEN f.value ELSE coalesce(form, '') END AS form FROM fields f LEFT JOIN v ON v.value = f.value LEFT JOIN r ON r.value = f.value)"""


SQL = {
    "p2_forms": f"WITH {_forms_sql()} SELECT field, id, form FROM formed",
    "p2_found": f"WITH {_forms_sql()} SELECT a.field, a.id AS id_a, b.id AS id_b FROM formed a JOIN formed b ON a.field = b.field AND a.form = b.form AND a.value <> b.value AND a.id < b.id",
    "p2_classes": f"""WITH {_forms_sql()}, k AS (SELECT field, form, min(id) AS class_id, count(DISTINCT value) AS spellings FROM formed WHERE value IS NOT NULL GROUP BY field, form HAVING count(DISTINCT value) > 1)
        SELECT field, id, class_id, spellings FROM formed JOIN k USING (field, form)""",
}

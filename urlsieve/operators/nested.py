"""Nested records to related flat tables (core, problem 3).

record_triples() stream-parses JSON text into (path, ordinals, value) rows: one token after another, an explicit stack,
no object tree, so neither depth nor size of a record is limited by the interpreter's recursion.
elements() groups a record's triples by repeated ancestor and pivots each group into one row an element. A record lies
in one row, so both happen where it is read: no shuffle, whatever its shape. flatten() makes a table of each group.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One JSON token after white space: punctuation, plain string, number, literal, or the quote that opens another string.
TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9.eE+-])|(true|false|null)(?![A-Za-z0-9_])|(")|$)')
_PUNCT, _PLAIN, _NUMBER, _LITERAL, _QUOTE = range(1, 6)

#: Rows that a task holds before it hands them on.
BATCH = 50_000


class BadJson(ValueError):
    pass


def events(text: str) -> Iterator[tuple[str, str | None]]:
    """Tokens of one JSON text, checked against the grammar: '{', '}', '[', ']', ('k', name), ('s'|'n'|'l', value)."""
    stack: list[str] = []
    want = "value"  # value, key, key|}, value|], colon, comma, end
    pos, n, match = 0, len(text), TOKEN.match
    while True:
        m = match(text, pos)
        if m is None:
            raise BadJson("no token")
        pos, kind = m.end(), m.lastindex
        if kind is None:
            if want != "end" or pos < n:
                raise BadJson("cut off")
            return
        if want == "end":
            raise BadJson("text after the record")
        token = m.group(kind)
        if kind == _PLAIN or kind == _QUOTE:
            if kind == _QUOTE:
                try:
                    token, pos = scanstring(text, pos, True)
                except ValueError as e:
                    raise BadJson(str(e)) from None
            if want == "key" or want == "key|}":
                yield "k", token
                want = "colon"
                continue
            if want != "value" and want != "value|]":
                raise BadJson("string out of place")
            yield "s", token
        elif kind == _PUNCT:
            if token == ":":
                if want != "colon":
                    raise BadJson("colon out of place")
                want = "value"
                continue
            if token == ",":
                if want != "comma":
                    raise BadJson("comma out of place")
                want = "key" if stack[-1] == "{" else "value"
                continue
            if token in "{[":
                if want != "value" and want != "value|]":
                    raise BadJson("bracket out of place")
                stack.append(token)
                yield token, None
                want = "key|}" if token == "{" else "value|]"
                continue
            opened = "{" if token == "}" else "["
            if not stack or stack[-1] != opened or want not in ("comma", "key|}" if token == "}" else "value|]"):
                raise BadJson("bracket out of place")
            stack.pop()
            yield token, None
        else:
            if want != "value" and want != "value|]":
                raise BadJson("value out of place")
            yield ("n" if kind == _NUMBER else "l"), token
        want = "comma" if stack else "end"


@lru_cache(1 << 14)
def snake(name: str) -> str:
    """One writing for a field's name: resolvedIps, Resolved-IPs and resolved_ips agree."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z](?:[a-rt-z]|s[a-z]))", "_", name.strip())
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", "_", name.lower()).strip("_")


Triple = tuple[str, tuple[int, ...], str, str | None]


def record_triples(text: str, repeated: frozenset[str] = frozenset()) -> list[Triple]:
    """(path, ordinals, kind, value) of every node: kinds '{' and '[' for containers, s, n, l for leaves.

    A path joins snake-cased names by '.', '[]' marks a list level; ordinals hold the position at each '[]'. A string
    that itself is a JSON list or object is read as such at any depth (each level of quoting doubles the marks of the
    one inside, so the depth is at most the logarithm of the size), else it stays a string. What stands, not null and
    no list, under a name in `repeated` is taken as a list of one. Raises BadJson if the text isn't JSON.
    """
    out: list[Triple] = []
    frames: list[list] = []  # of each open container its path, its ordinals, whether it is a list, its next position
    key = ""
    for kind, value in events(text):
        if kind == "k":
            key = snake(value)
            continue
        if kind == "}" or kind == "]":
            frames.pop()
            continue
        lone = False
        if not frames:
            path, ords = "", ()
        else:
            path, ords, listed, at = frame = frames[-1]
            if listed:
                path, ords = path + "[]", (*ords, at)
                frame[3] = at + 1
            else:
                path, lone = (f"{path}.{key}" if path else key), key in repeated
        null = kind == "l" and value == "null"
        if kind == "s" and value and (head := value.lstrip()[:1]) and head in "[{":
            try:
                inner = record_triples(value, repeated)
            except BadJson:
                inner = None
            if inner is not None:
                if lone and head == "{":
                    path, ords = path + "[]", (*ords, 0)
                out += [(path + ("." + p if p and path and not p.startswith("[]") else p), ords + o, k, v) for p, o, k, v in inner]
                continue
        if lone and kind != "[" and not null:
            path, ords = path + "[]", (*ords, 0)
        if kind == "{" or kind == "[":
            frames.append([path, ords, kind == "[", 0])
        out.append((path, ords, kind, None if null else value))
    return out


@lru_cache(1 << 14)
def _split(path: str) -> tuple[str, str]:
    """The repeated ancestor of a path (up to its last '[]') and the rest."""
    at = path.rfind("[]") + 2
    return (path[:at], path[at:].lstrip(".")) if at > 1 else ("", path)


Element = tuple[str, tuple[int, ...], str | None, str | None, dict[str, str | None]]


def record_elements(nodes: Iterable[Triple]) -> list[Element]:
    """Triples of one record grouped by repeated ancestor and pivoted: (ancestor, ordinals, kind, value, fields) of every
    element; ancestor '' is the record itself. The last of repeated names wins."""
    made: dict[tuple, list] = {}
    for path, ords, kind, value in nodes:
        ancestor, leaf = _split(path)
        e = made.get((ancestor, ords))
        if e is None:
            e = made[ancestor, ords] = [ancestor, ords, None, None, {}]
        if not leaf:
            e[2], e[3] = kind, value
        elif kind not in "{[":
            e[4][leaf] = value
    return [tuple(e) for e in made.values()]


def _mapped(df: DataFrame, id_col: str, json_col: str, columns: str, rows_of) -> DataFrame:
    """Rows made of each valid record, id in front. columns: their schema; rows_of: text -> rows."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}
        fields = [c.split(" ") for c in columns.split(", ")]

        def pack(ids: list, rows: list, id_arrow: pa.DataType) -> pa.RecordBatch:
            cols = [pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), *cols], names=[id_col, *[n for n, _ in fields]])

        for batch in batches:
            ids, rows, id_arrow = [], [], batch.schema.field(0).type
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    made = rows_of(text)
                except BadJson:
                    continue
                ids += [rid] * len(made)
                rows += made
                if len(ids) >= BATCH:
                    yield pack(ids, rows, id_arrow)
                    ids, rows = [], []
            if ids:
                yield pack(ids, rows, id_arrow)

    return df.select(id_col, json_col).mapInArrow(run, f"`{id_col}` {id_type}, {columns}")


def triples(df: DataFrame, id_col: str, json_col: str, repeated: Iterable[str] = ()) -> DataFrame:
    """(id, path, ords, kind, value): one row per node of each record.

    Null, empty and invalid texts give no rows. Repeated names in one object give one row each. Map-only.
    """
    names = frozenset(repeated)
    return _mapped(df, id_col, json_col, "path string, ords array<int>, kind string, value string", lambda text: record_triples(text, names))


def elements(df: DataFrame, id_col: str, json_col: str, repeated: Iterable[str] = (), ancestors: str = ".*") -> DataFrame:
    """(id, ancestor, ords, kind, value, fields): one row per element of a repeated ancestor, for all ancestors that the
    regular expression matches as a whole.

    ords is the element's key; all but its last entry are its parent's, whose ancestor is the path up to the last '[]'
    but one. kind and value are the element's own, fields hold its leaves by name. Null, empty and invalid texts give
    no rows; equal ids stay apart in their rows. Map-only.
    """
    names = frozenset(repeated)
    pattern = re.compile(ancestors)

    def rows_of(text: str) -> list[tuple]:
        return [(a, o, k, v, list(f.items())) for a, o, k, v, f in record_elements(record_triples(text, names)) if pattern.fullmatch(a)]

    return _mapped(df, id_col, json_col, "ancestor string, ords array<int>, kind string, value string, fields map<string,string>", rows_of)


def flatten(df: DataFrame, id_col: str, json_col: str, tables: Mapping[str, Sequence[str]], repeated: Iterable[str] = ()) -> dict[str, DataFrame]:
    """Related tables. tables: an expression for the ancestors of a table (as a whole) and the leaves it shows.

    Each has id, ancestor, ords, parent_ords, pos, kind, value, the named leaves and the other leaves in the map `rest`,
    so nothing is lost. A leaf named like one of those columns gets the prefix 'f_'.
    """
    taken = {id_col, "ancestor", "ords", "pos", "parent_ords", "kind", "value", "rest"}
    made = {}
    for ancestor, names in tables.items():
        rows = elements(df, id_col, json_col, repeated, ancestor)
        made[ancestor] = rows.select(
            id_col,
            "ancestor",
            "ords",
            F.slice("ords", 1, F.greatest(F.size("ords") - 1, F.lit(0))).alias("parent_ords"),
            F.coalesce(F.try_element_at("ords", F.lit(-1)), F.lit(0)).alias("pos"),
            "kind",
            "value",
            *[F.col("fields")[n].alias(f"f_{n}" if n in taken else n) for n in names],
            F.map_filter("fields", lambda k, _: ~k.isin(*names)).alias("rest"),
        )
    return made

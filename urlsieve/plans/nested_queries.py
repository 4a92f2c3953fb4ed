"""Queries of problem 3: the lists inside result_raw.payload as one table of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import elements, flatten
from ..runtime import table

#: Names that hold lists, whatever stands there.
REPEATED = ("results", "indicators", "redirect_chain", "resolved_ips")
#: Where the results of a payload can be: a list, an envelope, an envelope in an envelope, or the payload itself.
#: Any chain of names ends in 'results'.
RESULT = r"(?:\[\]\.|(?:[^.\[\]]+\.)*results\[\]\.|)"
#: The tables: the elements of the three lists of a result and of the addresses of its hops.
LISTS = RESULT + r"(?:indicators\[\]|(?:redirect_chain\[\]\.)?resolved_ips\[\]|redirect_chain\[\])"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, result_pos, child, parent_pos, pos, item), one row per non-null element."""
    t = flatten(table(spark, folder, "result_raw"), "record_id", "payload", {LISTS: ["category", "url"]}, REPEATED)[LISTS]
    child = F.regexp_extract("ancestor", r"([a-z_]+)\[\]$", 1)
    at_hop = F.col("ancestor").endswith("redirect_chain[].resolved_ips[]")
    # of the ordinals the last ones belong to the hop and the element, one before them to the result if it is listed
    above = F.size("ords") - F.when(at_hop, 2).otherwise(1)
    s = t.select(
        "record_id",
        F.when(above > 0, F.get("ords", above - 1)).otherwise(0).alias("result_pos"),
        child.alias("child"),
        F.when(at_hop, F.element_at("parent_ords", -1)).otherwise(-1).alias("parent_pos"),
        "pos",
        F.coalesce("value", F.when(child == "indicators", F.col("category")).when(child == "redirect_chain", F.col("url"))).alias("item"),
    )
    return s.filter("item is not null")


def p3_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every repeated ancestor with its key, its parent and its own leaves as JSON."""
    rows = elements(table(spark, folder, "result_raw"), "record_id", "payload", REPEATED)
    parent = F.regexp_replace("ancestor", r"[^\[\]]*\[\]$", "")
    return rows.select("record_id", "ancestor", parent.alias("parent"), F.concat_ws(".", F.col("ords").cast("array<string>")).alias("ords"), "kind", "value", F.to_json("fields").alias("fields"))


QUERIES = {"p3_found": p3_found, "p3_elements": p3_elements}


def _name(key: str) -> str:
    return f"regexp_replace(lower({key}), '[^0-9a-z]', '', 'g')"


def _read(v: str) -> str:
    """JSON out of a string that holds a list or an object; everything else as it is."""
    text = f"json_extract_string({v}, '$')"
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({text}, '^\\s*[\\[{{]') AND json_valid({text}) THEN {text}::JSON ELSE {v} END"


def _elements(source: str, columns: str) -> str:
    """(columns, pos, x) of the elements of v: of a list, or what stands in its place."""
    return f"""(SELECT {columns}, generate_subscripts(v::JSON[], 1) - 1 AS pos, unnest(v::JSON[]) AS x FROM {source} WHERE json_type(v) = 'ARRAY'
                UNION ALL SELECT {columns}, 0, v FROM {source} WHERE json_type(v) NOT IN ('ARRAY', 'NULL'))"""


SQL = {
    "p3_found": f"""
        WITH p AS (SELECT record_id, {_read("payload::JSON")} AS v FROM result_raw WHERE json_valid(payload)),
        n AS (SELECT record_id, {_read("t.value")} AS v FROM p, json_tree(p.v) t WHERE json_type(p.v) = 'OBJECT' AND {_name("t.key")} = 'results' AND NOT contains(t.fullkey, '[')),
        r AS (SELECT record_id, pos AS result_pos, x AS r FROM {_elements("p", "record_id")} UNION ALL SELECT record_id, pos, x FROM {_elements("n", "record_id")}),
        l AS (SELECT record_id, result_pos, {_name("e.key")} AS list, {_read("e.value")} AS v FROM r, json_each(r.r) e WHERE json_type(r.r) = 'OBJECT' AND {_name("e.key")} IN ('indicators', 'redirectchain', 'resolvedips')),
        x AS (SELECT record_id, result_pos, list, pos, {_read("x")} AS x FROM {_elements("l", "record_id, result_pos, list")}),
        h AS (SELECT record_id, result_pos, x.pos AS parent_pos, {_read("e.value")} AS v FROM x, json_each(x.x) e WHERE list = 'redirectchain' AND json_type(x.x) = 'OBJECT' AND {_name("e.key")} = 'resolvedips'),
        f AS (SELECT record_id, result_pos, list, -1 AS parent_pos, pos, e.value AS v FROM x, json_each(x.x) e WHERE json_type(x.x) = 'OBJECT' AND {_name("e.key")} = CASE list WHEN 'indicators' THEN 'category' WHEN 'redirectchain' THEN 'url' END
              UNION ALL SELECT record_id, result_pos, list, -1, pos, x FROM x
              UNION ALL SELECT record_id, result_pos, 'resolvedips', parent_pos, pos, x FROM {_elements("h", "record_id, result_pos, parent_pos")})
        SELECT record_id, result_pos::INTEGER AS result_pos, CASE list WHEN 'redirectchain' THEN 'redirect_chain' WHEN 'resolvedips' THEN 'resolved_ips' ELSE list END AS child,
               parent_pos::INTEGER AS parent_pos, pos::INTEGER AS pos, json_extract_string(v, '$') AS item FROM f WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT', 'NULL')
    """,
}

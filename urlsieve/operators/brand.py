"""Brand impersonation: each host against all brands, as look-ups in constant tables.

The brand list is configuration (48 rows by default), so a row's pairs with all brands stay in the row: no join, no
shuffle, the same plan on streams. Brands that a row can match are looked up: by token and folded label, by skeleton,
and by the label's length for the edit distance, behind a bounded Levenshtein test. Only those, mostly none, are rated.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..config import Config
from ..functions.text import tokens
from ..functions.urls import host_suffixes

#: Points of the arms, in the order in which equal points are resolved.
ARMS = {"BR-1": 40, "BR-2": 40, "BR-3": 35, "BR-4": 22, "BR-5": 55, "BR-6": 40, "BR-7": 30, "BR-8": 12}
#: Weakening of brands that are ordinary words (subtracted, least, up to which points).
WEAKER, LEAST, UP_TO = 15, 8, 40
#: Brands reported, points for a brand together with credential words, and from which points.
TOP, COMBINED, COMBINED_FROM = 2, 10, 20


def skeleton(folded: Column) -> Column:
    """TXT-7 on folded text."""
    s = F.translate(F.replace(folded, F.lit("-"), F.lit("")), R.SKELETON_FROM, R.SKELETON_TO)
    return F.replace(F.replace(s, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def _skeleton(text: str) -> str:
    return text.replace("-", "").translate(str.maketrans(R.SKELETON_FROM, R.SKELETON_TO)).replace("rn", "m").replace("vv", "w")


def osa(a: Column, b: Column) -> Column:
    """TXT-4: optimal string alignment distance (insert, delete, substitute, swap neighbours); 4 where lengths differ by more than 3."""
    ac, bc = F.split(a, ""), F.split(b, "")
    la, lb = F.length(a), F.length(b)

    def row(state: Column, i: Column) -> Column:
        before, above = state["before"], state["above"]

        def cell(done: Column, j: Column) -> Column:
            here, there = F.get(ac, i - 1), F.get(bc, j - 1)
            swap = F.when((i > 1) & (j > 1) & (here == F.get(bc, j - 2)) & (F.get(ac, i - 2) == there), F.get(before, j - 2) + 1)
            best = F.least(F.get(above, j) + 1, F.get(done, j - 1) + 1, F.get(above, j - 1) + F.when(here == there, 0).otherwise(1), F.coalesce(swap, F.lit(1 << 20)))
            return F.array_append(done, best.cast("int"))

        line = F.when(lb > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(lb, F.lit(1))), F.array(i.cast("int")), cell)).otherwise(F.array(i.cast("int")))
        return F.struct(above.alias("before"), line.alias("above"))

    first = F.sequence(F.lit(0), lb)
    full = F.aggregate(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), F.struct(first.alias("before"), first.alias("above")), row, lambda s: F.element_at(s["above"], -1))
    return F.when(F.abs(la - lb) > 3, 4).when(la == 0, lb).otherwise(full)


def constant(value, schema: str) -> Column:
    """A constant of any type; it is parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _table(config: Config) -> Column:
    rows = [{"ord": i, "brand": b, "domains": sorted(d), "skeleton": _skeleton(b), "ordinary": b in R.AMBIGUOUS_BRANDS, "size": len(b)} for i, (b, d) in enumerate(config.brands.items())]
    return constant(rows, "array<struct<ord: int, brand: string, domains: array<string>, skeleton: string, ordinary: boolean, size: int>>")


def _grouped(pairs: list[tuple]) -> dict[str, list[str]]:
    made: dict[str, list[str]] = {}
    for key, brand in pairs:
        made.setdefault(str(key), []).append(brand)
    return made


CANDIDATES = "array<struct<points: int, ord: int, brand: string, rule_id: string>>"


def brand_candidates(df: DataFrame, config: Config) -> DataFrame:
    """Adds brands: array<struct<points, ord, brand, rule_id>>, the best candidate of each brand, best brands first."""
    if not config.brands:
        return df.withColumn("brands", F.array().cast(CANDIDATES))
    brands = list(config.brands)
    words, by_name = "array<string>", "map<string, array<string>>"
    names, official = constant(brands, words), sorted({d for ds in config.brands.values() for d in ds})
    skeletons = constant(_grouped([(_skeleton(b), b) for b in brands]), by_name)
    close = [(constant(_grouped([(n, b) for b in brands if len(b) >= least for n in range(len(b) - gap, len(b) + gap + 1)]), by_name), bound) for least, gap, bound in ((6, 1, 2), (9, 2, 4))]
    long = [b for b in brands if len(b) >= 6]
    none = F.array().cast(words)
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    dotted = F.concat(F.lit("."), F.col("subdomain"), F.lit("."))
    s = df.withColumns(
        {
            "__in_sub": F.array_intersect(names, tokens(F.col("fold_sub"))),
            "__in_sld": F.array_intersect(names, tokens(F.col("fold_sld"))),
            "__in_path": F.array_intersect(names, "path_tokens"),
            "__inside": F.when(F.col("subdomain").contains("."), F.filter(constant(official, words), lambda d: F.contains(dotted, F.concat(F.lit("."), d, F.lit("."))))).otherwise(none),
            "__compact": F.concat_ws(" ", F.regexp_replace("fold_sub", "[^a-z0-9]", ""), F.regexp_replace("fold_sld", "[^a-z0-9]", "")),
            # the label as written and without hyphens
            "__r0": F.col("sld_uni"),
            "__f0": F.col("fold_sld"),
            "__r1": F.when(F.col("sld_uni").contains("-"), bare("sld_uni")),
            "__f1": F.when(F.col("sld_uni").contains("-"), bare("fold_sld")),
        }
    )
    s = s.withColumns({f"__k{i}": skeleton(F.col(f"__f{i}")) for i in (0, 1)} | {f"__l{i}": F.length(f"__f{i}") for i in (0, 1)})

    def alike(i: int) -> list[Column]:
        fold = F.col(f"__f{i}")
        def within(table: Column, bound: int) -> Column:
            return F.filter(F.try_element_at(table, F.col(f"__l{i}").cast("string")), lambda b: F.levenshtein(fold, b, bound) >= 0)

        near = [within(*c) for c in close]
        return [F.array_intersect(names, F.array(fold)), F.try_element_at(skeletons, F.col(f"__k{i}")), *near]

    inside = F.when(F.size("__inside") > 0, F.transform(F.filter(_table(config), lambda b: F.arrays_overlap(b["domains"], "__inside")), lambda b: b["brand"]))
    contained = F.when(F.col("__compact").rlike("|".join(map(re.escape, long)) or "$^"), F.filter(constant(long, words), lambda b: F.contains("__compact", b)))
    every = [F.col("__in_sub"), F.col("__in_sld"), F.col("__in_path"), contained, inside, *alike(0), *alike(1)]
    s = s.withColumn("__cand", F.when(~F.col("is_ip"), F.array_distinct(F.flatten(F.array(*[F.coalesce(c, none) for c in every])))).otherwise(none))
    s = s.withColumn("__own", F.when(F.size("__cand") > 0, F.filter(F.array_union(F.array("registered_domain"), F.slice(host_suffixes(F.col("host")), 2, 1 << 20)), lambda x: x.isin(*official))).otherwise(none))
    rank = {rule: i for i, rule in enumerate(ARMS)}

    def arm(rule: str, ordinary: Column | None) -> Column:
        points = F.lit(ARMS[rule])
        if ordinary is not None and ARMS[rule] <= UP_TO:
            points = F.when(ordinary, max(ARMS[rule] - WEAKER, LEAST)).otherwise(ARMS[rule])
        return F.struct(points.cast("int").alias("points"), F.lit(-rank[rule]).alias("r"), F.lit(rule).alias("rule_id"))

    def near(b: Column, i: int) -> Column:
        """Within the edit distance allowed for the brand's length, exactly; only labels of fitting length get there."""
        fold, gap = F.col(f"__f{i}"), F.abs(F.col(f"__l{i}") - b["size"])
        two = (b["size"] >= 9) & (gap <= 2)
        return F.when(two | ((b["size"] >= 6) & (gap <= 1)), osa(fold, b["brand"]) <= F.when(two, 2).otherwise(1)).otherwise(F.lit(False))

    def one(b: Column) -> Column:
        brand, weak = b["brand"], b["ordinary"]

        def spelled(i: int) -> Column:
            fold = F.col(f"__f{i}")
            return (
                F.when((fold == brand) & (F.col(f"__r{i}") != brand), arm("BR-5", None))
                .when((fold != brand) & (b["size"] >= 4) & (F.col(f"__k{i}") == b["skeleton"]), arm("BR-6", None))
                .when((fold != brand) & near(b, i), arm("BR-7", weak))
            )

        named = (
            F.when(F.array_contains("__in_sub", brand), arm("BR-2", weak))
            .when(F.array_contains("__in_sld", brand), arm("BR-3", weak))
            .when((b["size"] >= 6) & F.contains("__compact", brand), arm("BR-4", weak))
        )
        inside = F.when(F.arrays_overlap(b["domains"], "__inside"), arm("BR-1", weak))
        best = F.array_max(F.filter(F.array(inside, named, spelled(0), spelled(1)), lambda x: x.isNotNull()))
        best = F.coalesce(best, F.when(F.array_contains("__in_path", brand), arm("BR-8", weak)))
        return F.when(best.isNotNull(), F.struct(best["points"].alias("points"), (-b["ord"]).alias("o"), brand.alias("brand"), best["rule_id"].alias("rule_id")))

    rated = F.filter(_table(config), lambda b: F.array_contains("__cand", b["brand"]) & ~F.arrays_overlap(b["domains"], "__own"))
    found = F.filter(F.transform(rated, one), lambda x: x.isNotNull())
    ordered = F.transform(F.reverse(F.array_sort(found)), lambda x: F.struct(x["points"].alias("points"), (-x["o"]).cast("int").alias("ord"), x["brand"].alias("brand"), x["rule_id"].alias("rule_id")))
    s = s.withColumn("brands", F.when(F.size("__cand") > 0, ordered).otherwise(F.array().cast(CANDIDATES)))
    return s.select(*df.columns, "brands")


def brand_indicators(df: DataFrame) -> DataFrame:
    """Adds g_brand from brands: the TOP best, and the combination with credential words."""
    named = F.transform(F.slice("brands", 1, TOP), lambda x: F.struct(x["rule_id"].alias("rule_id"), F.lit("brand").alias("category"), x["points"].alias("points"), F.concat(F.lit("imitates "), x["brand"]).alias("message")))
    both = F.when(
        (F.get("brands", 0)["points"] >= COMBINED_FROM) & (F.size("strong_hits") > 0),
        F.struct(F.lit("BR-combo").alias("rule_id"), F.lit("brand").alias("category"), F.lit(COMBINED).alias("points"), F.concat(F.lit("brand with "), F.array_join("strong_hits", ", ")).alias("message")),
    )
    return df.withColumn("g_brand", F.filter(F.concat(named, F.array(both)), lambda x: x.isNotNull()))

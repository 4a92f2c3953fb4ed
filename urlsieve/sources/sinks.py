"""Reports: JSON, CSV, console texts. Large results go to Spark's own writers; the exact forms stream rows in order."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import Config
from .. import refdata as R

_HIDDEN = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"


def safe_text(c: Column) -> Column:
    """TXT-1: control, format and line-separating characters as \\xNN up to 0xFF, \\uNNNN beyond."""

    def one(ch: Column) -> Column:
        # a character's UTF-32 form is its code point
        code = F.regexp_replace(F.lower(F.hex(F.encode(ch, "utf-32"))), "^0+(?=.)", "")
        return F.when(~ch.rlike(_HIDDEN), ch).when(F.length(code) <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))).when(F.length(code) <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))).otherwise(F.concat(F.lit("\\u"), code))

    return F.when(c.rlike(_HIDDEN), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def csv_safe(c: Column) -> Column:
    """TXT-2: safe_text, with an apostrophe before what a spreadsheet would take for a formula."""
    s = safe_text(c)
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), s)).otherwise(s)


def json_columns(results: DataFrame) -> DataFrame:
    """Result columns alone, indicators as (category, points, message)."""
    from ..plans.analyze import RESULT

    plain = F.transform("indicators", lambda i: F.struct(i["category"].alias("category"), i["points"].alias("points"), i["message"].alias("message")))
    return results.withColumn("indicators", plain).select(*RESULT)


def csv_columns(results: DataFrame) -> DataFrame:
    """SNK-2's eight columns, made safe."""
    joined = lambda c: csv_safe(F.array_join(F.col(c), "; "))
    return results.select(csv_safe(F.col("url")).alias("url"), csv_safe(F.col("hostname")).alias("hostname"), csv_safe(F.col("registered_domain")).alias("registered_domain"), "score", csv_safe(F.col("classification")).alias("classification"), joined("resolved_ips").alias("resolved_ips"), csv_safe(F.col("final_url")).alias("final_url"), joined("reasons").alias("reasons"))


def write_json_lines(results: DataFrame, path: str) -> None:
    """The form for large results: one JSON object a line, in parallel."""
    json_columns(results).write.mode("overwrite").json(path)


def write_csv_files(results: DataFrame, path: str) -> None:
    """The form for large results: CSV part files with header, doubled quotes, CRLF."""
    csv_columns(results).write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="")


def _in_order(results: DataFrame) -> Iterator[Row]:
    return (results.orderBy("ord") if "ord" in results.columns else results).toLocalIterator()


def write_json(results: DataFrame, target: str) -> None:
    """SNK-1: one array, indented by two, in input order; '-' is standard output. Rows are streamed."""
    rows = _in_order(results.select("ord", *json_columns(results).columns) if "ord" in results.columns else results)
    out = sys.stdout if target == "-" else open(target, "w", encoding="utf-8")  # noqa: SIM115
    try:
        n = 0
        for row in rows:
            d = row.asDict(recursive=True)
            d.pop("ord", None)
            d["indicators"] = [{k: i[k] for k in ("category", "points", "message")} for i in d["indicators"]]
            text = json.dumps(d, indent=2).replace("\n", "\n  ")
            out.write(("[\n  " if not n else ",\n  ") + text)
            n += 1
        out.write("\n]" if n else "[]")
        if target == "-":
            out.write("\n")
    finally:
        if target != "-":
            out.close()


def write_csv(results: DataFrame, path: str) -> None:
    """SNK-2: one file in input order."""
    import csv

    names = csv_columns(results).columns
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(names)
        safe = csv_columns(results.orderBy("ord") if "ord" in results.columns else results)
        for row in safe.toLocalIterator():
            w.writerow(list(row))


def _shown(results: DataFrame) -> DataFrame:
    return results.withColumns({"url": safe_text(F.col("url")), "hostname": safe_text(F.col("hostname")), "hostname_unicode": safe_text(F.col("hostname_unicode")), "registered_domain": safe_text(F.col("registered_domain")), "redirect_chain": F.transform("redirect_chain", safe_text), "reasons": F.transform("reasons", safe_text)})


#: Fixed value: addresses that a single report shows.
SHOWN_ADDRESSES = 8


def single_report(row: Row) -> str:
    """SNK-3 for one row of _shown()."""
    host = row.hostname + (f"  ({row.hostname_unicode})" if row.hostname_unicode not in ("", row.hostname) else "")
    lines = ["=" * 72, "URL ANALYSIS", "=" * 72, f"URL            : {row.url}", f"Hostname       : {host}"]
    if row.registered_domain and not row.ip_address:
        lines.append(f"Domain         : {row.registered_domain}")
    lines += [f"Risk score     : {row.score}/100", f"Classification : {row.classification}"]
    if row.resolved_ips:
        lines.append("Addresses      : " + ", ".join(row.resolved_ips[:SHOWN_ADDRESSES]))
    if len(row.redirect_chain) > 1:
        lines += ["", "Redirects:", *(f"  {i}. {u}" for i, u in enumerate(row.redirect_chain, 1))]
    lines += ["", "Indicators:"]
    for i, text in zip(row.indicators, row.reasons):
        lines.append(f"  {'[!]' if i.points else '[i]'} {f'(+{i.points})' if i.points else '':<6} {text}")
    if not row.indicators:
        lines.append("  [+] none")
    return "\n".join([*lines, "=" * 72])


def print_result(results: DataFrame, out: TextIO | None = None) -> None:
    for row in _shown(results).limit(1).collect():
        print(single_report(row), file=out or sys.stdout)


def print_batch(results: DataFrame, verbose: bool = False, out: TextIO | None = None) -> None:
    """SNK-4: score, class and URL in input order; verbose adds scored indicators. Rows are streamed."""
    out = out or sys.stdout
    print("=" * 90, "SCAN RESULTS", "=" * 90, f"{'SCORE':<8}{'CLASSIFICATION':<28}URL", "-" * 90, sep="\n", file=out)
    for row in _in_order(_shown(results)):
        print(f"{row.score:<8}{row.classification:<28}{row.url}", file=out)
        if verbose:
            for i, text in zip(row.indicators, row.reasons):
                if i.points:
                    print(f"{'':<8}  (+{i.points}) {text}", file=out)
    print("=" * 90, file=out)


def print_evaluation(rated: DataFrame, best: DataFrame, config: Config, out: TextIO | None = None) -> None:
    """SNK-5: a row per threshold, ascending, with marks at the configured ones, then the best F1."""
    out = out or sys.stdout
    marks = {config.medium_threshold: "  <- medium", config.high_threshold: "  <- high"}
    print(f"{'threshold':<11}{'TP':>7}{'FP':>7}{'TN':>7}{'FN':>7}{'precision':>11}{'recall':>9}{'F1':>7}", file=out)
    for m in rated.orderBy("threshold").collect():  # 21 rows
        print(f"{m.threshold:<11}{m.tp:>7}{m.fp:>7}{m.tn:>7}{m.fn:>7}{m.precision:>11.2f}{m.recall:>9.2f}{m.f1:>7.2f}{marks.get(m.threshold, '')}", file=out)
    for b in best.collect():
        print(f"\nBest F1 at threshold {b.threshold} (F1 {b.f1:.2f})", file=out)


#: Classes that make a scan fail, by level.
FAILING = {"high": [R.CLASS_HIGH, R.CLASS_INVALID], "medium": [R.CLASS_HIGH, R.CLASS_INVALID, R.CLASS_MEDIUM], "none": []}


def fails(results: DataFrame, level: str) -> bool:
    """SNK-6: whether any row reaches the level; stops at the first one found."""
    return bool(FAILING[level]) and not results.filter(F.col("classification").isin(FAILING[level])).limit(1).isEmpty()

"""Command line: scan URLs, evaluate labelled lists, dump the configuration. Exit status: 0 fine, 1 level reached, 2 usage or files."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__
from .config import Config, Options, load_domain_list


#: Observation stages that a scan can have, each an option of its own.
STAGES = {"dns": "addresses of hosts", "redirects": "where addresses lead", "content": "pages that walks end at", "rdap": "ages of domains"}
SERVICES = {"gsb": "Safe Browsing", "vt": "VirusTotal"}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="urlsieve", description="Explainable URL risk scores on Spark")
    p.add_argument("--version", action="version", version=__version__)
    given = p.add_mutually_exclusive_group()
    given.add_argument("-u", "--url", action="append", help="URL (repeatable)")
    given.add_argument("-f", "--file", help="list of URLs, - for standard input")
    given.add_argument("--evaluate", nargs=2, metavar=("GOOD", "BAD"), help="labelled lists to rate thresholds with")
    net = p.add_argument_group("observations (recorded ones from --observations, else looked up now)")
    net.add_argument("--observations", metavar="FOLDER", help="folder with dns_obs, hop_obs, rdap_obs, gsb_obs, vt_obs .parquet")
    net.add_argument("--offline", action="store_true", help="none of them, whatever else is given")
    net.add_argument("--full", action="store_true", help="all of: " + ", ".join(STAGES))
    for stage, about in STAGES.items():
        net.add_argument(f"--{stage}", action="store_true", help=about)
    for service, about in SERVICES.items():
        net.add_argument(f"--{service}", action="store_true", help=f"recorded reports of {about}")
        net.add_argument(f"--{service}-key", metavar="KEY", help=f"ask {about} with this key")
    net.add_argument("--allow-private-targets", action="store_true")
    for name in ("timeout", "max_redirects"):
        default = getattr(Options, name)
        net.add_argument("--" + name.replace("_", "-"), type=type(default), default=default)
    tune = p.add_argument_group("tuning")
    tune.add_argument("--config", metavar="FILE")
    tune.add_argument("--dump-config", action="store_true")
    tune.add_argument("--allowlist", metavar="FILE")
    tune.add_argument("--blocklist", metavar="FILE")
    tune.add_argument("--medium", type=int)
    tune.add_argument("--high", type=int)
    out = p.add_argument_group("output")
    out.add_argument("--json", metavar="FILE", help="- for standard output only; FOLDER/ for part files of JSON lines, written in parallel")
    out.add_argument("--csv", metavar="FILE", help="FOLDER/ for part files, written in parallel")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--quiet", action="store_true")
    out.add_argument("--workers", type=int, default=0, help="partitions of the scan (default: Spark's)")
    out.add_argument("--fail-on", choices=("none", "medium", "high"), default="high")
    out.add_argument("--debug", action="store_true")
    return p.parse_args(argv)


def configured(a: argparse.Namespace) -> Config:
    config = (Config.load(a.config) if a.config else Config()).with_thresholds(a.medium, a.high)
    return config.trusting(load_domain_list(a.allowlist)) if a.allowlist else config


def options_of(a: argparse.Namespace) -> Options:
    on = {stage: not a.offline and (a.full or getattr(a, stage)) for stage in STAGES}
    on["redirects"] |= on["content"]
    on |= {s: not a.offline and bool(getattr(a, s) or getattr(a, f"{s}_key")) for s in SERVICES}
    return Options(**on, timeout=a.timeout, max_redirects=a.max_redirects, allow_private=a.allow_private_targets and not a.offline)


def _error(text: str) -> int:
    print(f"[ERROR] {text}", file=sys.stderr)
    return 2


def main(argv: list[str] | None = None, spark=None) -> int:
    a = arguments(argv)
    try:
        config = configured(a)
        if a.blocklist:
            open(a.blocklist, encoding="utf-8").close()
    except (OSError, ValueError) as e:
        return _error(f"configuration: {e}")
    if a.dump_config:
        print(json.dumps(config.to_dict(), indent=2))
        return 0
    for path in [*(a.evaluate or []), *([a.file] if a.file and a.file != "-" else [])]:
        try:
            open(path, "rb").close()
        except OSError as e:
            return _error(f"can't read: {e}")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("urlsieve").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("INFO" if a.debug else "ERROR")
    from .operators.evaluate import evaluate
    from .plans.analyze import analyze
    from .sources import files, live, sinks
    from .sources.observations import SCHEMAS

    if a.evaluate:
        good, bad = files.read_labelled(spark, *a.evaluate)
        rated, best = evaluate(good, bad, config)
        sinks.print_evaluation(rated, best, config)
        return 0
    if a.url:
        urls = files.from_arguments(spark, a.url)
    elif a.file:
        urls = files.read_urls(spark, a.file)
    elif sys.stdin.isatty():
        try:
            urls = files.from_arguments(spark, [input("Enter URL: ")])
        except (KeyboardInterrupt, EOFError):
            return 0
    else:
        urls = files.read_urls(spark, "-")
    urls = urls.cache()
    n = urls.count()
    if not n:
        print("No URLs.", file=sys.stderr)
        return 2
    if a.workers:
        urls = urls.repartition(a.workers)
    options = options_of(a)
    if options.allow_private:
        print("[!] private targets are allowed", file=sys.stderr)
    observed = {}
    if options.uses_network and a.observations:
        recorded = {t: os.path.join(a.observations, f"{t}.parquet") for t in SCHEMAS}
        observed = {t: spark.read.parquet(path) for t, path in recorded.items() if os.path.exists(path)}
    elif options.uses_network:
        observed = live.observations(urls, "url", options, {s: getattr(a, f"{s}_key") for s in SERVICES}, a.workers or 8)
    blocklist = files.read_blocklist(spark, a.blocklist) if a.blocklist else None
    results = analyze(urls, "url", config, options, ["ord"], blocklist, observed).cache()
    if not a.quiet and a.json != "-":
        sinks.print_result(results) if n == 1 else sinks.print_batch(results, a.verbose)
    for target, write, write_parts in ((a.json, sinks.write_json, sinks.write_json_lines), (a.csv, sinks.write_csv, sinks.write_csv_files)):
        if target:
            try:
                (write_parts if target.endswith("/") else write)(results, target)
            except OSError as e:  # a report that can't be written doesn't change the status
                print(f"[ERROR] can't write {target}: {e}", file=sys.stderr)
    return int(sinks.fails(results, a.fail_on))


if __name__ == "__main__":
    sys.exit(main())

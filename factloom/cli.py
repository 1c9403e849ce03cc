"""Verbs: analyze, bundle, context, domains, result. Each reads a source tree and writes tables.

    python -m factloom.cli analyze PROJECT OUT
    python -m factloom.cli bundle PROJECT OUT
    python -m factloom.cli context PROJECT OUT [--budget BYTES]
    python -m factloom.cli domains PROJECT [--mode MODE]
    python -m factloom.cli result PROJECT [OUT] [--no-output]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.budget import scan_prefix
from .plans import context, formation, overview
from .plans.analyze import Tables, analyze
from .session import local_session, ship
from .sources import bundle, config, results, scan

KEYS = {"domains": "bucket", "memberships": "unit_id", "capabilities": "key", "relations": "source_group", "contracts": "id", "references": "id", "units": "id", "resources": "id", "control_flow": "id", "diagnostics": "code"}


def read(spark: SparkSession, project: str, settings: dict) -> tuple[Tables, DataFrame]:
    """The analysis of a source tree, and diagnostics of files that were left out."""
    ship(spark)
    tree, limits = scan.read_tree(spark, project, settings["scan"]["includeHidden"]), settings["limits"]
    files, large = scan.inventory(scan.with_language(tree), settings["scan"]["maxFileSizeBytes"])
    kept = scan_prefix(files, "path", "size", limits["maxFiles"], limits["maxTotalBytes"])
    names = scan.manifests(tree).select("path", "name", F.col("content").cast("string").alias("text"))
    t = analyze(kept, {k: v for k, v in limits.items() if k not in ("maxFiles", "maxTotalBytes")}, names)
    left_out = files.join(kept.select("path"), "path", "left_anti").select(F.lit("warning").alias("severity"), F.lit("ANALYSIS_LIMIT_REACHED").alias("code"), F.concat(F.col("size").cast("string"), F.lit(" bytes")).alias("message"), "path")
    return t, large.unionByName(left_out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=["analyze", "bundle", "context", "domains", "result"])
    parser.add_argument("project")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--config")
    parser.add_argument("--no-output", action="store_true")
    parser.add_argument("--budget", type=int, default=context.BUDGET)
    parser.add_argument("--mode", default=formation.MODES[1], choices=formation.MODES)
    a = parser.parse_args(args)
    if a.verb not in ("domains", "result") and not a.out:
        parser.error("OUT is needed")
    settings = config.load(a.config)
    spark = spark or SparkSession.getActiveSession() or local_session()
    began = time.time()
    t, large = read(spark, a.project, settings)
    if a.verb == "analyze":
        for name, df in t.frames.items():
            if name == "reachable":  # every pair; the parts say the same in less
                continue
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        large.write.mode("overwrite").parquet(f"{a.out}/skipped")
    elif a.verb == "bundle":
        bundle.write_bundle(spark, {k: t.frames[k] for k in KEYS}, a.out, KEYS, settings["bundle"]["partTargetBytes"])
    elif a.verb == "result":
        sections = overview.overview(t, overview.features(t))
        if a.no_output:
            results.compute_only(sections)
        elif a.out:
            results.write_result(spark, sections, a.out)
        else:
            results.print_result(sections)
    elif a.verb == "context":
        context.write_chunks(context.chunks(t, a.budget), a.out)
    else:
        formation.form_domains(t, a.mode)["domains"].orderBy("key").show(100, truncate=False)
    print(f"{a.verb}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()

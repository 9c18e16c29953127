"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs in full into a sink that keeps nothing; the first run, which compiles
code, is timed apart (cold).  rows_per_sec is for the whole feature graph.  After them,
unless more than BENCH_STORE_BEFORE seconds have gone by, a store is loaded from the same
tables and asked; its times are apart (store) and not in the total.
"""

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from strandline.plans import graph_view, plain_queries, registry, store_queries
from strandline.sources import files

HEADLINE = [
    "feature_counts_by_type", "gene_model", "region_features", "gff3_rows", "naive_recount", "source_count_tier", "genomic_bins", "segment_overlap", "same_feature_mismatch",
    "allowed_parent_violations", "envelope_violations", "envelope_repair", "depth_first_order", "top_level", "whole_feature_regroup", "multi_key_match", "functional_dedupe", "fidelity_by_type", "hard_case_flags", "defect_census", "attr_explode",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    began = time.perf_counter()
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, cold = registry.queries(), {}, {}
    for name in HEADLINE:
        for record in (cold, times):
            plain_queries.forget()  # no result of the run before
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - start, 3)
    rows = graph_view.features(spark, sf).count()
    total = round(sum(times.values()), 3)
    rate = {n: round(rows / times[n]) for n in ("feature_counts_by_type", "gff3_rows", "naive_recount", "whole_feature_regroup")}
    store = store_times(spark, sf) if time.perf_counter() - began < float(os.environ.get("BENCH_STORE_BEFORE", "900")) else {}
    print(json.dumps({"metric": "headline queries, warm, total", "value": total, "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "rows": rows, "rows_per_sec": rate, "store": store}))


def store_times(spark: SparkSession, sf: str) -> dict:
    """Seconds to load, verify, count, ask and write out a store; rows is what it holds."""
    times = {}

    def timed(name, f):
        start = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    w = timed("load", lambda: store_queries.store(spark, sf))
    times["rows"] = w.table(1, "feature").count()
    timed("verify", lambda: w.verify(1).collect())
    for _ in range(2):
        timed("stats", lambda: w.stats().collect())
    one = w.table(1, "feature").filter("source_type = 'gene' and seqid = 'chr3'").orderBy("start").first()
    timed("gene_model", lambda: w.by_id(1, one.source_id, descendants=True).collect())
    timed("region", lambda: w.in_region(1, f"chr3:{one.start}-{one.start + 100000}").collect())
    timed("export", lambda: w.write_gff3(1, files.scratch(spark, "bench")))
    return times


if __name__ == "__main__":
    main()

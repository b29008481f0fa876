"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from genospan import Genotypes, freq, glm, hardy, missing, set_setting, shape
    from genospan.plans.derived import dataset

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="genospan-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.checkpoint.dir", f"file://{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, frame) -> None:
        began = time.time()
        frame().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)

    data = dataset(spark, sf_dir)
    began = time.time()
    data.write(f"{work}/wide")
    times["ingest"] = round(time.time() - began, 3)
    data = Genotypes(spark.read.parquet(f"{work}/wide.gt.parquet"), data.samples.cache(), data.n)
    timed("freq", lambda: freq(data, counts=True))
    timed("missing_variant", lambda: missing(data))
    timed("hardy", lambda: hardy(data))
    timed("sample_counts_dense", lambda: shape(data, "read_pfile", orient="sample", genotypes="counts"))
    set_setting(spark, "sample_counts_sparse", True)
    timed("sample_counts_sparse", lambda: shape(data, "read_pfile", orient="sample", genotypes="counts"))
    set_setting(spark, "sample_counts_sparse", False)
    timed("sample_counts_subset_1pct", lambda: shape(data, "read_pfile", orient="sample", genotypes="counts", samples=list(range(max(1, data.n // 100)))))
    timed("glm_linear", lambda: glm(data, "c_acctbal"))
    timed("tidy_carriers", lambda: shape(data, "read_pfile", orient="genotype", include_genotypes=["het", "hom_alt"]).agg(F.count("*")))
    if os.environ.get("BENCH_LLM", "1") == "1":
        try:
            from genospan.llm.queries import QUERIES
        except ImportError:
            QUERIES = {}
        for name in ("op3_token_counts", "op5_mix_sources", "op8_simhash_near_dedup"):
            if name in QUERIES:
                timed(name, lambda name=name: QUERIES[name](spark, sf_dir))
    print(json.dumps({"metric": "genotype_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "variants": data.table.count(), "samples": data.n, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: the headline scoring jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each job is a full pipeline (read -> ... -> prediction) forced through the ``noop`` sink, timed
as the reference's N-iteration loop does (nothing cached; every pass re-reads the input).
Per job: the cold first pass and the median of the later passes, of which there are enough that
one slow pass does not count as a slow job. Prints ONE JSON line; the headline value is the sum
of the warm medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veloscore.operators.features import tag_key  # noqa: E402
from veloscore.operators.relational import score_relational  # noqa: E402
from veloscore.operators.scoring import score  # noqa: E402
from veloscore.operators.sequence import score_sequence  # noqa: E402
from veloscore.plans.jobs import score_and_report, scored, timed_runs  # noqa: E402
from veloscore.plans.sinks import scored_count  # noqa: E402
from veloscore.session import local_session  # noqa: E402
from veloscore.sources.model_table import (demo_class_model, demo_multi_model,  # noqa: E402
                                           demo_scalar_model, demo_vector_model)
from veloscore.sources.sequence_model import demo_sequence_model  # noqa: E402
from veloscore.sources.series import series_from_table  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    iterations = int(os.environ.get("BENCH_ITERATIONS", "6"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="veloscore-bench")
    scalar, vector, multi = demo_scalar_model(), demo_vector_model(), demo_multi_model()

    def events():
        return series_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))

    def embeddings():
        return tag_key(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

    def lineitem():
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax")

    jobs = {
        "events_udf_b5": lambda: scored(events(), scalar, route="udf", batch_size=5),
        "events_udf_b4096": lambda: scored(events(), scalar, route="udf", batch_size=4096),
        "events_native": lambda: scored(events(), scalar, route="native"),
        "embeddings_udf_b32": lambda: score(embeddings(), vector, "embedding", route="udf",
                                            batch_size=32),
        "embeddings_native": lambda: score(embeddings(), vector, "embedding", route="native"),
        "report_native": lambda: score_and_report(events(), scalar, route="native"),
        "report_udf_b5": lambda: score_and_report(events(), scalar, route="udf", batch_size=5),
        "count_native": lambda: scored_count(scored(events(), scalar, route="native")),
        "lineitem4_native": lambda: scored(lineitem(), multi, label_from=0, label_to=3),
        "lineitem4_udf_b4096": lambda: scored(lineitem(), multi, label_from=0, label_to=3,
                                              route="udf", batch_size=4096),
    }
    # Added in round 3; the headline value is the sum of the ten jobs above, as before.
    extra = {
        "embeddings_class_native": lambda: score(embeddings(), demo_class_model(), "embedding"),
        "embeddings_relational": lambda: score_relational(embeddings(), vector.to_frame(spark), "embedding"),
        "events_sequence_udf": lambda: score_sequence(
            series_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), keep=("event_id", "user_id")),
            demo_sequence_model(), ["user_id"], ["unix_time", "event_id"], route="udf"),
    }
    warm, cold, rows = {}, {}, {}
    t_all = time.time()
    for name, build in (jobs | extra).items():
        t = timed_runs(build, iterations).orderBy("iteration").collect()
        cold[name] = round(t[0]["elapsed_ms"] / 1000, 3)
        later = t[1:] or t
        warm[name] = round(statistics.median(r["elapsed_ms"] for r in later) / 1000, 3)
        rows[name] = t[0]["rows"]
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_warm_job_seconds", "value": round(sum(warm[k] for k in jobs), 3), "unit": "sec",
        "queries": warm, "cold": cold, "rows": rows, "iterations": iterations,
        "wall_sec": round(time.time() - t_all, 1), "cpus": cpus,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected to the driver).  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # preprocessing: four cleaning versions of every review, and their summary
    "versions", "preprocessing_summary", "cleaning_stats",
    # label analysis
    "label_distribution", "net_score_topk", "daily_label_counts", "top_words_by_label",
    # sparse features (flagship chain)
    "tfidf_weights", "top_terms_by_class", "anova_f", "doc_similarity",
    # metrics, errors, ensembles
    "summary_metrics", "roc_auc_ovr", "pr_curve", "calibration", "search_weights", "hard_vote",
    # sequences and vectors
    "encode_sequences", "most_similar", "group_coherence", "pool_tokens_masked",
    # fitted models
    "fit_logistic", "train_word2vec",
]


def _sf_value(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from nazar.plans.catalog import all_queries
    from nazar.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    qs = all_queries()
    # warm-up: JVM, parquet footers, Python workers
    qs["label_distribution"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(times.values()), 3)
    out = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": _sf_value(sf_dir),
        "documents": n_docs,
        "preprocess_docs_per_sec": round(n_docs / times["versions"], 1) if times.get("versions") else None,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

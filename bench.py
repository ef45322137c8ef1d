"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Inputs that are derived from the given tables are written before the clock starts; every query then runs whole, from
its plan to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    from pyspark.sql import functions as F

    from maskline import fixed_values as fixed
    from maskline.operators import corpus, detect, evaluate, leaks, limits, mask, spans
    from maskline.plans.masking import mask_conversations
    from maskline.session import local_session, materialize
    from maskline.sources.files import annotate
    from suite.registry import Tables

    spark = local_session(CPUS, CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, SF_DIR)
    # The given files hold one row group each: spread the texts over the cores, as many files would.
    docs = materialize(t("documents").repartition(4 * CPUS))
    talks = materialize(t("fx_conversations").repartition(4 * CPUS))
    letters = materialize(annotate(t("fx_letters"), t("fx_gold")).repartition(4 * CPUS))
    names = materialize(t("fx_first_names"))
    found = materialize(t("fx_spans").repartition(4 * CPUS))
    gold, pred, priced = t("fx_gold"), t("fx_pred"), t("fx_priced")
    teams, access, caps = t("fx_teams"), t("fx_access"), t("fx_caps")
    made = materialize(corpus.build_corpus(spark.range(10000).repartition(4 * CPUS)))
    made_docs = made.select(F.col("id").alias("doc_id"), F.lit("fr").alias("lang"), "text")
    made_gold = made.select(F.col("id").alias("doc_id"), F.inline("entities")).withColumnRenamed("type", "entity_type")
    made_names = materialize(spark.createDataFrame([(n,) for n in corpus.FIRST_NAMES], "name string"))

    def made_spans():
        strong = spans.drop_contained(detect.detect_all(made_docs, made_names, fixed.MASKED_ENTITIES)).where(
            F.col("score") >= fixed.SCORE_THRESHOLD
        )
        return spans.merge_overlaps(strong)

    predicted = materialize(made_spans())
    queries = {
        "detect_all": lambda: detect.detect_all(docs, names),
        "detect_all_fr": lambda: detect.detect_all(docs.withColumn("lang", F.lit("fr")), names),
        "find_spans": lambda: detect.find_spans(docs, "[0-9]{2,}", "HASH", 0.2),
        "mask_conversations": lambda: mask_conversations(talks, names)[0],
        "detect_filter_merge_corpus": made_spans,
        "drop_contained": lambda: spans.drop_contained(found),
        "merge_overlaps": lambda: spans.merge_overlaps(found),
        "assign_markers": lambda: mask.assign_markers(t("fx_conv_spans")),
        "scores_overall": lambda: evaluate.scores_overall(made_gold, predicted),
        "fully_masked": lambda: evaluate.fully_masked(made_gold, predicted),
        "private_words": lambda: leaks.private_words(letters),
        "admission": lambda: limits.admission(priced, teams, access, caps),
        "rate_decisions": lambda: limits.rate_decisions(priced, teams),
        "budget_decisions": lambda: limits.budget_decisions(priced, teams),
        "build_corpus": lambda: corpus.build_corpus(spark.range(10000).repartition(4 * CPUS)),
    }
    rows = {
        "detect_all": docs.count(), "mask_conversations": talks.count(), "merge_overlaps": found.count(),
        "admission": priced.count(), "detect_filter_merge_corpus": 10000,
    }
    chosen = sys.argv[1:] or list(queries)
    seconds = {}
    for name in chosen:
        started = time.time()
        queries[name]().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    result = {
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_second": {n: round(rows[n] / seconds[n]) for n in rows if n in seconds},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
    }
    if not sys.argv[1:]:
        score = evaluate.scores_overall(made_gold, predicted).first()
        share = evaluate.fully_masked(made_gold, predicted).first()
        result["quality"] = {
            "precision": round(score["precision"], 4), "recall": round(score["recall"], 4), "f1": round(score["f1"], 4),
            "fully_masked": round(share["share"], 4), "gold": score["gold"],
        }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

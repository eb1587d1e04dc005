"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs to the end over all its rows and columns; the ``noop`` sink takes the result. After $BENCH_SECONDS no
further query is begun; the line then names those left out and gives no total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treespark.plans.catalogue import QUERIES  # noqa: E402
from treespark.session import local_session  # noqa: E402

HEADLINE = [
    "h5_eligible_sizes", "c6_closure", "h3_subtrees", "h4_neighbours", "h7_negative_trees", "h9_phrase_sets",
    "h11_within_distance", "h12_attention_pairs", "h1_expanded_trees", "e1_spans", "a1_text_lines", "a2_conllu",
    "d5_label_inventory", "f6_upsample", "h18_model_inputs", "e4_chunks", "h13_masked_tokens", "h15_padded_batches",
    "h16_packed_trees", "d9_pooled_rows", "d10_attachment_scores", "j1_tree_similarities", "j2_tree_loss",
    "j2_phrase_loss", "e7_best_so_far", "k1_word_frequencies", "k5_encoded_words", "k6_encoded_sentences",
]


def headline(seconds: dict[str, float], left_out: list[str]) -> float | None:
    """The total of all headline queries; nothing if some were left out."""
    return None if left_out else round(sum(seconds.values()), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "treespark-bench")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["d1_split_sizes"](spark, sf_dir).collect()  # start-up and first reads
    seconds, left_out = {}, []
    begun = time.time()
    for name in HEADLINE:
        start = time.time()
        if start - begun > float(os.environ.get("BENCH_SECONDS", "1200")):
            left_out.append(name)
            continue
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = headline(seconds, left_out)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "left_out": left_out, "sf": sf}))


if __name__ == "__main__":
    main()

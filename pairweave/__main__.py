"""Compare retrieval approaches on a pair table: ``python -m pairweave --data pairs.csv``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from pairweave.operators.embed import hashed_ngrams, word_average
from pairweave.plans.workflows import Approach, retrieval_experiment
from pairweave.session import build_session
from pairweave.sources.pairs import load_pairs


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True, help="CSV or parquet with id, sentence1, sentence2, label")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--sample-size", type=int, default=None, help="number of queries to sample")
    parser.add_argument("--word-vectors", default=None, help="parquet with word, vector")
    parser.add_argument("--cells", type=int, default=None, help="also compare an index with this many cells")
    parser.add_argument("--master", default=None)
    args = parser.parse_args()

    spark = build_session(master=args.master)
    approaches = [Approach("ngrams", hashed_ngrams)]
    if args.cells:
        approaches.append(Approach("ngrams_index", hashed_ngrams, cells=args.cells))
    if args.word_vectors:
        words = spark.read.parquet(args.word_vectors)
        dim = words.select(F.size("vector")).first()[0]
        approaches.append(Approach("word_average", lambda texts: word_average(texts, words, dim)))
    result = retrieval_experiment(load_pairs(spark, args.data), approaches, args.top_k, args.sample_size)
    result.comparison.show(truncate=False)
    result.timing.show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()

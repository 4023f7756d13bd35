"""Checks, profiles, splits and derived pair tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.functions.text import digest_number, seeded_digest, seeded_number, text_key
from pairweave.operators.ordering import BROADCAST_BUCKETS, digest_parts, digest_position, global_index, running_totals
from pairweave.schemas import PAIR_COLUMNS, require_columns
from pairweave.session import materialize

# Shortest and longest sentence, and the share of positives, that raise no warning.
MIN_LENGTH, MAX_LENGTH = 5, 200
BALANCE = (0.3, 0.7)


def validate_pairs(df: DataFrame) -> DataFrame:
    """``(check, n_bad, status)`` from one aggregate over the table.

    Missing columns are refused while the plan is built. Bad labels and nulls
    are errors, sentence lengths and label balance are warnings.
    """
    require_columns(df, PAIR_COLUMNS)
    lengths = [F.length("sentence1"), F.length("sentence2")]
    positive = F.count_if(F.col("label") == 1)
    share = positive / F.count(F.lit(1))
    found = df.agg(
        F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("invalid_label"),
        sum(F.count_if(F.col(c).isNull()) for c in PAIR_COLUMNS).alias("missing_value"),
        F.count_if((lengths[0] < MIN_LENGTH) | (lengths[1] < MIN_LENGTH)).alias("short_sentence"),
        F.count_if((lengths[0] > MAX_LENGTH) | (lengths[1] > MAX_LENGTH)).alias("long_sentence"),
        F.when((share < BALANCE[0]) | (share > BALANCE[1]), 1).otherwise(0).cast("long").alias("unbalanced_labels"),
    )
    severity = F.when(F.col("check").isin("invalid_label", "missing_value"), "error").otherwise("warning")
    return found.unpivot([], found.columns, "check", "n_bad").withColumn(
        "status", F.when(F.col("n_bad") == 0, "ok").otherwise(severity)
    )


def canonical_row(columns: Sequence[str]) -> Column:
    """All values of a row as one string; lengths keep values apart and null has none."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("null")) for t in texts])


def dataset_metadata(df: DataFrame) -> DataFrame:
    """Size, columns, label counts, positive ratio and a content fingerprint.

    The fingerprint adds 60 bits of every row's SHA-256, so it is combined in
    the map stage and does not depend on row order or file layout.
    """
    digest = F.sha2(canonical_row(df.columns), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    # one entry per different label, whatever the labels are
    each = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.coalesce(F.col("label").cast("string"), F.lit("null")), F.lit(":"), "n")
    distribution = each.agg(F.array_join(F.array_sort(F.collect_list(entry)), ",")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("size"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("other_labels"),
        F.avg(F.col("label").cast("double")).alias("positive_ratio"),
        F.sum(number).cast("string").alias("fingerprint"),
    ).withColumn("label_counts", distribution)


def stratified_split(
    df: DataFrame,
    key: str = "id",
    label: str = "label",
    parts: Sequence[tuple[str, int]] = (("train", 70), ("val", 15), ("test", 15)),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exact percentages within each label, in seeded order."""
    if sum(p for _, p in parts) != 100:
        raise ValueError("split percentages must add up to 100")

    def part_of(position: Column, size: Column) -> Column:
        limit, part = 0, F
        for name, share in parts:
            limit += share
            part = part.when(position * 100 < size * limit, name)
        return part

    return digest_parts(df, key, seed, part_of, [label], "split")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, size) rows without replacement, the same for the same seed."""
    if n < 0:
        raise ValueError("n must not be negative")
    taken = digest_parts(df, key, seed, lambda position, _: position < n, name="__taken")
    return taken.where("__taken").drop("__taken")


def augment_pairs(
    df: DataFrame, factor: int = 2, seed: int = 42, suffix: str = "~", separator: str = " ", min_words: int = 4
) -> DataFrame:
    """Original pairs plus ``factor - 1`` edited copies of every positive pair.

    One side, chosen by the seed, gets ``suffix`` on one of its words when it
    has at least ``min_words``. In a text without the separator, such as one in
    an unsegmented script, the characters are its words. New ids continue after the largest id, copy by
    copy in id order.
    """
    if factor <= 1:
        return df
    largest, count = df.agg(F.max("id"), F.count_if(F.col("label") == 1)).first()
    if not count:
        return df
    ordered = global_index(df.where(F.col("label") == 1), "id", "__order")
    copies = ordered.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(factor - 1))))
    token = F.concat_ws(":", F.col("__copy"), F.col("id"))
    first = seeded_number(token, f"{seed}-side") % 2 == 0
    chosen = copies.withColumn("__first", first).withColumn(
        "__side", F.when(first, F.col("sentence1")).otherwise(F.col("sentence2"))
    )
    segmented = F.contains("__side", F.lit(separator))
    letters = F.regexp_extract_all("__side", F.lit("(?s)."), F.lit(0))
    chosen = chosen.withColumn("__parts", F.when(segmented, F.split("__side", re.escape(separator))).otherwise(letters))
    word = F.pmod(seeded_number(token, f"{seed}-word"), F.size("__parts")).cast("int")
    marked = F.concat(
        F.slice("__parts", 1, F.col("__at")),
        F.array(F.concat(F.get("__parts", F.col("__at")), F.lit(suffix))),
        F.slice("__parts", F.col("__at") + 2, F.size("__parts")),
    )
    edited = chosen.withColumn("__at", word).withColumn(
        "__edited",
        F.when(
            F.size("__parts") >= min_words,
            F.when(segmented, F.array_join(marked, separator)).otherwise(F.array_join(marked, "")),
        ),
    )
    values = {
        "id": F.lit(largest + 1) + (F.col("__copy") - 1) * count + F.col("__order"),
        "sentence1": F.coalesce(F.when(F.col("__first"), F.col("__edited")), F.col("sentence1")),
        "sentence2": F.coalesce(F.when(~F.col("__first"), F.col("__edited")), F.col("sentence2")),
    }
    return df.unionByName(edited.select(*[values.get(c, F.col(c)).alias(c) for c in df.columns]))


def generate_pairs(pool: DataFrame, seed: int = 42) -> DataFrame:
    """One labelled pair per pool sentence: same domain (1) or another domain (0).

    ``pool``: ``(domain, sentence)``. Distinct sentences get a position in their
    domain and, domains laid end to end, in the pool. The partner is a position
    computed from the seed, so it is found by one equi-join on a unique key. A
    sentence whose side has no partner is left out.
    """
    keyed = pool.where(F.col("sentence").isNotNull() & F.col("domain").isNotNull()).withColumn(
        "key", text_key(F.concat_ws("\x1f", "domain", "sentence"))
    )
    sentences = materialize(
        keyed.groupBy("key").agg(F.first("domain").alias("domain"), F.first("sentence").alias("sentence")), "sentences"
    )
    keys = sentences.select("key", "domain")
    sizes = keys.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    starts = running_totals(
        sizes.withColumn("bucket", digest_number(F.md5("domain"), 1, 3)), {"upto": "n"}, [F.col("domain")], "bucket"
    ).select("domain", (F.col("upto") - F.col("n")).alias("start"))
    starts = materialize(starts, "domain-starts")
    if starts.count() <= BROADCAST_BUCKETS:  # one row per domain
        starts = F.broadcast(starts)
    total = sizes.agg(F.sum("n")).scalar()
    placed = digest_position(keys, "key", seed, ["domain"], "place", total="size")
    located = placed.join(starts, "domain").withColumn("at", F.col("start") + F.col("place"))
    located = materialize(located, "located")
    label = (seeded_number("key", f"{seed}-label") % 2).cast("int")
    pick = digest_number(seeded_digest("key", f"{seed}-pick"), 1, 15)  # 60 bits reach any partner
    same = F.col("start") + F.pmod(F.col("place") + 1 + F.pmod(pick, F.greatest(F.col("size") - 1, F.lit(1))), F.col("size"))
    others = total - F.col("size")
    other = F.pmod(F.col("start") + F.col("size") + F.pmod(pick, F.greatest(others, F.lit(1))), total)
    wanted = located.withColumn("label", label).withColumn("partner", F.when(F.col("label") == 1, same).otherwise(other))
    wanted = wanted.where(F.when(F.col("label") == 1, F.col("size") > 1).otherwise(others > 0))
    partners = located.select(F.col("at").alias("partner"), F.col("key").alias("key2"), F.col("domain").alias("domain2"))
    pairs = wanted.join(partners, "partner").select("key", "key2", F.col("domain").alias("domain1"), "domain2", "label")
    one = sentences.select("key", F.col("sentence").alias("sentence1"))
    two = sentences.select(F.col("key").alias("key2"), F.col("sentence").alias("sentence2"))
    return pairs.join(one, "key").join(two, "key2").select(
        F.col("key").alias("pair_key"), "domain1", "domain2", "sentence1", "sentence2", "label"
    )

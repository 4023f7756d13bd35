import pytest
from pyspark.sql import functions as F

from pairweave.operators import quality as q

SCHEMA = "id long, sentence1 string, sentence2 string, label int"


def test_validate(spark):
    rows = [
        (1, "a good sentence", "another good one", 1),
        (2, "abc", "another good one", 0),
        (3, "x" * 201, "another good one", 3),
        (4, None, "another good one", None),
        (5, "a good sentence", "another good one", 1),
    ]
    got = {r.check: (r.n_bad, r.status) for r in q.validate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        "invalid_label": (2, "error"),
        "missing_value": (2, "error"),
        "short_sentence": (1, "warning"),
        "long_sentence": (1, "warning"),
        "unbalanced_labels": (0, "ok"),
    }
    with pytest.raises(ValueError):
        q.validate_pairs(spark.createDataFrame([(1, "x")], "id long, sentence1 string"))


def test_split_is_exact_per_label(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    out = q.stratified_split(df)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 630, (0, "val"): 135, (0, "test"): 135, (1, "train"): 70, (1, "val"): 15, (1, "test"): 15}
    again = q.stratified_split(df.repartition(7))
    assert sorted(out.collect()) == sorted(again.collect())
    assert out.join(q.stratified_split(df, seed=1), "id").where("1=1").count() == 1000
    with pytest.raises(ValueError):
        q.stratified_split(df, parts=(("a", 50),))


def test_sample(spark):
    df = spark.range(50)
    one, two = q.sample_rows(df, 20, "id"), q.sample_rows(df.repartition(3), 20, "id")
    assert one.count() == 20 and sorted(one.collect()) == sorted(two.collect())
    assert q.sample_rows(df, 500, "id").count() == 50


def test_metadata_fingerprint(spark):
    rows = [(1, "a", "b", 1), (2, None, "", 0), (2, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = q.dataset_metadata(df).first()
    assert (first["size"], first.positives, first.negatives) == (3, 1, 2)
    assert first.columns == "id,sentence1,sentence2,label" and first.positive_ratio == pytest.approx(1 / 3)
    shuffled = q.dataset_metadata(df.repartition(3).orderBy(F.desc("id"))).first()
    assert shuffled.fingerprint == first.fingerprint
    other = spark.createDataFrame([(1, "a", "b", 1), (2, "", "", 0), (2, None, "", 0)], SCHEMA)
    assert q.dataset_metadata(other).first().fingerprint != first.fingerprint


def test_augment(spark):
    rows = [(10, "one two three four", "five six seven eight", 1), (3, "short", "too short", 1), (5, "a b c d", "e f g h", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.id: r for r in q.augment_pairs(df, factor=3, suffix="!").collect()}
    assert sorted(out) == [3, 5, 10, 11, 12, 13, 14]
    for i in (11, 13):  # copies of row 3: a text without blanks is edited by characters, two words are too few
        assert out[i].sentence1.replace("!", "") == "short" and out[i].sentence2 == "too short"
    assert all(r.sentence1.count("!") + r.sentence2.count("!") <= 1 for r in out.values())
    for i in (12, 14):
        r = out[i]
        changed = [r.sentence1 != rows[0][1], r.sentence2 != rows[0][2]]
        assert sum(changed) == 1 and r.label == 1
        text = r.sentence1 if changed[0] else r.sentence2
        assert text.count("!") == 1 and text.replace("!", "") in rows[0][1:3]
    assert q.augment_pairs(df, factor=1).count() == 3


def test_generated_pairs_follow_the_rules(spark):
    pool = [(d, f"{d}-{i}") for d, n in (("hot", 60), ("b", 9), ("c", 4)) for i in range(n)] + [("hot", "hot-1")] * 20
    out = q.generate_pairs(spark.createDataFrame(pool, "domain string, sentence string")).collect()
    assert len(out) == len({r.sentence1 for r in out}) == 73
    for r in out:
        assert (r.domain1 == r.domain2) == (r.label == 1)
        assert r.sentence1 != r.sentence2 and r.sentence2.startswith(r.domain2)
    assert {r.label for r in out} == {0, 1}


def test_lonely_sentences_are_left_out(spark):
    one = spark.createDataFrame([("a", "x")], "domain string, sentence string")
    assert q.generate_pairs(one).count() == 0
    single_domain = spark.createDataFrame([("a", f"x{i}") for i in range(20)], "domain string, sentence string")
    assert {r.label for r in q.generate_pairs(single_domain).collect()} == {1}


def test_unsegmented_text_is_edited_and_null_differs_from_its_mark(spark):
    df = spark.createDataFrame([(1, "今晚的火车几点到", "北站今晚有哪些车", 1)], SCHEMA)
    out = q.augment_pairs(df, factor=4).where("id > 1").collect()
    assert len(out) == 3
    for r in out:
        assert (r.sentence1 + r.sentence2).count("~") == 1
        assert (r.sentence1 + r.sentence2).replace("~", "") == "今晚的火车几点到北站今晚有哪些车"
    prints = set()
    for a, b in ((None, "x"), ("null", "x"), ("\\N", "x"), ("a\x1f1:b", "c"), ("a", "b\x1f1:c")):
        prints.add(q.dataset_metadata(spark.createDataFrame([(1, a, b, 3)], SCHEMA)).first().fingerprint)
    assert len(prints) == 5
    graded = spark.createDataFrame([(i, "a", "b", i % 3 or None) for i in range(7)], SCHEMA)
    assert q.dataset_metadata(graded).first().label_counts == "1:2,2:2,null:3"

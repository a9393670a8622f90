"""Quality rules, toxicity and the quality classifier on small frames and against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row, functions as F

from probcast.llm import quality_model, quality_rules, toxicity
from probcast.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ka lo mi ren tas vu por zel ni gra shu bem dor fi".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n)) + "."


def statistics_by_hand(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(marked))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    loop = "a b c d e f g h i "
    texts = [None, "", "  \n\t ", "one", "x " * 30, loop * 4, loop + "q " + loop, "é|ü## <b>\n\nline\nline\n \nline",
             "  a　b\x1fc \x0b d", prose(rng, 3000) + prose(rng, 40) * 3, "z" * 100_000]
    df = spark.createDataFrame([Row(doc_id=i, text=t, n_words="clash") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.text_statistics(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics_by_hand(t), i


def labelled_stats(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = quality_rules.text_statistics(df, keep=("doc_id", "quality"))
    return df, stats


def test_decision_list_learns_thresholds_and_keeps_clean_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), 1) for i in range(200)]
    rows += [(1000 + i, " ".join(word(rng) + "##" for _ in range(60)), 0) for i in range(40)]
    rows += [(2000 + i, " ".join([word(rng).upper()] * 3 + [word(rng).upper() for _ in range(50)]), 0) for i in range(40)]
    rows += [(3000, None, None), (3001, "", 1)]
    _, stats = labelled_stats(spark, rows)
    rules = quality_rules.fit_decision_list(stats)
    assert rules.rules and all(c.feature in quality_rules.FEATURES for r in rules.rules for c in r)
    out = quality_rules.apply_decision_list(stats, rules).collect()
    long_ones = [r for r in out if r["n_words"] >= 20]
    assert all(r["kept"] == (r["quality"] == 1) for r in long_ones)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 20)


def test_verdict_is_the_ordered_rules(spark):
    rules = quality_rules.DecisionList([
        [quality_rules.Condition("n_symbols", True, 5.0), quality_rules.Condition("n_words", False, 10.0)],
        [quality_rules.Condition("n_words", True, 100.0)]])
    df = spark.createDataFrame([(1, 6, 3), (2, 6, 20), (3, 0, 200), (4, None, 3)], "id int, n_symbols int, n_words int")
    got = {r["id"]: r["rule"] for r in df.select("id", rules.rule_number().alias("rule")).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: None}
    assert "else: keep" in str(rules)


@pytest.mark.parametrize("rows", [[], [(1, "a b c", 1)], [(1, "a b c", None)]])
def test_decision_list_without_two_classes_is_empty(spark, rows):
    _, stats = labelled_stats(spark, rows)
    assert quality_rules.fit_decision_list(stats).rules == []


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


INSULTS = ["blorgface", "snivelrat", "dungwit"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(9999, None)], "doc_id long, toxic int")
    return d, lab, toxicity.fit_toxicity(d, lab)


def test_toxicity_on_held_out_rows(spark, toxic_model):
    docs, labels, model = toxic_model
    scored = toxicity.score_toxicity(docs, model, ["doc_id"]).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    rows = scored.collect()
    assert len(rows) > 50
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) >= 0.97 * len(rows)


def test_toxicity_tolerates_gaps_and_insertions(spark, toxic_model):
    _, _, model = toxic_model
    rng = random.Random(4)
    plain = prose(rng, 40)
    hidden = [f"{plain} you blorg-face and snivelxrat and dung.wit", f"{plain} b l o r g f a c e s n i v e l r a t",
              f"{plain} blo_rgface snive*lrat dungw1it"]
    texts = [plain, *hidden, "", None, prose(rng, 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(texts)
    assert score[0] < 0.5 and score[4] < 0.5 and score[5] < 0.5
    assert min(score[1], score[2], score[3]) > score[0] + 0.2


def test_kernel_is_normalised_and_counts_gaps():
    k = toxicity.kernel_with(["moron"], ["moron", "mo-ron", "mxoron", "table", "a"])
    assert abs(k[0, 0] - 1) < 1e-9
    assert k[0, 0] > k[1, 0] > k[3, 0] and k[2, 0] > k[3, 0]


def test_kernel_equals_brute_force():
    def features(w):
        s = "^" + w + "$"
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["moron", "morn", "banana", "oro"]
    for a in words:
        for b in words:
            x, y = features(a), features(b)
            want = sum(v * y[k] for k, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert abs(toxicity.kernel_with([a], [b])[0, 0] - want) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None)]])
def test_toxicity_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = [r["score"] for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()]
    assert len(scores) == 2 and all(s < 0.5 for s in scores)


def test_quality_classifier_on_held_out_rows(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        words = prose(rng, 50).split()
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_model.fit_quality(d, lab)
    rows = quality_model.score_quality(d, model, ["doc_id"]).join(lab, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)


def test_quality_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "", "x"), (3, None, "x"), (None, "y " * 50_000, "x")],
                                 "doc_id long, text string, score string")
    model = quality_model.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_model.score_quality(docs, model, ["doc_id"]).collect()] == [0.5] * 4
    none = docs.limit(0)
    assert quality_model.score_quality(none, model, ["doc_id"]).count() == 0


def test_ngram_features_by_hand():
    import numpy as np
    import pyarrow as pa

    options = quality_model.QualityOptions(order=2)
    row, bucket, value = quality_model.ngram_features(pa.array(["b a a", "a a", ""]), options)
    assert set(row.tolist()) == {0, 1}
    assert np.isclose(value[row == 0], 1 / 3).all() and np.isclose(value[row == 1], 1 / 2).all()
    assert (row == 0).sum() == 3 + 2 + 3 + 2 + 1  # words, pairs, classes, class pairs, one word seen before
    assert set(bucket[row == 1].tolist()) & set(bucket[row == 0].tolist())

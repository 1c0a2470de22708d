import collections
import math
import re

from pyspark.sql import functions as F

from tidemark.llm import decision_list as D
from tidemark.llm.text_features import FEATURES, with_counts, with_features

ODD = [(-1, None), (-2, ""), (-3, " a b c a b c a b"), (-4, "x"), (-5, "\n\n \n"), (-6, "l 1\nl 1\r\nl 1\n"), (-7, "w " * 4000), (-8, "a b c d a b c " * 2000 + "日 é|*")]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, small):
    texts = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, n_words int")
    want = dict(texts)
    for r in with_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(want[r.doc_id])
    row = with_features(with_counts(df.filter("doc_id = -1"))).first()
    assert all(row[f] == 0 for f in FEATURES)


def test_learns_planted_rules(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        *[F.rand(k).alias(f) for k, f in enumerate(("a", "b", "c"))],
    )
    bad = ((F.col("a") >= 0.7) & (F.col("b") < 0.4)) | (F.col("c") >= 0.9)
    rows = rows.withColumn("target", F.when(bad, 0).otherwise(1)).cache()
    learned = D.learn(rows, ("a", "b", "c"))
    assert 2 <= len(learned.rules) <= 6
    wrong = rows.filter(learned.keeps() != (F.col("target") == 1)).count()
    assert wrong < 0.04 * 3000, [str(r) for r in learned.rules]


def test_learner_is_brute_force(spark):
    """Sequential covering in plain Python over the same thresholds, rows and split gives the same rules."""
    data = spark.range(800).select(F.col("id").alias("doc_id"), *[F.round(F.rand(k + 3) * 20).alias(f) for k, f in enumerate("abc")])
    data = data.withColumn("target", F.when((F.col("a") >= 13) & (F.col("b") < 9) | (F.col("c") >= 19), 0).otherwise(1)).withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0).cache()
    rows = [r.asDict() for r in data.collect()]
    thresholds = D._thresholds(data, ("a", "b", "c"), 40)
    holds = lambda c, r: r[c[0]] >= c[2] if c[1] else r[c[0]] < c[2]
    n = lambda rs, t: sum(r["target"] == t for r in rs)
    rest, want = rows, []
    while len(want) < 12:
        covered, conditions = [r for r in rest if r["grow"]], []
        while len(conditions) < 3 and n(covered, 0) >= 5 and n(covered, 1):
            bad, good, best = n(covered, 0), n(covered, 1), None
            for f, ts in thresholds.items():
                for t in ts:
                    for at_least in (False, True):
                        left = [r for r in covered if holds((f, at_least, t), r)]
                        b, g = n(left, 0), n(left, 1)
                        if b >= 5 and len(left) < len(covered):
                            gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, (f, at_least, t), left
            if best is None or best[0] <= 0:
                break
            conditions.append(best[1])
            covered = best[2]
        if not conditions:
            break
        spared = [r for r in rest if not r["grow"]]
        tried = []
        for k in range(1, len(conditions) + 1):
            fired = [r for r in spared if all(holds(c, r) for c in conditions[:k])]
            tried.append(((n(fired, 0) - n(fired, 1)) / max(1, len(fired)), -k, n(fired, 0), n(fired, 1)))
        worth, k, b, g = max(tried)
        if not b or b < 2.5 or b < 0.9 * (b + g):
            break
        want.append((tuple(conditions[:-k]), b, g))
        rest = [r for r in rest if not all(holds(c, r) for c in conditions[:-k])]
    learned = D.learn(data.drop("grow"), ("a", "b", "c"))
    assert want and [(tuple((c.feature, c.at_least, c.threshold) for c in r.conditions), r.covered_bad, r.covered_good) for r in learned.rules] == want


def test_judge_of_odd_rows(spark):
    rows = [(1, None, 0, "x"), (1, "", 0, "x"), (None, "some words", 0, "x"), (None, "other words", 0, "x"), (2, "w " * 4000, 0, "x"), (2, "w " * 4000, 0, "x"), (3, " ".join(f"w{k}" for k in range(60)), 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rule int, kept string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (None, 1), (9, 0), (2, None)], "doc_id long, quality int")
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept, r.rule) for r in D.judge(df, labels)[0].collect()), key=repr)
    assert got == sorted([(1, 0, True, False, 0), (1, 0, True, False, 0), (None, 2, True, False, 0), (None, 2, True, False, 0), (2, 4000, True, False, 0), (2, 4000, True, False, 0), (3, 60, False, True, 0)], key=repr)


def test_judge(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out, learned = D.judge(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and learned.rules
    for doc_id, text in ((r.doc_id, r.text) for r in docs.collect()):
        n_words, *_, repeated = brute(text)
        assert rows[doc_id].base_failed == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert rows[doc_id].kept == (not rows[doc_id].base_failed and rows[doc_id].rule == 0)
    judged = [(r.quality, rows[r.doc_id].kept, rows[r.doc_id].base_failed) for r in labels.collect()]
    good = [kept for q, kept, failed in judged if q == 1 and not failed]
    low = [kept for q, kept, _ in judged if q == 0]
    assert sum(good) > 0.97 * len(good) and sum(low) < 0.15 * len(low)


def test_empty_tables_and_native(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    out, learned = D.judge(docs, labels.limit(0))
    assert learned.rules == () and out.filter("kept = base_failed").count() == 0
    assert D.judge(docs.limit(0), labels)[0].count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())

import hashlib
import re

from tidemark.llm import digest_index as D


def brute(rows):
    digests = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in rows]
    out = set()
    for i, d in digests:
        ids = [j for j, e in digests if e == d]
        keep = min((j for j in ids if j is not None), default=None)
        out.add((i, keep, len(ids), i == keep, d))
    return out


ROWS = [(3, "a  b"), (1, "a b"), (2, "a\t\n b"), (4, None), (5, ""), (6, " a b"), (6, " a b"), (None, "x"), (7, "x"), (8, "w " * 50000), (9, "é日")]


def test_contract_and_odd_rows(spark):
    df = spark.createDataFrame([(*r, "k", 0) for r in ROWS], "doc_id long, text string, digest string, n int")
    got = D.deduplicate(df, D.fresh_index(spark)).collect()
    assert {tuple(r) for r in got} == brute(ROWS) and len(got) == len(set(ROWS))
    assert D.deduplicate(df.limit(0), D.fresh_index(spark)).count() == 0
    kept = D.drop_duplicates(df, D.fresh_index(spark))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9]


def test_index_persists_and_is_idempotent(spark):
    index = D.fresh_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "a"), (5, "c"), (4, "c"), (2, "b")], "doc_id long, text string")
    kept = lambda docs: sorted(r.doc_id for r in D.deduplicate(docs, index).filter("kept").collect())
    assert kept(first) == [1, 2]
    assert kept(first) == [1, 2]  # ingested again after a failure
    assert kept(second) == [2, 4]  # 2 is the document that the index has; 0 is a copy of what it has
    rows = index.rows().collect()
    assert len(rows) == len({r.digest for r in rows}) == 3
    attached = D.DigestIndex(spark, "attached_index", index.path, index.buckets)  # another session finds the files
    assert {tuple(r) for r in attached.rows().collect()} == {tuple(r) for r in rows}


def test_anti_join_uses_the_buckets(spark):
    index = D.fresh_index(spark)
    D.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index).collect()
    new = spark.createDataFrame([("x", 1)], "digest string, owner_id long")
    plan = new.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1  # the batch alone is shuffled


def test_batches_meet_in_the_index(spark):
    rows = [(k, f"text {k % 7}") for k in range(40)] + [(None, "text 3"), (None, "alone"), (5, "text 5"), (-4, "text 6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3, 10):
        index, sizes = D.fresh_index(spark), []
        plain = index.append_new
        index.append_new = lambda groups, plain=plain, index=index, sizes=sizes: (plain(groups), sizes.append(index.rows().count()))
        got = D.deduplicate(df, index, n_batches=n)
        index.drop()  # the result does not read it
        assert {tuple(r) for r in got.collect()} == brute(rows)
        assert sizes[-1] == 8 and (n == 1 or sizes[0] < 8 and len(sizes) > 1)

from pyspark.sql import functions as F

from sedgeline.operators.resolve import count_tiers, match_tiers, write_back

TIERS = [("one", "a", "a"), ("two", "b", "b")]


def test_tiers_against_all_pairs(spark):
    left = [(1, "x", "p"), (2, "", "p"), (2, "z", "p"), (3, None, "q"), (4, "y", "p"), (4, "x", "q"), (5, "x", None), (5, "x", "r"), (6, "w", "w")]
    right = [(10, "x", "p"), (11, "x", "q"), (11, "y", "q"), (12, "", "p"), (13, None, "p"), (13, None, "p"), (14, "v", "q")]
    want = {}
    for i, (name, *_) in enumerate(TIERS):
        hits = {(x[0], y[0]) for x in left for y in right if x[i + 1] and x[i + 1] == y[i + 1]}
        taken = set(want)
        for u, r in hits:
            if u not in taken:
                want.setdefault(u, (name, set()))[1].add(r)
    lt, rt = spark.createDataFrame(left, "u long, a string, b string"), spark.createDataFrame(right, "r long, a string, b string")
    got = match_tiers(lt, rt, "u", "r", TIERS).collect()
    assert sorted((x.u, x.r, x.basis) for x in got) == sorted((u, r, n) for u, (n, rs) in want.items() for r in rs)
    counted = count_tiers(lt, rt, "u", "r", TIERS).collect()
    assert sorted((x.u, x.n_rows, x.r, x.basis) for x in counted) == sorted((u, len(rs), min(rs), n) for u, (n, rs) in want.items())


def joined_rows(df):
    """Rows that the joins of a run made, at most."""
    df.write.format("noop").mode("overwrite").save()
    seen, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if hasattr(p, "plan") and p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        if "Join" in p.nodeName() and rows.isDefined():
            seen.append(rows.get().value())
    return max(seen, default=0)


def test_shared_keys_make_no_pairs_that_go_unused(spark):
    """500 names of one epithet but of an exact match each, and 500 updates that meet 500 rows by one key."""
    ids = spark.range(500)
    both = ids.select(F.col("id").alias("u"), F.concat(F.lit("k"), "id").alias("a"), F.lit("same").alias("b"))
    assert match_tiers(both, both.withColumnRenamed("u", "r"), "u", "r", TIERS).count() == 500
    assert joined_rows(match_tiers(both, both.withColumnRenamed("u", "r"), "u", "r", TIERS)) <= 2000
    changes, review = write_back(both, both.withColumnRenamed("u", "r"), "u", "r", ["b"])
    assert changes.count() == 0 and review.where("n_rows = 500").count() == 500
    assert joined_rows(review) <= 2000

from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators.replicate import fragment_replicate_join, plan_loads


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def hot_table(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    return spark.range(20000).select(key.alias("key"), F.col("id").alias("value"))


def test_equals_a_plain_left_join(spark):
    left = hot_table(spark)
    right = left.select("key").distinct().filter("key IS NOT NULL AND key <> 'k5'").withColumn("name", F.upper("key"))
    want = rows_of(left.join(right, "key", "left"), ["key", "value", "name"])
    assert rows_of(fragment_replicate_join(left, right, "key", 8), ["key", "value", "name"]) == want


def test_hot_key_is_split_and_tasks_are_even(spark):
    left = hot_table(spark)
    right = left.select("key").distinct().withColumn("name", F.upper("key"))
    joined = fragment_replicate_join(left, right, "key", 8)
    tasks = {r["__task"]: r["n"] for r in joined.groupBy("__task").agg(F.count("*").alias("n")).collect()}
    assert len(tasks) == 8 and max(tasks.values()) < 1.5 * 20000 / 8
    assert joined.filter("key = 'hot'").select("__task").distinct().count() > 1
    plan = joined.groupBy("__task", "key").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange direct") == plan.count("shufflepartitionidpassthrough") or "shufflepartitionidpassthrough" in plan


def test_matching_rows_go_to_shards_only(spark):
    light, heavy = plan_loads(hot_table(spark), "key", 8)
    assert [k for k, _ in heavy] == ["hot"] and 8 <= len(heavy[0][1]) <= 12
    assert len(light) == 4096


def test_empty_sides_and_clashing_names(spark):
    left = hot_table(spark)
    none = left.limit(0)
    right = spark.createDataFrame([("hot", 1, 2)], "key string, value int, value_right int")
    assert fragment_replicate_join(none, right, "key", 4).count() == 0
    out = fragment_replicate_join(left, right.limit(0), "key", 4)
    assert out.count() == 20000 and set(out.columns) == {"__task", "key", "value", "value_right", "value_right_right"}

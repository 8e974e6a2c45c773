import pytest

from fernlake.operators import splits


def manifest(spark, groups):
    return spark.createDataFrame([(f"g{g}_{i}.jpg", f"group_{g:06d}") for g in range(groups) for i in range(1 + g % 3)], "file_name string, group_id string")


@pytest.mark.parametrize("n,want", [(0, (0, 0)), (1, (1, 0)), (2, (1, 0)), (3, (1, 0)), (5, (3, 1)), (5143, (3085, 1028))])
def test_counts(n, want):
    assert splits.group_counts(n) == want


def test_ratios_are_checked():
    for bad in ((0, 0.2), (0.6, -0.1), (0.8, 0.2)):
        with pytest.raises(ValueError):
            splits.check_ratios(*bad)


def test_groups_stay_together(spark):
    m = manifest(spark, 20)
    made = splits.split_groups(m)
    splits.check_split(made, m, m.select("file_name"))
    assert {r["split"]: r["n"] for r in made.join(m, "file_name").groupBy("split").agg(splits.F.count_distinct("group_id").alias("n")).collect()} == {"train": 12, "val": 4, "test": 4}
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, splits.split_groups(m.repartition(3)).collect()))
    assert splits.split_groups(m.limit(0)).count() == 0


def test_violations_are_found(spark):
    m = manifest(spark, 6)
    torn = spark.createDataFrame([(r["file_name"], "train" if i % 2 else "test") for i, r in enumerate(m.collect())], "file_name string, split string")
    assert splits.leaking_groups(torn, m).count() > 0
    with pytest.raises(splits.SplitError, match="several splits"):
        splits.check_split(torn, m, m.select("file_name"))
    with pytest.raises(splits.SplitError, match="without a split"):
        splits.check_split(splits.split_groups(m).limit(2), m, m.select("file_name"))
    with pytest.raises(Exception, match="no split"):
        splits.samples_for_split(m.select("file_name"), torn.limit(1), "train").collect()


def test_downsampling_and_size(spark):
    m = manifest(spark, 20)
    made = splits.split_groups(m)
    less = splits.downsample_train(made, m, max_images_per_group=1)
    assert less.filter("split <> 'train'").count() == made.filter("split <> 'train'").count()
    assert less.filter("split = 'train'").count() == 12
    assert splits.random_split(m, size=10).groupBy("split").count().count() == 3
    assert splits.random_split(m, size=10).count() == 10
    with pytest.raises(ValueError):
        splits.downsample_train(made, m, max_images_per_group=0)


def test_naive_leakage_has_a_row_for_each_trial(spark):
    rows = splits.naive_leakage(manifest(spark, 30), trials=4, seed=7).collect()
    assert sorted(r["trial"] for r in rows) == [7, 8, 9, 10]

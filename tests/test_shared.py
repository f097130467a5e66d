from retromill.shared import materialize, release


def test_release_deletes_what_operators_wrote(spark):
    import os

    release(spark)
    df, facts = materialize(spark.range(10))
    folder = facts["path"].removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(folder.replace("///", "/"))
    assert release(spark) == 1 and not os.path.exists(folder.replace("///", "/")) and release(spark) == 0

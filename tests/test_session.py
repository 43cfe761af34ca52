import os
from urllib.parse import urlparse

from risklens import session as S


def local_path(p):
    return urlparse(p).path


def test_checkpoint_dir_is_reused(spark):
    a = S.ensure_checkpoint_dir(spark)
    assert a and S.ensure_checkpoint_dir(spark) == a


def test_cut_lineage_roundtrip_and_release(spark):
    before = set(S._TABLES)
    t = S.cut_lineage(spark.range(20).selectExpr("id", "id * id AS sq"))
    (path,) = S._TABLES - before
    assert t.count() == 20 and "sq" in t.columns
    derived = t.where("id > 3").selectExpr("sq + 1 AS x")
    assert derived.count() == 16
    S.release(derived)
    assert not os.path.exists(local_path(path))


def test_release_ignores_foreign_frames(spark, tmp_path):
    p = str(tmp_path / "keep")
    spark.range(3).write.parquet(p)
    df = spark.read.parquet(p)
    S.release(df)
    S.release(None)
    assert os.path.exists(p)


def test_append_table_collects_levels(spark):
    path = S.new_table_path(spark)
    for lv in range(3):
        S.append_table(spark.range(2).selectExpr(f"{lv} AS level", "id"), path)
    back = S.read_table(spark, path, "level int, id long")
    assert sorted((r.level, r.id) for r in back.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1),
                                                               (2, 0), (2, 1)]
    S.release(back)
    assert not os.path.exists(local_path(path))

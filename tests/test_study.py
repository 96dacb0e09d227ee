"""The study source on folders of odd files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidview.plans import linear
from braidview.sources import study


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    for profile, genes in (("rna", range(1, 7)), ("cnv", range(3, 7))):
        (tmp_path / profile).mkdir()
        lines = [f"{g},{s},{rng.normal():.6f},x" for s in range(40) for g in genes]
        for part in range(2):
            (tmp_path / profile / f"part-{part}.csv").write_text("entrezGeneId,sampleId,value,note\n" + "\n".join(lines[part::2]) + ("\n" if part else ""))
        (tmp_path / profile / "_SUCCESS").write_text("done")
    (tmp_path / "odd.csv").write_text('sampleId,entrezGeneId,value\n1,7,NA\n2,7,\n3,7,"1.5"\n,7,2\n4,,3\n5,7,low\n')
    (tmp_path / "clinical").mkdir()
    (tmp_path / "clinical" / "c.csv").write_text("sampleId,months\n" + "\n".join(f"{s},{'[none]' if s % 4 == 0 else s * 1.5}" for s in range(40)))
    return str(tmp_path)


NAMES = {"sample": "sampleId", "feature": "entrezGeneId"}


def test_records_and_their_types(spark, folder):
    rows = study.read_study(spark, folder, **NAMES)
    assert [f.dataType.simpleString() for f in rows.schema] == ["string", "bigint", "bigint", "double"]
    assert {r["profile"]: r["count"] for r in rows.groupBy("profile").count().collect()} == {"rna": 240, "cnv": 160, "odd": 6}
    odd = sorted(((r["sample"], r["feature"], r["value"]) for r in rows.where("profile = 'odd'").collect()), key=repr)
    assert odd == sorted([(1, 7, None), (2, 7, None), (3, 7, 1.5), (None, 7, 2.0), (4, None, 3.0), (5, 7, None)], key=repr)
    only = study.read_study(spark, folder, profiles="cnv", **NAMES)
    assert only.select("profile").distinct().collect()[0][0] == "cnv" and only.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("split", [40, 333, 1000])
def test_files_are_cut_at_line_ends(spark, folder, split):
    whole = study.read_study(spark, folder, **NAMES)
    cut = study.read_study(spark, folder, split=str(split), **NAMES)
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert cut.exceptAll(whole).count() == 0 and cut.count() == whole.count()


def test_filters_choose_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = study.read_study(spark, folder, **NAMES)
        assert rows.where("profile = 'odd'").rdd.getNumPartitions() == 1 and rows.where("profile = 'odd' and sample = 3").count() == 1
        assert rows.where("profile in ('odd', 'cnv')").count() == 166 and rows.where("profile = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_texts_stay_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample;feature;value\nS-1;BRCA1;1\nS-2;7;2\n")
    rows = study.read_study(spark, str(tmp_path), delimiter=";")
    assert sorted((r["sample"], r["feature"], r["value"]) for r in rows.collect()) == [("S-1", "BRCA1", 1.0), ("S-2", "7", 2.0)]


def test_views_feed_a_fit(spark, folder):
    rows, views = study.study_views(spark, folder, {"rna": None, "cnv": [3, 4]}, "months", **NAMES)
    assert views == {"rna": [f"rna_{g}" for g in range(1, 7)], "cnv": ["cnv_3", "cnv_4"]}
    assert rows.count() == 30 and rows.agg(F.min("outcome")).first()[0] == 1.5
    f = linear.fit(rows, views, linear.Spec(k=2, iterations=3))
    assert linear.add_scores(rows, f).where("u_1 is null").count() == 0
    sparse = study.sparse_profile(study.read_study(spark, folder, **NAMES), "cnv").orderBy("sample").first()
    assert sparse["cnv"]["at"] == [3, 4, 5, 6] and len(sparse["cnv"]["v"]) == 4


def test_too_many_features_are_named(spark, folder, monkeypatch):
    monkeypatch.setattr(study, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError, match="sparse_profile"):
        study.profile_view(study.read_study(spark, folder, **NAMES), "cnv")

import pytest
from pyspark.sql import functions as F

from pointloom.operators import interpolate


def test_tuning_and_folds_refuse_what_they_would_cut(spark, monkeypatch):
    monkeypatch.setattr(interpolate, "MOST_SITES", 30)
    sites = spark.range(31).select("id", ((F.col("id") * 37 % 31) / 31.0).alias("x0"), F.sin("id").alias("d"))
    for how in ({"sigma": "auto"}, {"eps": "auto", "phi": "se"}):
        with pytest.raises(ValueError, match="too many"):
            interpolate.RBFInterpolant(sites, neighbors=5, **how)
    with pytest.raises(ValueError, match="more than 30"):
        interpolate.cross_validate(sites, 3)
    assert interpolate.cross_validate(sites.where("id < 30"), 3).count() == 3
    assert interpolate.RBFInterpolant(sites, neighbors=5)(sites).count() == 31

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import plugins
from pulseloom.sources import sinks


def test_results_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "record long, f1 double")
    for model in ("a", "b", "a"):
        sinks.append_results(rows, str(tmp_path / "r"), model)
    assert sorted(r.model for r in sinks.read_results(spark, str(tmp_path / "r")).collect()) == ["a", "b"]
    sinks.metric_table(rows, str(tmp_path / "m"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "m")).first().f1 == "0.5"


def test_nested_export_and_queue(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, "V", None), (1, 0, 1.0, "N", 3.0)], "record long, i long, t double, kind string, value double")
    doc = json.loads(sinks.nested(rows).first().doc)
    assert doc == {"id": 1, "beats": [{"t": 1.0, "kind": "N", "value": 3.0}, {"t": 2.0, "kind": "V", "value": None}]}
    queue = spark.createDataFrame([(i, "unprocessed" if i % 2 else "processed") for i in range(20)], "record long, status string")
    first = sinks.claim(queue, 4)
    assert {r.record for r in first.collect()} == {r.record for r in sinks.claim(queue, 4).collect()}
    left = sinks.finished(queue, first)
    assert left.where("status = 'unprocessed'").count() == 6


def test_plugins(spark):
    @plugins.transform("scale")
    def scale(df, by):
        return df.withColumn("v", F.col("v") * by)

    with pytest.raises(ValueError):
        plugins.transform("scale")(scale)
    assert plugins.chain(spark.createDataFrame([(2.0,)], "v double"), [("scale", {"by": 3}), ("scale", {"by": 2})]).first().v == 12
    with pytest.warns(UserWarning):
        assert plugins.toggles({"NSR": True, "AFIB": True}, {"AFIB": False, "X": True}) == {"NSR": True, "AFIB": False}
    waves = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], "record long, x array<double>")
    got = plugins.predict(waves, lambda: lambda xs: [float(np.mean(x)) for x in xs])
    assert {r.record: r.y for r in got.collect()} == {1: 1.5, 2: 4.0}
    assert plugins.route({"II"}) == "one" and plugins.route({"II", "V1", "V6"}) == "three" and plugins.route({"I", "II", "III"}) == "one"
    with pytest.raises(ValueError):
        plugins.route({"I", "V1", "V6"})

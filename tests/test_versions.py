"""Publication as a whole or not at all, and the import of captures that uses it."""

import pytest
from pyspark.sql import functions as F

from attest.plans.captures import CAPTURE_DIMENSIONS, capture_import
from attest.sources.versions import publish, published

NAMES = [(v, t) for v in CAPTURE_DIMENSIONS["viewport"] for t in CAPTURE_DIMENSIONS["theme"]]


def test_readers_see_the_old_version_until_the_new_one_is_judged(spark, tmp_path):
    path = str(tmp_path / "table")
    positive = {"positive": lambda t: t["rows"].where("n <= 0")}
    assert published(spark, path, "rows") is None
    refused = publish(spark, path, {"rows": spark.createDataFrame([(0,)], "n int")}, positive)
    assert (refused.version, refused.failed) == (None, ("positive",)) and published(spark, path, "rows") is None
    # What was refused can be looked at.
    assert spark.read.parquet(f"{refused.stage}/rows").collect() == [(0,)]
    first = publish(spark, path, {"rows": spark.createDataFrame([(1,)], "n int")}, positive)
    reader = published(spark, path, "rows")
    assert publish(spark, path, {"rows": spark.createDataFrame([(-2,)], "n int")}, positive).version is None
    assert published(spark, path, "rows").collect() == [(1,)]
    second = publish(spark, path, {"rows": spark.createDataFrame([(2,)], "n int")}, positive)
    assert (first.version, second.version) == (1, 2)
    assert published(spark, path, "rows").collect() == [(2,)]
    # A reader that began before keeps what it began with.
    assert reader.collect() == [(1,)]


def test_a_writer_that_dies_before_its_pointer_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "table")

    def dies(tables):
        raise RuntimeError("lost")

    publish(spark, path, {"rows": spark.range(3)}, {})
    with pytest.raises(RuntimeError):
        publish(spark, path, {"rows": spark.range(5)}, {"dies": dies})
    assert published(spark, path, "rows").count() == 3


def test_an_empty_table_is_published_with_its_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    assert publish(spark, path, {"rows": spark.createDataFrame([], "a string, b int")}, {}).version == 1
    assert published(spark, path, "rows").columns == ["a", "b"]


def given(spark, states=("log-in", "sign-up"), captures=None, outcomes=("expected",)):
    if captures is None:
        captures = [(s, v, t, "browser", 5, f"{s}/{v}-{t}") for s in states for v, t in NAMES]
    return (
        spark.createDataFrame([(s, "browser") for s in states], "state string, evidence string"),
        spark.createDataFrame(captures, "state string, viewport string, theme string, evidence string, at int, file string"),
        spark.createDataFrame([(o,) for o in outcomes], "outcome string"),
    )


def run(spark, path, tables):
    return capture_import(spark, path, *tables, "state", evidence="evidence", taken_at="at", file="file", outcome="outcome", started_at=F.lit(5))


def test_a_whole_import(spark, tmp_path):
    path = str(tmp_path / "captures")
    assert run(spark, path, given(spark)).version == 1
    states = {r["state"]: r["captures"] for r in published(spark, path, "states").collect()}
    assert states["log-in"] == {f"{v}-{t}": f"log-in/{v}-{t}" for v, t in NAMES} and set(states) == {"log-in", "sign-up"}
    assert published(spark, path, "totals").collect() == [(2, 16)]


def changed(row, i):
    whole = [("log-in", v, t, "browser", 5, "f") for v, t in NAMES]
    return [*whole[:i], *row, *whole[i + 1:]]


@pytest.mark.parametrize("case, failed", [
    ({"outcomes": ("expected", "flaky")}, ("report",)),
    ({"outcomes": ("expected", "skipped")}, ("report",)),
    ({"outcomes": ("error", "expected")}, ("report",)),
    ({"outcomes": ()}, ("report",)),
    ({"states": ("log-in", "Log in 2")}, ("ids",)),
    ({"states": ("log-in",), "captures": changed([], 3)}, ("captures",)),
    ({"states": ("log-in",), "captures": changed([("log-in", *NAMES[3], "browser", 5, "a"), ("log-in", *NAMES[3], "browser", 5, "b")], 3)}, ("captures",)),
    ({"states": ("log-in",), "captures": changed([("log-in", *NAMES[3], "manual", 5, "f")], 3)}, ("captures",)),
    ({"states": ("log-in",), "captures": changed([("log-in", *NAMES[3], "browser", 4, "f")], 3)}, ("captures",)),
    ({"states": ("log-in",), "captures": changed([("log-in", *NAMES[3], "browser", None, "f")], 3)}, ("captures",)),
])
def test_nothing_is_shown_of_an_import_that_a_gate_refuses(spark, tmp_path, case, failed):
    path = str(tmp_path / "captures")
    result = run(spark, path, given(spark, **case))
    assert (result.version, result.failed) == (None, failed)
    assert published(spark, path, "states") is None

"""Every check of an evidence index, one fault at a time."""

import pytest
from pyspark.sql import types as T

from attest.plans.screens import evidence_problems

LONG = "d" * 200
STEP = T.StructType([T.StructField(c, T.StringType()) for c in ("to", "action", "confidence")])
SCHEMA = T.StructType([T.StructField("index", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("id", "description", "title", "summary", "category")],
                       T.StructField("controls", T.ArrayType(T.StringType())), T.StructField("transitions", T.ArrayType(STEP))])
SOUND = [(i, f"S-00{i}", LONG, "t", "s", "c", [], [(f"S-00{1 - i}", "tap", "inferred")]) for i in range(2)]
JOURNEYS = [(0, "first", ["S-000", "S-001"])]
FILES = ["a 0.png", "b 1.png", "c 1.jpg", "c11.png"]


def problems(spark, screens=SOUND, journeys=JOURNEYS, files=FILES, expected=2):
    found = evidence_problems(
        spark.createDataFrame(screens, SCHEMA), spark.createDataFrame(journeys, "position int, title string, nodes array<string>"),
        spark.createDataFrame([(f,) for f in files], "file string"), "file", expected, prefix="S-")
    return sorted(tuple(r) for r in found.collect())


def test_a_sound_index_has_no_problem(spark):
    assert problems(spark) == []


def without_transitions(i, screen_id):
    return (i, screen_id, LONG, "t", "s", "c", [], None)


@pytest.mark.parametrize("case, expected", [
    ({"expected": 3}, [("count", None, 2)]),
    ({"files": FILES[1:]}, [("no_file", "S-000", 1)]),
    ({"journeys": [(0, "first", ["S-000"])]}, [("uncovered", "S-001", 1)]),
    ({"journeys": [*JOURNEYS, (1, "x", ["S-007", "S-007"])]}, [("unknown_member", "S-007", 2)]),
    ({"screens": [SOUND[0], SOUND[0]], "journeys": [(0, "first", ["S-000"])]},
     [("duplicate_id", "S-000", 2), ("unknown_target", "S-001", 2)]),
    ({"screens": [without_transitions(0, "S-000"), (1, "S-001", LONG, "t", "s", "c", [], [("S-000", "", "seen")])]},
     [("rule_action", "S-001", 1), ("rule_confidence", "S-001", 1)]),
    ({"screens": [without_transitions(0, "S-000"), without_transitions(2, "S-002")], "journeys": [(0, "first", ["S-000", "S-002"])]},
     [("no_file", "S-002", 1), ("rule_index", "S-002", 1)]),
    ({"screens": [], "journeys": [], "files": []}, [("count", None, 0)]),
])
def test_each_fault_is_named(spark, case, expected):
    assert problems(spark, **case) == expected

import pytest

from clauseframe.operators.levels import infer_levels
from clauseframe.operators.score import KEEP, score_ordinals


@pytest.mark.parametrize(
    ("ords", "scores"),
    [
        ([1], [-2.0]),
        ([1, 2], [-2.0, -2.0]),
        ([20], [-7.0]),
        ([1, 2, 3], [11.9555, 18.0555, 10.6555]),
        (list(range(1, 11)), [34.1189, *(34.6189 + p for p in range(2, 10)), 41.6189]),
        ([*range(1, 8), 20], [22.7453, *(23.2453 + p for p in range(2, 7)), 27.2453, -8.8]),
        ([], []),
    ],
)
def test_scores(ords, scores):
    assert score_ordinals([(x,) for x in ords]) == pytest.approx(scores, abs=1e-4)


def test_long_and_repeated_sequences_end():
    got = score_ordinals([(1 + i % 50,) for i in range(2000)])
    assert len(got) == 2000 and sum(s >= KEEP for s in got) > 500


@pytest.mark.parametrize(
    ("types", "levels"),
    [
        ([], []),
        (["章"], [("章", 0)]),
        (["条"] * 3, [("条", 0)]),
        (["章", "条", "条"], [("章", 0), ("条", 1)]),
        (["章", "条", "条", "项"], [("章", 0), ("条", 1), ("项", 1)]),
        (["章", "条", "条", "章", "条", "条"], [("章", 0), ("条", 1)]),
    ],
)
def test_levels(types, levels):
    assert infer_levels(types) == levels

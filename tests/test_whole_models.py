"""The registered model queries train the whole model."""

import inspect

import pytest

from kinloom import catalog
from kinloom.operators import model

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gbt_scores", "feature_importance"])
def test_all_trees_are_grown(spark, monkeypatch, name):
    """600 trees of depth 7 on all 46 features are asked for; two are grown here."""
    asked, train = [], model.train

    def spied(*args, **more):
        call = inspect.signature(train).bind(*args, **more)
        call.apply_defaults()
        asked.append((call.arguments["trees"], call.arguments["depth"], len(call.arguments["names"]), call.arguments["validation"]))
        call.arguments["trees"] = 2
        return train(*call.args, **call.kwargs)

    monkeypatch.setattr(model, "train", spied)
    assert catalog.queries()[name](spark, SF).count() > 0
    assert asked == [(600, 7, 46, None)]

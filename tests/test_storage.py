import importlib
import pkgutil

import pytest
from pyspark import cloudpickle

import gapweave


@pytest.mark.parametrize("name", [m.name for m in pkgutil.walk_packages(gapweave.__path__, "gapweave.")])
def test_modules_travel_to_tasks(name):
    """Modules are pickled by value: what one holds besides functions must be picklable too."""
    assert cloudpickle.dumps(importlib.import_module(name))


def test_plans_travel_while_stages_are_known(spark):
    from gapweave.plans import stages

    kept = stages.stages(spark, "/somewhere")
    try:
        assert cloudpickle.dumps(importlib.import_module("gapweave.plans"))
        assert stages.stages(spark, "/somewhere") is kept
    finally:
        stages._MEMO.pop((spark.sparkContext.applicationId, "/somewhere"))

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_oracle import session  # noqa: E402
from jamscope.plans.order_trips import order_trip_config, order_trips  # noqa: E402
from jamscope.plans.study import TripStudy  # noqa: E402
from jamscope.staging import StagingArea  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return session("8")


@pytest.fixture(scope="session")
def staging(spark):
    return StagingArea(spark)


@pytest.fixture(scope="session")
def small_study(spark, staging):
    """The order-derived trips at the smallest scale, where a route needs 10 trips."""
    view = order_trips(spark, f"{TESTDATA}/sf0.001")
    return TripStudy.of_view(view, order_trip_config(), staging)

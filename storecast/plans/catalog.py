"""Imports every query module so that the registry is complete."""

from storecast.plans import core_queries  # noqa: F401
from storecast.plans.registry import ORACLE, QUERIES  # noqa: F401
from storecast.plans import explore_queries  # noqa: F401,E402
from storecast.plans import stats_queries  # noqa: F401,E402
from storecast.plans import basket_queries  # noqa: F401,E402
from storecast.plans import segment_queries  # noqa: F401,E402
from storecast.plans import forecast_queries  # noqa: F401,E402
from storecast.plans import anomaly_queries  # noqa: F401,E402
from storecast.plans import planning_queries  # noqa: F401,E402
from storecast.plans import stream_queries  # noqa: F401,E402
from storecast.plans import source_queries  # noqa: F401,E402

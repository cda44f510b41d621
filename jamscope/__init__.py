"""jamscope: trip-congestion analytics as Spark DataFrame jobs.

Everything in the package takes and returns DataFrames; column names and
thresholds come from :class:`jamscope.config.StudyConfig`.
"""

from jamscope.config import CleaningRules, ColumnMap, ModelSettings, StudyConfig
from jamscope.plans.study import TripStudy

__version__ = "1.0.0"

__all__ = ["CleaningRules", "ColumnMap", "ModelSettings", "StudyConfig", "TripStudy"]

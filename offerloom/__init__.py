"""Offer matching on Spark: clean, retire, embed, match and report job offers."""

import sys

from pyspark import cloudpickle

from offerloom.config import EngineConfig
from offerloom.session import build_session, shared_dir

# Functions of this package travel inside the plans that use them, so executors
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig", "build_session", "shared_dir"]

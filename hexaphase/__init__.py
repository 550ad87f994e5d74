"""hexaphase: Spark-native analytics for multichannel sensor-array time series.

Functions that run on executors are pickled by value, so that a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

from .config import Settings
from .interfaces import AudioDecoder, AudioSource, DirectionScanner, DirectionTracker, HotmapSource
from .model import ProjectConfig, RateConfig, ScanConfig, TrackerConfig

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
__all__ = ["AudioDecoder", "AudioSource", "DirectionScanner", "DirectionTracker", "HotmapSource", "ProjectConfig", "RateConfig", "ScanConfig", "Settings", "TrackerConfig"]

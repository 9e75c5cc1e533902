"""terrane: a PySpark-native address matching, geocoding and corpus engine.

The parts that a program needs are names of this package: `Geocoder`, `Gazetteer`,
`geocode`, `geocode_stream`, `TARGETS`, `FUZZY`, `FORMATS`, `formatted`, `read_lines`,
`comment_filtered`, `load`, `read`, `session`.

Functions that run in Python workers are pickled by value, so that executors
need not have this package installed.
"""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WHERE = {
    "Geocoder": "plans.geocode",
    "Gazetteer": "plans.geocode",
    "geocode": "plans.geocode",
    "TARGETS": "plans.geocode",
    "geocode_stream": "streaming.geocode",
    "FUZZY": "functions.constants",
    "FORMATS": "sources.sinks",
    "formatted": "sources.sinks",
    "read_lines": "sources.lines",
    "comment_filtered": "sources.lines",
    "load": "sources.gazetteer",
    "read": "sources.gazetteer",
    "session": "session",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    found = getattr(importlib.import_module(f"terrane.{_WHERE[name]}"), name)
    globals()[name] = found
    return found

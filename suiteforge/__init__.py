"""suiteforge: outcome-matrix analytics and test-suite curation on Spark DataFrames."""

import sys as _sys

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's functions to Python workers by value.

    The user hooks run in ``mapInPandas``; their wrappers live in this
    package.  Pickling the package by value means workers need neither the
    package on their path nor any shipped files.
    """
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
        pass


_pickle_by_value()

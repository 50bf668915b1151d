"""Operators of a training-data pipeline over documents, pages and labels."""

from pyspark import cloudpickle

import fleetgauge

# Functions go to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(fleetgauge)

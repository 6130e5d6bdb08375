"""Audit jobs over large collections of agent-skill documents, written as Spark DataFrame and SQL jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that Spark ships to its workers travel with their code, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Python functions bound to the running Spark application."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession


def per_application(make):
    """Build a function once per argument list and application: a function object made
    under a stopped application must not be used in the next one."""
    made: dict = {}

    @functools.wraps(make)
    def get(*args):
        session = SparkSession.getActiveSession()
        if session is None:
            return make(*args)
        key = (session.sparkContext.applicationId, *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get

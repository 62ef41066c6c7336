from datetime import date, datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

OBS = "series_id string, source string, date string, value double, release_date string"


def d(text):
    return date.fromisoformat(text)


def ts(text):
    return datetime.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def breaks(action, match):
    """The action fails, when built or when run, with a message holding ``match``."""
    with pytest.raises((ValueError, PySparkException, Py4JJavaError)) as caught:
        result = action()
        if hasattr(result, "collect"):
            result.collect()
    assert match in str(caught.value), str(caught.value)[:800]

"""Intermediate tables on the shared folder."""

import os

from scoreline.llm.common import staged


def test_no_marker_is_left(spark):
    df = staged(spark.range(10), "plain")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert df.count() == 10 and not [f for f in os.listdir(folder) if "_SUCCESS" in f]
    assert staged(spark.range(0), "empty").count() == 0

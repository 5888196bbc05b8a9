"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tunedata-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared checkpoint folder.

    Only a session on one machine (tests) does without: it gets a local folder, and its settings stay as
    they are. On a cluster that names no shared folder this is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/tunedata-{name}-{uuid.uuid4().hex}"


@contextmanager
def case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Column names that differ only in case stay apart inside this block."""
    option = "spark.sql.caseSensitive"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.set(option, before)

"""Session helper: the settings that the engine's queries assume."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def session(name: str = "siftwell", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; where none is set and all run here, in one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="siftwell-")
            atexit.register(shutil.rmtree, _own[app], True)
        root = "file://" + _own[app]
    return f"{root.rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"

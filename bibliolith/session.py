"""Session defaults, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def local_session(name: str = "bibliolith", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's modules, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bibliolith-")) / "bibliolith_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset: a temporary folder if driver and executors are one
    process, as in tests, and else one in the warehouse, which they share."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if context.applicationId not in _OWN:
        one_process = context.master == "local" or context.master.startswith("local[")
        own = "file://" + tempfile.mkdtemp(prefix="bibliolith-") if one_process else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        _OWN[context.applicationId] = own
    return _OWN[context.applicationId]


def delete_with_the_driver(spark: SparkSession, path: str) -> None:
    """Files that results of this application still read go when its driver ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)

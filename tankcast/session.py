"""Spark session and shared-folder helpers.

The library never creates its own cluster configuration: jobs receive a
session.  ``build_session`` exists for tests, the bench and local runs only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session used by this library should have.  AQE re-plans joins
# (broadcast only when the runtime size is below the threshold), coalesces
# small shuffle partitions and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "tankcast",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, default_root: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach, and we
    only read it; unset on a cluster it is an error.  In local mode a fresh folder is made under
    ``default_root`` (or the system temp dir) and registered on the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no JVM context: the configured folder is all we have
        return path or ""
    if not path:
        path = sc.getCheckpointDir()
    if not path and not default_root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        root = default_root or tempfile.gettempdir()
        os.makedirs(root, exist_ok=True)
        path = tempfile.mkdtemp(prefix="tankcast-ckpt-", dir=root)
        sc.setCheckpointDir(path)
        try:  # core settings may be read-only at runtime; the context has it now
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001
            pass
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables/state."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back
    (reliable ``checkpoint``, never a local one): cuts the lineage of a small,
    expensive intermediate -- e.g. a model table -- that a plan reads twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tankcast`` importable in executor Python workers (pandas UDFs
    refer to functions of this package).  The package is zipped once per
    driver process and distributed by Spark with ``addPyFile``; a deployment
    that installs the package on executors can skip this (it is idempotent)."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no JVM context (e.g. Spark Connect): install the package instead
        return
    tag = sc.applicationId
    if tag in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="tankcast-pyfiles-")
    zpath = os.path.join(out_dir, "tankcast.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(tag)

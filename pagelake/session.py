"""Session helpers: building a local session, reliable lineage cuts, sizing."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "pagelake", **conf: str) -> SparkSession:
    """A local session for tests and bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (a local test session) a fresh temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="pagelake-ckpt-")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application.

    Tasks that run selectors import it; on a cluster it reaches every executor this way.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pagelake-ship-")) / "pagelake.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: The JVM's command, as its management beans name it.
TRIM = "systemTrimNativeHeap"


def give_back(spark: SparkSession, share: float = 0.5) -> tuple[bool, bool]:
    """Let the driver's JVM return memory that it no longer uses; tells whether its heap and its other memory were asked.

    Many small plans leave garbage that the JVM would rather grow for; it is collected once the heap
    has grown to a share of what it may be. Compilers and threads leave pieces with the C library,
    which the JVM's own command ``System.trim_native_heap`` hands on; not every JVM has it.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    heap = jvm.java.lang.Runtime.getRuntime()
    grown = heap.totalMemory() >= share * heap.maxMemory()
    if grown:
        jvm.java.lang.System.gc()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # By the interface: Py4J looks at the server's own class, which its module does not open.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = commands, TRIM
    try:
        call.invoke(server, given)
    except Py4JJavaError:
        return grown, False
    return grown, True


def byte_count(size: str) -> int:
    """A size setting (``128m``, ``1GB``, ``134217728b``) in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * (" kmgtp".index(unit) if unit else 0)


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before costly Python work.

    A table of one file with one row group is read by one task. Where the whole input is
    too small to give every core a scan task, it is dealt out evenly first, which moves
    less than one scan split per core; a large input already has enough tasks and is left
    as it is.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = byte_count(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if cores > 1 and size < cores * split else df


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    of_day = (
        F.hour(ts).cast("bigint") * 3600 + F.minute(ts).cast("bigint") * 60 + F.second(ts)
    ) * 1_000_000
    return days * 86_400_000_000 + of_day + F.date_format(ts, "SSSSSS").cast("bigint")

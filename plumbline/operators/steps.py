"""Steps of iterative operators, written to the folder that the cluster shares and reread, and link contraction on top of them.

A step's files stay while a plan may still read them: ``drop`` removes what nothing reads any more, and what is left goes
when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _left.pop(path)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_left):
        _remove(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.gettempdir()
    return base.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and reread; joins with it are by merging.

    Ids and pixels in order take a few bits a row in a file, so a join that goes by the file's size would collect and
    broadcast millions of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-step-{uuid.uuid4().hex[:12]}"
    _left[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._plumbline_path = path
    return out


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` over as many partitions as shuffles have, by ``cols``: before a Python kernel, whose work a few bytes of input hide
    from what joins small partitions, and from the size of a file's splits."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *cols)


def drop(*tables: DataFrame) -> None:
    """Removes steps that nothing reads any more."""
    for df in tables:
        _remove(df._plumbline_path)


def contract(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root): the smallest node reachable, for each node of links(by, u, v); nodes of any type with an order.

    Each round points every node at the smallest of itself and its neighbours and rewrites the links between the nodes
    pointed at, until none is left. All steps are equi-joins and partial aggregates; a table without links gives none.
    """
    live = saved(links.where("u <> v").select(*by, "u", "v").distinct())
    rounds = []
    while not live.isEmpty():
        both = live.unionByName(live.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        parent = saved(both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("p")))
        rounds.append(parent)
        more = live.join(parent.toDF(*by, "u", "pu"), [*by, "u"]).join(parent.toDF(*by, "v", "pv"), [*by, "v"]).where("pu <> pv")
        done, live = live, saved(more.select(*by, F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        drop(done)
    if not rounds:
        return live.toDF(*by, "node", "root")
    drop(live)
    # A round holds only the nodes that still had links, so roots are named from the last round back, each joined once.
    last = rounds.pop()
    roots = last.toDF(*by, "node", "root")
    while rounds:
        parent = rounds.pop()
        named = parent.toDF(*by, "node", "p").join(roots.toDF(*by, "p", "root"), [*by, "p"], "left").select(*by, "node", F.coalesce("root", "p").alias("root"))
        past, roots = last, saved(named)
        drop(past, parent)
        last = roots
    return roots

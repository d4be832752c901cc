"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: The characters that count as white space in every text contract: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: One word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage the way ``checkpoint()`` does (a lost executor costs nothing that was
    written), but columnar and compressed, so later branches read only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was made of them is written itself."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="rfrank-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def without_white(text: Column) -> Column:
    """``text`` with every white-space character deleted.

    One ``replace`` per character works on bytes and is several times faster than a regular expression.
    """
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")

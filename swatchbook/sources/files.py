"""Single files written from the rows of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame


def write_files(df: DataFrame, folder: str, name: str, content: str) -> int:
    """Write the binary column ``content`` of each row to ``folder/<name>``; returns the number of files.

    ``folder`` must be reachable by all executors. A task that runs again
    writes the same files again.
    """
    spark = df.sparkSession
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")

    def write(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for block in blocks:
            for target, data in zip(block[name], block[content], strict=True):
                path = f"{root}/{target}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(block)]})

    return df.select(name, content).mapInPandas(write, "n bigint").groupBy().sum("n").first()[0] or 0

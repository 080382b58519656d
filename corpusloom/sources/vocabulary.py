"""Vocabulary files, wherever Hadoop's file systems reach: JSON in both layouts, and the sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_vocabulary(spark: SparkSession, path: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """(token_id, token) of ``{token: id}`` or ``{"vocab": {id: token}}``; of double tokens or ids the last counts.

    ``path`` is tried as it is, then by its name in ``folders``. A vocabulary is a bounded table.
    """
    for at in [path, *(f"{f}/{path.rsplit('/', 1)[-1]}" for f in folders)]:
        fs, place = _place(spark, at)
        if fs.exists(place):
            break
    else:
        raise FileNotFoundError(path)
    data = json.loads(spark.read.text(at, wholetext=True).first()[0])
    if isinstance(data.get("vocab"), dict):
        ids = {int(i): t for i, t in data["vocab"].items()}
    else:
        ids = {int(i): t for t, i in data.items()}
    by_token = {t: i for i, t in sorted(ids.items())}
    return spark.createDataFrame(sorted((i, t) for t, i in by_token.items()), "token_id int, token string")


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """``{token: id}`` in the order of ids, ASCII-escaped, indented by 2; of equal tokens the later id counts. One file."""
    table = {r["token"]: r["token_id"] for r in vocabulary.orderBy("token_id").toLocalIterator()}
    fs, place = _place(vocabulary.sparkSession, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(json.dumps(table, ensure_ascii=True, indent=2).encode("ascii")))
    finally:
        out.close()

"""Read text documents from local folders or object stores."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.text import strip
from scorelake.schemas import DOCUMENTS

# Suffixes of readable documents.
SUFFIXES = (".txt", ".md")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def _files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Files below a path that are documents by their name, as Spark's reader lists them: in parallel, without opening any."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}")
        .load(path)
    )
    return files.filter(_suffix(F.col("path")).isin(*SUFFIXES))


def _source() -> Column:
    return F.regexp_replace(F.regexp_replace("path", r"^file:(?://)?(?=/)", ""), r"^s3[an]://", "s3://")


def _documents(files: DataFrame) -> DataFrame:
    return files.select(
        strip(F.make_valid_utf8(F.col("content").cast("string"))).alias("content"),
        F.substring_index("path", "/", -1).alias("filename"),
        _source().alias("source"),
    )


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Documents below a path: ``content``, ``filename`` and ``source``.

    ``path`` may be a file, a folder or an object-store path (see ``object_store_path``). Files with other suffixes are passed over by the listing,
    their content is never read. Bytes that are not UTF-8 become replacement characters. Rows are not sorted: ``source``
    is the order, and the operators that need one (quotas) sort narrow columns by it rather than whole documents.
    """
    return _documents(_files(spark, path, recursive))


def object_store_path(uri: str) -> str:
    """Reader path for a URI such as ``s3://bucket/prefix``: every key that starts with the prefix."""
    scheme, mark, rest = uri.partition("://")
    if not mark or not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme):
        raise ValueError(f"an object-store URI starts with a scheme, such as s3://: {uri!r}")
    place, _, prefix = rest.partition("/")
    return f"{'s3a' if scheme == 's3' else scheme}://{place}/{_escaped(prefix)}*"


def list_documents(spark: SparkSession, uri: str) -> DataFrame:
    """Keys below a URI: ``source``, ``path``, ``bytes`` and ``modified``. No object is opened; an unknown prefix has none."""
    try:
        files = _files(spark, object_store_path(uri))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "source string, path string, bytes long, modified timestamp")
    return _listed(files)


def _listed(files: DataFrame) -> DataFrame:
    return files.select(_source().alias("source"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def scan_objects(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """Keys below a URI, as ``list_documents`` gives them, and their documents, as ``read_documents`` does: the store is listed once for both.

    An unknown prefix is an error.
    """
    files = _files(spark, object_store_path(uri))
    return _listed(files), _documents(files)


def next_documents(spark: SparkSession, uri: str, after: str = "", limit: int = 1000) -> DataFrame:
    """The next page of a URI's documents: the ``limit`` first by key behind the ``source`` that a page ended with.

    Keys are ranked on the tasks that list them; only the page's paths, ``limit`` at most, reach the driver, and only its objects are opened.
    """
    keys = list_documents(spark, uri).filter(F.col("source") > after).orderBy("source").limit(limit)
    paths = [_escaped(r["path"]) for r in keys.select("path").collect()]
    return _documents(_files(spark, paths)) if paths else spark.createDataFrame([], DOCUMENTS)


def _escaped(path: str) -> str:
    """A path as a glob of itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def require_documents(documents: DataFrame, path: str) -> DataFrame:
    """Fail when nothing was found."""
    if documents.isEmpty():
        raise ValueError(f"no supported files found in {path}; supported: {', '.join(sorted(SUFFIXES))}")
    return documents


def check_source(documents: DataFrame) -> DataFrame:
    """Any table with content, filename and source is a document source; others are refused."""
    wanted = [part.split()[0] for part in DOCUMENTS.split(", ")]
    types = dict(documents.dtypes)
    wrong = [c for c in wanted if types.get(c) != "string"]
    if wrong:
        raise TypeError(f"a document source needs string columns {wanted}; missing or of another type: {wrong}")
    return documents.select(*wanted)

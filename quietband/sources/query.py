"""Read-only SQL as a source: registered views or a JDBC database."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statements that change data or rights.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE")
_WRITES = re.compile(rf"\b({'|'.join(WRITE_WORDS)})\b", re.IGNORECASE)
_READS = re.compile(r"\s*(SELECT|WITH)\b", re.IGNORECASE)


class QueryRejected(ValueError):
    """Only reading statements are run."""


def check_read_only(query: str) -> None:
    found = _WRITES.search(query)
    if found:
        raise QueryRejected(f"{found.group(0).upper()} is not permitted")
    if not _READS.match(query):
        raise QueryRejected("a query must start with SELECT or WITH")


def read_query(
    spark: SparkSession,
    query: str,
    url: str | None = None,
    max_rows: int | None = None,
    **jdbc_options,
) -> DataFrame:
    """Run a query in the database behind ``url``, or over registered views.

    JDBC options such as ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` are passed through and split the read into tasks; ``max_rows``
    becomes a limit that Spark pushes down where it can.
    """
    check_read_only(query)
    query = query.strip().rstrip(";")
    if url is None:
        rows = spark.sql(query)
    else:
        rows = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **jdbc_options).load()
    return rows if max_rows is None else rows.limit(max_rows)

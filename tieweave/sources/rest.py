"""Reading REST registers into a landing zone: one row for each request, failures included.

Requests are rows, so what is asked, what came back and what failed are tables like any
other, and a load can be taken up again from the rows that failed. Each partition asks one
after the other with a pause; the number of partitions is the number of clients, one by
default, as registers limit their callers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAUSE, WAIT, TRIES, TIMEOUT = 0.25, 5.0, 5, 60


def _ask(url: str, user: str | None, wait: float) -> tuple[int | None, str | None, str | None]:
    """(status, body, error) of one request; busy servers are asked again."""
    import base64
    import time
    import urllib.error
    import urllib.request

    headers = {"Accept": "application/json"}
    if user is not None:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:".encode()).decode()
    for tried in range(1, TRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:
                return answer.status, answer.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return 404, None, None
            if error.code != 429 or tried == TRIES:
                return error.code, None, str(error)
            time.sleep(wait)
        except OSError as error:
            return None, None, str(error)
    return None, None, "not reached"


def _asked(requests: DataFrame, user: str | None, pause: float, wait: float) -> DataFrame:
    """``requests`` with status, body and error of their ``url``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            answers = []
            for url in batch["url"]:
                answers.append(_ask(url, user, wait))
                time.sleep(pause)
            own = pd.DataFrame(answers, columns=["status", "body", "error"])
            yield pd.concat([batch.reset_index(drop=True), own.astype({"status": "Int64"})], axis=1)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{fields}, status long, body string, error string")


def fetched(keys: DataFrame, url: str, *, user: str | None = None, clients: int = 1, pause: float = PAUSE, wait: float = WAIT) -> DataFrame:
    """(key, url, status, body, error) for each key; ``{key}`` in ``url`` is replaced by it, escaped.

    user: name for basic authentication, without a password. 404 is an answer without a body.
    """
    before, _, after = url.partition("{key}")
    escaped = F.replace(F.url_encode("key"), F.lit("+"), F.lit("%20"))
    asked = keys.select("key", F.concat(F.lit(before), escaped, F.lit(after)).alias("url")).repartition(clients)
    return _asked(asked, user, pause, wait)


def paged(spark: SparkSession, url: str, total: int, *, take: int = 20, user: str | None = None, clients: int = 1, pause: float = PAUSE, wait: float = WAIT) -> DataFrame:
    """(skip, url, status, body, error) for each page of ``take`` of ``total``; ``{skip}`` and ``{take}`` in ``url`` are replaced."""
    skips = spark.range(0, total, take, clients).withColumnRenamed("id", "skip")
    own = F.replace(F.replace(F.lit(url), F.lit("{skip}"), F.col("skip").cast("string")), F.lit("{take}"), F.lit(str(take)))
    return _asked(skips.select("skip", own.alias("url")), user, pause, wait)

"""REST registers as a data source: ``spark.read.format("register")`` and ``spark.readStream.format("register")``.

Options: ``url`` with ``{key}`` (one request for each key) or with ``{skip}`` and ``{take}``
(pages); ``user`` for basic authentication; ``clients``, the number of partitions that ask at
one time (1); ``pause`` and ``wait``, seconds between requests and after a busy answer.
Pages take ``take`` (20) and ``total``, the number of rows, or ``total_url``, an answer that
has it at ``total_field`` (``total``).

What is asked is said by options: ``keys``, a JSON list, by key; ``rows_from`` and ``rows_to`` (0 and
the total), by pages. Filters are not turned into requests, as Spark keeps what a Python reader made
of one query's filter for the next query over the same DataFrame, which would then lack rows. Each request is
a row, a failed one too, as in ``rest``. Null and repeated keys are not asked. Some queries read
their input twice (a sort samples it), so land the answers by a write first. A DataFrame keeps the pages of
its first reading; ``load`` again to ask how many there are now.

A stream's offset is the number of rows that the register said it had. A batch asks the
pages between two offsets, ``per_batch`` rows at most for each step of the offset, so a
batch that is run again asks the same rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import rest

ANSWER = "url string, status long, body string, error string"


class Requests(InputPartition):
    """(key or skip, url) that one client asks in turn."""

    def __init__(self, asked: list[tuple]):
        super().__init__(None)
        self.asked = asked


class Client:
    """What the options say, and the asking."""

    def __init__(self, options: dict):
        self.url, self.user = options["url"], options.get("user")
        self.clients, self.take = int(options.get("clients", 1)), int(options.get("take", 20))
        self.pause, self.wait = float(options.get("pause", rest.PAUSE)), float(options.get("wait", rest.WAIT))
        self.total, self.total_url = options.get("total"), options.get("total_url")
        self.total_field, self.per_batch = options.get("total_field", "total"), int(options.get("per_batch", 1000))
        self.keyed = "{key}" in self.url
        if not self.keyed and "{skip}" not in self.url:
            raise ValueError("url needs {key} or {skip}")
        if self.keyed and "keys" not in options:
            raise ValueError("a register by key needs keys")
        self.keys = sorted({str(k) for k in json.loads(options.get("keys", "[]")) if k is not None})
        self.rows_from, self.rows_to = int(options.get("rows_from", 0)), int(options["rows_to"]) if "rows_to" in options else None
        if min(self.clients, self.take, self.per_batch) < 1:
            raise ValueError("clients, take and per_batch are 1 or more")

    def rows(self) -> int:
        """How many rows the register has."""
        if self.total is not None:
            return int(self.total)
        if self.total_url is None:
            raise ValueError("pages need total or total_url")
        status, body, error = rest._ask(self.total_url, self.user, self.wait)
        if status != 200:
            raise OSError(f"{self.total_url}: {status} {error}")
        return int(json.loads(body)[self.total_field])

    def page(self, skip: int, end: int) -> tuple[int, str]:
        return skip, self.url.replace("{skip}", str(skip)).replace("{take}", str(min(self.take, end - skip)))

    def dealt(self, asked: list[tuple]) -> list[Requests]:
        """``asked`` in turn to as many partitions as there are clients."""
        return [Requests(own) for i in range(self.clients) if (own := asked[i :: self.clients])]

    def answers(self, partition: Requests | None) -> Iterator[tuple]:
        for key, url in partition.asked if partition else []:  # Spark reads one partition of None where there is none
            yield (key, url, *rest._ask(url, self.user, self.wait))
            time.sleep(self.pause)


class RegisterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "register"

    def schema(self) -> str:
        return f"{'key string' if '{key}' in self.options['url'] else 'skip long'}, {ANSWER}"

    def reader(self, schema) -> RegisterReader:
        return RegisterReader(Client(dict(self.options)))

    def streamReader(self, schema) -> RegisterStream:  # noqa: N802
        return RegisterStream(Client(dict(self.options)))


class RegisterReader(DataSourceReader):
    def __init__(self, client: Client):
        self.client = client

    def partitions(self) -> list[Requests]:
        client = self.client
        if client.keyed:
            return client.dealt([(k, client.url.replace("{key}", quote(k, safe=""))) for k in client.keys])
        end = client.rows() if client.rows_to is None else min(client.rows(), client.rows_to)
        return client.dealt([client.page(skip, end) for skip in range(client.rows_from, end, client.take)])

    def read(self, partition: Requests | None) -> Iterator[tuple]:
        yield from self.client.answers(partition)


class RegisterStream(DataSourceStreamReader):
    """New rows of a register that only grows, by pages."""

    def __init__(self, client: Client):
        if client.keyed:
            raise ValueError("a stream is read by pages")
        self.client = client
        self.seen = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = max(self.seen, min(self.client.rows(), self.seen + self.client.per_batch))
        return {"rows": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Requests]:
        self.seen = max(self.seen, end["rows"])  # a stream that starts again goes on from here
        return self.client.dealt([self.client.page(skip, end["rows"]) for skip in range(start["rows"], end["rows"], self.client.take)])

    def read(self, partition: Requests) -> Iterator[tuple]:
        yield from self.client.answers(partition)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(RegisterSource)

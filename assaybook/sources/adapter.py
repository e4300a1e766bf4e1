"""A Spark Data Source over adapter processes that speak JSON Lines on their standard streams.

``spark.read.format("ledger").option("argv", json_list).option("op", "history.read")``
yields one row for each page of each resource: ``resource_id, page_no, frame, violation``.
Frames stay raw JSON text. Each partition is one resource and one process, read
page after page until ``next`` is null; a process that breaks the protocol ends
its partition with a named violation and loses nothing it had said before.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the protocol.
PROTOCOL, MAX_FRAME, PAGE_GUARD = "1", 1_048_576, 100_000
PASSED = ("PATH", "HOME", "LANG", "TZ", "TMPDIR")


class Violation(RuntimeError):
    """The adapter broke the protocol; the message names how."""


class Connection:
    """One adapter process: requests in turn, each with its own id."""

    def __init__(self, argv: list[str], env: dict[str, str] | None = None):
        kept = {k: os.environ[k] for k in PASSED if k in os.environ}
        self.process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=kept | (env or {}))
        self.last = 0

    def call(self, op: str, params: dict) -> tuple[dict, str]:
        self.last += 1
        self.process.stdin.write(json.dumps({"id": self.last, "op": op, "params": params}).encode() + b"\n")
        self.process.stdin.flush()
        line = self.process.stdout.readline(MAX_FRAME + 2)
        if not line.endswith(b"\n"):
            raise Violation("frame_too_large" if len(line) > MAX_FRAME else "closed_mid_frame" if line else "closed")
        try:
            text = line[:-1].decode("utf-8")
            reply = json.loads(text, object_pairs_hook=_no_repeats)
        except UnicodeDecodeError as e:
            raise Violation("not_utf8") from e
        except ValueError as e:
            raise Violation("not_json") from e
        if not isinstance(reply, dict) or set(reply) not in ({"id", "ok"}, {"id", "err"}):
            raise Violation("bad_envelope")
        if reply["id"] != self.last:
            raise Violation("unknown_id")
        return reply, text

    def hello(self) -> dict:
        reply, _ = self.call("hello", {"protocols": [PROTOCOL]})
        if "err" in reply or reply["ok"].get("protocol") != PROTOCOL:
            raise Violation("unsupported_protocol")
        return reply["ok"]

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait(timeout=10)


def _no_repeats(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


class _Resource(InputPartition):
    def __init__(self, resource_id: str | None):
        super().__init__(resource_id)
        self.resource_id = resource_id


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.argv, self.op = json.loads(options["argv"]), options.get("op", "history.read")
        self.resources = json.loads(options.get("resources", "null"))

    def partitions(self):
        if self.op != "history.read":
            return [_Resource(None)]
        found = self.resources
        if found is None:
            link = Connection(self.argv)
            try:
                link.hello()
                found = [r["resource_id"] for r in link.call("resources.list", {})[0]["ok"]["resources"]]
            finally:
                link.close()
        return [_Resource(r) for r in found]

    def read(self, partition: _Resource) -> Iterator[tuple]:
        link, page = Connection(self.argv), 0
        try:
            link.hello()
            if partition.resource_id is None:
                yield (None, 0, link.call(self.op, {"resource_ids": self.resources or []})[1], None)
                return
            cursor = None
            while page < PAGE_GUARD:
                page += 1
                asked = {"resource_id": partition.resource_id} | ({"page": cursor} if cursor else {})
                reply, text = link.call(self.op, {"resources": [asked]})
                yield (partition.resource_id, page, text, None)
                statuses = reply.get("ok", {}).get("statuses", [])
                cursor = next((s.get("page", {}).get("next") for s in statuses if s.get("resource_id") == partition.resource_id), None)
                if cursor is None:
                    return
            yield (partition.resource_id, page, None, "page_guard")
        except Violation as e:
            yield (partition.resource_id, page, None, str(e))
        finally:
            link.close()


class LedgerSource(DataSource):
    """Format ``ledger``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return "resource_id string, page_no int, frame string, violation string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerSource)


def resume_point(resumable: str, started: dict | None, completed_next: dict | None) -> dict | None:
    """Where an interrupted crawl goes on: after the last completed page only if the cursor is exact."""
    return completed_next if resumable == "exact" and completed_next is not None else started

"""A folder of a remote service as a Spark data source, in batch and as a stream.

A transport lists the folder once and downloads single files; it is named by the option ``transport`` as ``module:Class`` and built from
the options. The default one reads any folder that Arrow's file systems open. Files are dealt to partitions by a hash of their candidate,
so a candidate's files are read by one task; names of files are never spread through the driver's memory as contents are.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Seconds before a second attempt, doubled for each further one; the most; the share that is random; attempts.
BASE_DELAY, MOST_DELAY, JITTER, ATTEMPTS = 0.5, 8.0, 0.3, 3
RETRYABLE = ("transient", "rate_limited")
SEPARATORS = ("_", "-", " ")


class SourceUnavailable(RuntimeError):
    """The folder or a file could not be read; ``failure`` is its class."""

    def __init__(self, failure: str, what: str):
        super().__init__(f"{what}: {failure}")
        self.failure = failure


def failure_class(status: int | None) -> str:
    """What a status of a remote service means; no status is a service that was not reached."""
    if status is None or 500 <= status < 600:
        return "transient"
    return {429: "rate_limited", 401: "auth", 403: "auth", 404: "config"}.get(status, "permanent")


def backoff(attempt: int, rng: random.Random) -> float:
    """Seconds to wait after the ``attempt``-th failure, from 1; the cap comes after the jitter."""
    return min(BASE_DELAY * 2 ** (attempt - 1) * (1 - JITTER + 2 * JITTER * rng.random()), MOST_DELAY)


def with_retries(call: Callable[[], object], what: str, seed: int = 0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``; failures worth another try are tried again, by the ``status`` of the exception."""
    rng = random.Random(seed)
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call()
        except Exception as error:
            failure = getattr(error, "failure", None) or failure_class(getattr(error, "status", None))
            if failure not in RETRYABLE or attempt == ATTEMPTS:
                raise SourceUnavailable(failure, what) from error
            sleep(backoff(attempt, rng))
    raise AssertionError


def candidate_of(name: str) -> str:
    """A3: the stem in lower case before its first "_"; without one before "-"; without one before a blank. An empty part leaves the whole stem."""
    stem = (name.rsplit(".", 1)[0] if "." in name else name).strip().lower()
    found = next((s for s in SEPARATORS if s in stem), None)
    return (stem.split(found)[0] if found else stem) or stem or "candidate"


@dataclass(frozen=True)
class Entry:
    """A file of the folder."""

    name: str
    ref: str
    size: int | None
    modified: int


class FolderTransport:
    """Files of the folder ``path``, a URI or a path, through Arrow's file systems."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def list_files(self) -> list[Entry]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(base))
        return [Entry(f.base_name, f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File]

    def download(self, ref: str) -> tuple[bytes, int | None]:
        """The bytes, and how many there should be if the service says so."""
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(ref) as stream:
            return stream.read(), None


def transport_of(options: dict[str, str]):
    module, _, name = options.get("transport", f"{__name__}:FolderTransport").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def listed(options: dict[str, str]) -> list[Entry]:
    """The files of the folder by time, then name. An empty folder is a fact; one that cannot be listed is an error."""
    if not options.get("path"):
        raise SourceUnavailable("config", "no folder is named")
    return sorted(with_retries(transport_of(options).list_files, "the folder could not be listed"), key=lambda e: (e.modified, e.name))


def downloaded(transport, entry: Entry) -> bytes:
    """A file whole or not at all: a short read is tried again and never returned."""

    def call() -> bytes:
        data, expected = transport.download(entry.ref)
        wanted = entry.size if expected is None else expected
        if wanted is not None and len(data) != wanted:
            raise SourceUnavailable("transient", f"{entry.name} has {len(data)} of {wanted} bytes")
        return data

    return with_retries(call, f"{entry.name} could not be downloaded", seed=entry.modified)


@dataclass
class Candidates(InputPartition):
    """Files whose candidates share a hash prefix."""

    prefix: int
    entries: list[Entry]


def dealt(entries: list[Entry], partitions: int) -> list[Candidates]:
    """Partitions by a hash of the candidate; empty ones are left out."""
    groups: dict[int, list[Entry]] = {}
    for entry in entries:
        prefix = int.from_bytes(hashlib.sha256(candidate_of(entry.name).encode()).digest()[:4], "big") % partitions
        groups.setdefault(prefix, []).append(entry)
    return [Candidates(prefix, groups[prefix]) for prefix in sorted(groups)]


def rows_of(options: dict[str, str], part: Candidates) -> Iterator[tuple]:
    transport = transport_of(options)
    for entry in part.entries:
        data = downloaded(transport, entry)
        yield candidate_of(entry.name), entry.name, entry.ref, entry.modified, len(data), hashlib.sha256(data).hexdigest(), data


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Candidates]:
        # One partition at least: Spark asks a reader without any for the whole.
        return dealt(listed(self.options), int(self.options.get("partitions", 16))) or [Candidates(0, [])]

    def read(self, partition: Candidates) -> Iterator[tuple]:
        return rows_of(self.options, partition)


class FolderStreamReader(DataSourceStreamReader):
    """New files by (time, name); what has an earlier time than the last batch and came later is not seen."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"modified": -1, "name": ""}

    def latestOffset(self) -> dict:
        entries = listed(self.options)
        return {"modified": entries[-1].modified, "name": entries[-1].name} if entries else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Candidates]:
        place = lambda o: (o["modified"], o["name"])
        fresh = [e for e in listed(self.options) if place(start) < (e.modified, e.name) <= place(end)]
        return dealt(fresh, int(self.options.get("partitions", 16)))

    def read(self, partition: Candidates) -> Iterator[tuple]:
        return rows_of(self.options, partition)


class CandidateFolder(DataSource):
    """A3: ``spark.dataSource.register(CandidateFolder)``, then ``spark.read.format("candidate_folder").load(path)``, or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "candidate_folder"

    def schema(self) -> str:
        return "candidate string, name string, ref string, modified bigint, n_bytes bigint, sha256 string, content binary"

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(dict(self.options))

"""URL filter: a sorted digest array of rules, memory-mapped by every Python worker.

The rule file holds the 64-bit xxhash keys of the rules in ascending order, then offsets, verdicts and the
full rule strings. Spark ships the file to each executor once (``SparkContext.addFile``); workers of
a machine map the same pages, so its size is bounded by an executor's disk, not its memory. Probing is
one vectorised binary search per candidate shape: a rule matches a url only as (host suffix of k labels
+ path prefix of l characters), so the distinct (k, l) of the rules are all there is to probe. A hit is
confirmed against the stored string, so colliding keys cannot decide.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

HEAD = struct.Struct("<8sQQQ")  # magic, rules, shapes, bytes of strings
MAGIC = b"urlrule1"
_OPEN: dict = {}
_SHIPPED: set = set()


def digest_bytes(rules) -> bytes:
    """The rule file for (rule, verdict) pairs, e.g. ("example.net/en/", "allow").

    A rule is host + path, the path beginning at the first "/" (empty without one). A-Z of hosts are
    lower-cased, empty rules skipped; a rule given twice blocks if any of the two does.
    """
    table: dict[str, int] = {}
    for rule, verdict in rules:
        if not rule:
            continue
        host, slash, path = rule.partition("/")
        rule = _lower(host) + slash + path
        table[rule] = max(table.get(rule, 0), int(verdict == "block"))
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in table.items())
    text = [r.encode() for _, r, _ in rows]
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in table})
    return b"".join([
        HEAD.pack(MAGIC, len(rows), len(shapes), sum(map(len, text))),
        np.array([k for k, _, _ in rows], dtype="<u8").tobytes(),
        np.cumsum([0, *map(len, text)], dtype="<u8").tobytes(),
        np.array(shapes, dtype="<u8").reshape(-1, 2).tobytes(),
        np.array([v for _, _, v in rows], dtype="<u1").tobytes(), *text])


def _lower(s: str) -> str:
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class DigestArray:
    """A mapped rule file: ``probe`` answers which rule strings are present, and their verdicts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n, shapes, size = HEAD.unpack_from(self.map, 0)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a rule file")
        at = HEAD.size
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.off = np.frombuffer(self.map, "<u8", n + 1, at := at + 8 * n)
        self.shapes = np.frombuffer(self.map, "<u8", 2 * shapes, at := at + 8 * (n + 1)).reshape(-1, 2)
        self.verdict = np.frombuffer(self.map, "<u1", n, at := at + 16 * shapes)
        self.text = at + n

    def probe(self, names: list[str]) -> np.ndarray:
        """Index of each name in the file, -1 if it is not there."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype="<u8", count=len(names))
        out = np.full(len(names), -1, dtype=np.int64)
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for i in hit:  # rare; confirm the string, and look on through equal keys
            j, want = int(at[i]), names[i].encode()
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.map[self.text + int(self.off[j]):self.text + int(self.off[j + 1])] == want:
                    out[i] = j
                    break
                j += 1
        return out


def url_parts(url: str | None) -> tuple[str, str]:
    """(host, path): between "://" and the next of "/?#", A-Z lower-cased; from there up to "?" or "#"."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = _lower(rest[:end]), rest[end:]
    return host, rest[:min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


def match(rules: DigestArray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Index of the longest rule that fits each url (by host and path length, then by host length); -1: none."""
    best = np.full(len(hosts), -1, dtype=np.int64)
    length = np.zeros((len(hosts), 2), dtype=np.int64)
    parts = [h.split(".") for h in hosts]
    for labels, size in rules.shapes.astype(int):
        who = [i for i, p in enumerate(parts) if len(p) >= labels and len(paths[i]) >= size]
        names, n = [], np.zeros((len(who), 2), dtype=np.int64)
        for k, i in enumerate(who):
            host = ".".join(parts[i][-labels:])
            names.append(host + paths[i][:size])
            n[k] = len(host) + size, len(host)
        found = rules.probe(names)
        who = np.array(who, dtype=np.int64)
        old = length[who] if len(who) else n
        better = (found >= 0) & ((best[who] < 0) | (n[:, 0] > old[:, 0]) | ((n[:, 0] == old[:, 0]) & (n[:, 1] > old[:, 1])))
        best[who[better]] = found[better]
        length[who[better]] = n[better]
    return best


def ship(spark: SparkSession, rules) -> str:
    """Write the rule file on the driver and have Spark copy it to every executor; returns its name there.

    An application registers a file name once, so the same rules are shipped once.
    """
    data = digest_bytes(rules)
    name = f"urlrules-{xxhash.xxh3_128_hexdigest(data)}.bin"
    if (spark.sparkContext.applicationId, name) in _SHIPPED:
        return name
    path = os.path.join(tempfile.mkdtemp(prefix="urlrules-"), name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)  # executors fetch it from the driver, no folder is shared
    _SHIPPED.add((spark.sparkContext.applicationId, name))
    return name


def filter_urls(pages: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` and (host, path, rule, verdict); columns of those names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting
    rule decides, ``default`` where none fits (then ``rule`` is null). Null urls and urls without "://"
    have an empty host and path. Rows are judged one by one: repeats and nulls stay.
    """
    name = ship(pages.sparkSession, rules)
    pages = pages.drop("host", "path", "rule", "verdict")
    names = [*pages.columns, "host", "path", "rule", "verdict"]
    at = pages.columns.index(url)

    def run(batches):
        if name not in _OPEN:
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        found = _OPEN[name]
        for batch in batches:
            parts = [url_parts(u) for u in batch.column(at).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            best = match(found, hosts, paths)
            rule = [None if i < 0 else found.map[found.text + int(found.off[i]):found.text + int(found.off[i + 1])].decode() for i in best]
            verdict = [default if i < 0 else ("block" if found.verdict[i] else "allow") for i in best]
            cols = [pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)
    schema = StructType([*pages.schema.fields])
    for c in ("host", "path", "rule", "verdict"):
        schema = schema.add(c, StringType())
    return pages.mapInArrow(run, schema)

"""URL filter over a sorted digest array.

The rules (host, path, verdict) become an array of 64-bit xxhash keys, sorted, beside the full strings. The file is
written once to the shared folder, Spark hands it to every executor, and tasks memory-map it: a long list costs address
space, not memory. A url is probed with every host suffix that is no longer (in labels and in characters) than the longest
rule host, and with every rule path length, by vectorised binary search; what has an equal key is confirmed against the
stored string. The longest rule that fits wins; a url that no rule fits
gets the method's own verdict, allow, for it is not on the list.

Defined cases: a null url, or one without ://, has an empty host and path and no rule; an empty rule list allows all;
repeated rules count once (the same rule with two verdicts is an error); a very long url costs its length once, whatever
its number of labels; repeated rows are judged each; an empty table gives no rows; other columns
pass through, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import shared_dir

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules come from a configuration, through the driver; a longer list is refused, not cut.
MOST_RULES = 20_000_000
VERDICTS = ("allow", "block")
_HEAD = struct.Struct("<qqqqq")


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: counts, the most labels and characters of a rule's host, path lengths, sorted keys, string ends, verdicts, strings."""
    found: dict[str, str] = {}
    lengths: dict[str, int] = {}
    labels = widest = 0
    for host, path, verdict in rules:
        if found.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
        lengths[host + path] = len(path)
        labels, widest = max(labels, host.count(".") + 1), max(widest, len(host))
    if len(found) > MOST_RULES:
        raise ValueError(f"{len(found)} rules; at most {MOST_RULES}")
    keys = np.array([xxhash.xxh64_intdigest(r) for r in found], np.uint64)
    order = np.argsort(keys, kind="stable")
    names = list(found)
    strings = [names[i].encode() for i in order]
    paths = np.array(sorted(set(lengths.values())), np.int64)
    ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
    verdicts = np.array([VERDICTS.index(found[names[i]]) for i in order], np.int64)
    return _HEAD.pack(len(strings), len(paths), int(ends[-1]), labels, widest) + paths.tobytes() + keys[order].tobytes() + ends.tobytes() + verdicts.tobytes() + b"".join(strings)


class DigestArray:
    """A memory-mapped file of `build`."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, p, _, self.labels, self.widest = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        at = _HEAD.size
        parts = []
        for count, kind in ((p, np.int64), (n, np.uint64), (n + 1, np.int64), (n, np.int64)):
            parts.append(raw[at : at + 8 * count].view(kind))
            at += 8 * count
        self.path_lengths, self.keys, self.ends, self.verdicts = parts
        self.strings = raw[at:]

    def find(self, probes: list[str]) -> np.ndarray:
        """The place of each string in the array, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        place = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1, np.int64)
        maybe = np.flatnonzero(np.append(self.keys, 0)[place] == keys) if len(self.keys) else []
        for i in maybe:
            at, probe = place[i], probes[i].encode()
            while at < len(self.keys) and self.keys[at] == keys[i]:
                if self.strings[self.ends[at] : self.ends[at + 1]].tobytes() == probe:
                    out[i] = at
                    break
                at += 1
        return out

    def suffixes(self, host: str) -> list[str]:
        """The host and those of its parents that a rule's host can be, longest first."""
        tail, out = host[-self.widest - 1 :], []
        at = len(tail)
        for _ in range(self.labels):
            at = tail.rfind(".", 0, at)
            if at < 0:
                break
            out.append(tail[at + 1 :])
        if at < 0 and len(tail) == len(host):
            out.append(host)
        return out[::-1]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The rule and the verdict of each pair; each host and path head is looked up once."""
        heads = {}
        for host, path in zip(hosts, paths, strict=True):
            if host:
                for length in self.path_lengths:
                    if length <= len(path):
                        heads.setdefault((host, path[:length]))
        probes: dict[str, int] = {}
        wanted = {}
        for host, head in heads:
            wanted[host, head] = [probes.setdefault(x + head, len(probes)) for x in self.suffixes(host)]
        names = list(probes)
        place = self.find(names)
        best: dict[tuple[str, str], int] = {}
        for key, tried in wanted.items():
            best[key] = next((i for i in tried if place[i] >= 0), -1)
        rules, verdicts = [], []
        for host, path in zip(hosts, paths, strict=True):
            fits = [i for length in self.path_lengths if (i := best.get((host, path[:length]), -1)) >= 0 and length <= len(path)]
            won = max(fits, key=lambda i: len(names[i]), default=None)
            rules.append(None if won is None else names[won])
            verdicts.append("allow" if won is None else VERDICTS[self.verdicts[place[won]]])
        return rules, verdicts


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the array to the shared folder and have Spark hand it to every executor; its file name there."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(data[i : i + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def parse(urls: DataFrame) -> DataFrame:
    """Host (A-Z lower-cased) and path, by the first :// and the next /, ? or #."""
    rest = F.expr("substr(url, locate('://', url) + 3)")
    there = F.col("url").contains("://")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.when(there, host).otherwise(""), "path": F.when(there, path).otherwise("")})


_OPEN: dict[str, DigestArray] = {}


def filter_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """All columns of `urls` (with a column url), and host, path, rule and verdict."""
    name = publish(urls.sparkSession, build(rules))
    parsed = parse(urls.drop("rule", "verdict"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        for batch in batches:
            found = _OPEN[name].judge(batch["host"].to_pylist(), batch["path"].to_pylist())
            arrays = [*batch.columns, *(pa.array(x, pa.string()) for x in found)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "rule", "verdict"])

    schema = parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).schema
    return parsed.mapInArrow(judge, schema)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC) AS n
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

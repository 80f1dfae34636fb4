"""Fill-in-the-middle rearrangement of texts at line boundaries.

A text is cut at two of its line ends into prefix, middle and suffix, which are written in another order behind markers
(prefix, suffix, middle, or suffix, prefix, middle), or left as it is. All draws come from a digest of a seed and the
doc_id, so reruns agree and no row depends on another.

Cuts are found through an index of the text: its bytes are divided into blocks of fixed size; a Fenwick tree holds each
block's number of line ends and another its number of code points. A binary-lifting descent finds the block in which the
k-th line ends, and the place is then located inside that block.

Defined cases: a null text is an empty one; an empty text, one that holds a marker and one that the rate leaves out stay
plain; a last line without a newline is a line; a null doc_id counts as no digits, so that all such rows draw alike; repeated
rows are rearranged alike; a very long text is one row, whose index takes two numbers a block; an empty table gives no rows;
other columns are kept, but for those that `rearrange` adds (n, form, prefix_chars, middle_chars, output), which replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import small_batches, steps, trimmed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of an index block.
BLOCK = 1024
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Fenwick:
    """Counts of blocks: sums of the first blocks, and the block in which a count is reached."""

    def __init__(self, counts: list[int]):
        self.tree = tree = [0, *counts]
        for i in range(1, len(tree)):
            above = i + (i & -i)
            if above < len(tree):
                tree[above] += tree[i]

    def before(self, block: int) -> int:
        """The sum of the blocks before this one."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def descend(self, wanted: int) -> tuple[int, int]:
        """The block in which the running sum reaches `wanted` (1 at least, all of them at most), and the sum before it."""
        block, total, tree = 0, 0, self.tree
        step = 1 << (len(tree) - 1).bit_length()
        while step:
            if block + step < len(tree) and total + tree[block + step] < wanted:
                block += step
                total += tree[block]
            step >>= 1
        return block, total


class Lines:
    """A text's bytes with the trees of its line ends and of its code points."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        self.ends, self.starts = data == 10, (data & 0xC0) != 0x80
        edges = np.arange(0, len(data), block)
        count = lambda flags: np.add.reduceat(flags, edges, dtype=np.int64).tolist() if len(edges) else []
        ends = count(self.ends)
        self.newlines = sum(ends)
        self.lines = self.newlines + int(len(data) > 0 and not self.ends[-1])
        self.units, self.points = Fenwick(ends), Fenwick(count(self.starts))

    def end_of(self, unit: int) -> int:
        """The byte after the first `unit` lines."""
        if unit == 0:
            return 0
        if unit > self.newlines:
            return len(self.data)
        block, before = self.units.descend(unit)
        first = block * self.block
        return first + int(np.flatnonzero(self.ends[first : first + self.block])[unit - before - 1]) + 1

    def points_before(self, byte: int) -> int:
        block = byte // self.block
        return self.points.before(block) + int(np.count_nonzero(self.starts[block * self.block : byte]))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, block: int = BLOCK) -> DataFrame:
    """All columns of `docs` (with doc_id and text) and n (lines), form, prefix_chars, middle_chars, output."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    rows = docs.drop(*_ADDED).withColumns({f"_h{i}": h for i, h in enumerate(draws(F.col("doc_id"), seed), 1)})
    keys = docs.drop(*_ADDED).columns
    schema = T.StructType([*docs.drop(*_ADDED).schema.fields, *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def one(data: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
        text, index = data.tobytes(), Lines(data, block)
        n = index.lines
        if not text or h3 % 100 >= rate or any(m in text for m in marks):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = index.end_of(low), index.end_of(high)
        before = index.points_before(a)
        prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
        spm = h4 % 100 < spm_rate
        return n, "spm" if spm else "psm", before, index.points_before(b) - before, (suffix + prefix if spm else prefix + suffix) + middle

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = [batch[f"_h{i}"].to_pylist() for i in range(1, 5)]
            for row, end, data, offsets in steps(batch["text"]):
                found = [one(data[offsets[i] : offsets[i + 1]], *(h[row + i] for h in hs)) for i in range(end - row)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                added = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), *added], names=[*keys, *_ADDED])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is in such a text, so each is found where it was written."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # an empty part, then what follows each marker
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM g
"""

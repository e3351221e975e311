"""A stored inverted index: written once, searched by many batches of queries.

The index is made of segments (see segments.py), each made within a task, so nothing is shuffled to build it. A segment's
rows are in order of their terms, so a search for a few terms reads only the pages that can hold them; the rows that are
found go, packed, to one task per segment, which counts the phrases of all queries there. Indexes are not changed: a corpus
that gains or loses chunks gets a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators import search, segments
from loomwright.session import materialise, small_batches, stored

#: Terms and prefixes that are named to the scan, at most; with more, all rows go to their segments' tasks.
NAMED_TERMS = 5_000


@dataclass(frozen=True)
class TextIndex:
    """postings: rows of segments."""

    postings: DataFrame
    fields: dict[str, float]
    stemmed: bool

    def hits(self, wanted: segments.Wanted) -> DataFrame:
        """What each segment has of the phrases that are looked for."""
        names, rows = wanted.names(), self.postings
        starts: dict[int, list[str]] = {}
        for start, _ in wanted.prefixes:
            starts.setdefault(len(start), []).append(start)
        if len(names) + len(wanted.prefixes) <= NAMED_TERMS:
            named = F.col("term").isin("", *names)
            for size, some in sorted(starts.items()):
                named = named | F.left("term", F.lit(size)).isin(*some)
            rows = rows.where(named)

        def count(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([wanted.hits(table["segment"][0].as_py(), table)])

        if not wanted.several:  # only phrases of several tokens need the places
            rows = rows.withColumn("places", F.lit(b""))
        return small_batches(rows).groupBy("segment").applyInArrow(count, segments.HITS)


def build_index(chunks: DataFrame, id_col: str = "doc_id", fields: dict[str, float] | None = None, stemmed: bool = False) -> TextIndex:
    """The index of ``chunks``, written to the shared folder."""
    fields = fields or {"text": 1.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, part in enumerate(segments.gathered(batches)):
            table = segments.invert(*part)
            segment = pa.array([task + n] * table.num_rows, pa.int64())
            yield from table.add_column(0, "segment", segment).to_batches(max_chunksize=20_000)

    parts = search.analysed(chunks.withColumn(id_col, F.col(id_col).cast("long")), id_col, fields, stemmed).select("id", *fields)
    return TextIndex(materialise(small_batches(parts).mapInArrow(run, segments.ROW), "index", compact=False), fields, stemmed)


def documents_index(chunks: DataFrame, name: str, **options) -> TextIndex:
    """The index of a table that does not change, built once per application and ``name``."""
    return stored(chunks.sparkSession, f"index:{name}:{sorted(options.items())}", lambda: build_index(chunks, **options))

"""Synthetic inputs for the queries: SQL that Spark and DuckDB read alike, and files."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs

N = "chr(10)"

#: A raw article around a document's text; eight shapes by doc_id.
RAW_ARTICLE = f"""
CASE doc_id % 8 WHEN 1 THEN chr(10) ELSE '' END
|| 'From: someone@example.org' || {N}
|| CASE doc_id % 8 WHEN 2 THEN 'Subject: first' || {N} ELSE '' END
|| CASE doc_id % 8 WHEN 3 THEN 'Subject:   ' ELSE 'SUBJECT: Re: RE:re: topic ' || CAST(doc_id AS VARCHAR(20)) END || {N}
|| 'X-Unlisted: yes' || {N}
|| CASE doc_id % 8 WHEN 0 THEN '' ELSE '  ' || {N} END
|| 'In article <' || CAST(doc_id AS VARCHAR(20)) || '@x> someone wrote:' || {N}
|| '> quoted' || {N} || '  > also quoted' || {N}
|| CASE doc_id % 8 WHEN 6 THEN 'tabs' || chr(9) || chr(9) || 'and  double  spaces' || {N} ELSE '' END
|| CASE doc_id % 8 WHEN 7 THEN 'gap' || {N} || {N} || {N} || {N} || 'after' || {N} ELSE '' END
|| coalesce(text, '') || {N} || '=====' || {N} || '-=_-' || {N} || '==' || {N}
|| CASE doc_id % 8 WHEN 4 THEN '---' WHEN 5 THEN '-- ' ELSE '--' END || {N} || 'signature > line' || {N}
"""

#: A stored article with lines that snippets leave out or keep; eleven shapes by doc_id.
NOISY_ARTICLE = f"""
CASE doc_id % 11
WHEN 0 THEN 'Archive-name: x' || {N} || '| quote' || {N} || 'a@b.c' || {N} || coalesce(text, '')
WHEN 1 THEN 'FOUR WORDS ARE HEADING' || {N} || 'THREE WORDS STAY' || {N} || coalesce(text, '')
WHEN 2 THEN 'one two' || chr(92) || 'nthree four...' || {N} || coalesce(text, '')
WHEN 3 THEN 'a b c d e f g h i j.' || {N} || repeat('x', 80)
WHEN 4 THEN 'a b c d e f g h i j.' || {N} || repeat('y', 81)
WHEN 5 THEN 'a b c d e f g h i j k' || {N} || coalesce(text, '')
WHEN 6 THEN 'w ' || repeat('ab ', 132) || 'cd'
WHEN 7 THEN 'w ' || repeat('ab ', 132) || 'cde'
WHEN 8 THEN repeat('z', 401) || ' a b c d e f g h i j'
WHEN 9 THEN 'In article 5 he wrote: that' || {N} || '--' || {N} || '---' || {N} || 'see Last-Modified here' || {N} || 'short title...' || {N} || 'few words'
ELSE coalesce(text, '') END
"""


def writing_files(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that writes each (category, doc_id, text) to a file of its own; how many it wrote.

    Ids that end in 9 are compressed, and those of them that end in an odd ten are cut short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for b in batches:
            for category, i, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs.create_dir(f"{root}/{category}")
                body = text.encode()
                if i % 10 == 9:
                    body = gzip.compress(body)
                    body = body[: len(body) // 2] if i % 20 == 19 else body
                with fs.open_output_stream(f"{root}/{category}/{i}{'.gz' if i % 10 == 9 else ''}", compression=None) as f:
                    f.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return run

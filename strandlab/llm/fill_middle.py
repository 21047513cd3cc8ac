"""Operator 12, fill-in-middle: cuts texts into prefix, middle and suffix and puts the middle last, in DuckDB inside ``mapInArrow``.

Every Arrow batch is registered with an in-memory DuckDB connection of its task; one SQL statement cuts the texts with
``regexp_extract_all`` (a match per code point), ``list_slice`` and ``array_to_string``, draws from ``sha256``, and its
result goes back as Arrow. No Python runs per row, nothing is shuffled, and a lost task is simply run again: the draws
depend on the id alone. Batches are registered in slices of about 2 MB of text, so memory follows the longest text.

Null text: empty, form plain. Null doc_id: drawn as for an empty id. Texts that hold one of the marks stay plain, so that
``restored`` is exact. Rows that share an id are each transformed, with the same draws. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import in_slices

SEED, PERCENT, SUFFIX_FIRST_PERCENT = 1, 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CUT = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s).') AS u,
    sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM batch),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM drawn),
places AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h[3] % 100 >= {percent} THEN 'plain'
      WHEN h[4] % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, t, n, a, b, form, array_to_string(list_slice(u, 1, a), '') AS prefix,
    array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM places)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
FROM parts
"""


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Per row: doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``percent`` of all texts are cut at two drawn places, of which ``suffix_first`` percent get the suffix in front (spm).
    """
    sql = CUT.format(seed=int(seed), percent=int(percent), suffix_first=int(suffix_first), p=PREFIX, s=SUFFIX, m=MIDDLE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for part in in_slices(batch):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.execute(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again. A cut text holds no mark, and marks can't arise where pieces meet, so each occurs once."""

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

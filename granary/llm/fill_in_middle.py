"""Fill-in-the-middle: texts cut in three and put in another order, by DuckDB inside Arrow tasks.

Each batch is registered with a DuckDB connection of the worker and SQL makes the whole result: tokens by
regexp_extract_all, the cuts from a seeded sha256 of the id, the parts by list_slice and array_to_string.  Nothing runs
per row in Python and nothing is shuffled; a task holds the tokens (16 bytes each, and once more in the parts) of
SLICE_BYTES of text, or of one longer text, at a time.

A text that is empty or holds a sentinel stays plain, so each sentinel occurs once in the others (none can arise where
a part meets a sentinel: they begin with `<` and end with `>`), and `restore` finds the text from output and form alone.

Results for odd input: a null text is empty; a null id is drawn as the empty string; rows that share an id are cut by the
same draws; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import documents, named

#: Bytes of text that one statement works on.
SLICE_BYTES = 1 << 20
SEED = 1
#: Of a hundred texts, so many are cut at all, and so many of these have the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20

#: `<P>`, `<S>` and `<M>` stand before prefix, suffix and middle.
TRANSFORM = """
SELECT id, len(tokens)::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output
FROM (
  SELECT *,
    array_to_string(list_slice(tokens, 1, a), '') AS prefix,
    array_to_string(list_slice(tokens, a + 1, b), '') AS middle,
    array_to_string(list_slice(tokens, b + 1, len(tokens)), '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {cut} THEN 'plain'
         WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM (
    SELECT *, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b
    FROM (
      SELECT id, text, tokens, {draws}
      FROM (SELECT id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM batch)
    )
  )
)
"""
RESTORE = """
SELECT * EXCLUDE (one, two),
  CASE form WHEN 'psm' THEN one || split_part(two, '<M>', 2) || split_part(two, '<M>', 1)
            WHEN 'spm' THEN split_part(two, '<M>', 1) || split_part(two, '<M>', 2) || one ELSE output END AS restored
FROM (
  SELECT *, split_part(substr(output, 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END, 1) AS one,
    split_part(substr(output, 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END, 2) AS two
  FROM ({source})
)
"""
DIGEST = "SELECT id AS doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({source})"


def transform_sql(seed: int = SEED, cut: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST_SHARE) -> str:
    """SQL over `batch` (id, text): the four draws are the first groups of eight digits of the digest."""
    draws = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return TRANSFORM.format(draws=draws, seed=int(seed), cut=int(cut), suffix_first=int(suffix_first))


def _by_sql(sql: str, text_col: str) -> Callable:
    """The task of a mapInArrow that runs SQL over each slice of a batch by the bytes of text_col, registered as `batch`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1}) as con:
            for batch in batches:
                for a, b, _, _ in B.slices(batch, batch.schema.names.index(text_col), SLICE_BYTES):
                    con.register("batch", pa.Table.from_batches([batch.slice(a, b - a)]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    return B.lean(task)


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """Returns id_col, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    out = _input(df, id_col, text_col).mapInArrow(_by_sql(transform_sql(seed, cut, suffix_first), "text"), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(df: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """Returns id_col and restored, the text that `transform` was given."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(form_col).alias("form"), named(output_col).alias("output"))
    sql = f"SELECT id, restored FROM ({RESTORE.format(source='FROM batch')})"
    return rows.mapInArrow(_by_sql(sql, "output"), "id long, restored string").withColumnRenamed("id", id_col)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = DIGEST.format(source=RESTORE.format(source=transform_sql()))
    return _input(documents(spark, sf_dir), "doc_id", "text").mapInArrow(_by_sql(sql, "text"), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: By code points: tokens are told by their lengths, parts by left, substr and right; what is restored must be the text.
OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda s: length(s)) AS sizes, sha256('1:' || doc_id) AS h FROM documents
), d AS (
  SELECT doc_id, x, sizes, len(sizes) AS n, [('0x' || h[1:8])::BIGINT % (len(sizes) + 1), ('0x' || h[9:16])::BIGINT % (len(sizes) + 1)] AS ends, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS o FROM t
), p AS (
  SELECT *, coalesce(list_sum(sizes[:list_min(ends)]), 0)::BIGINT AS p, coalesce(list_sum(sizes[:list_max(ends)]), 0)::BIGINT AS q,
    CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR c >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
)
SELECT doc_id, n::BIGINT AS n, form, CASE form WHEN 'plain' THEN NULL ELSE p END AS prefix_chars, CASE form WHEN 'plain' THEN NULL ELSE q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', substr(x, 1, p), '<S>', substr(x, q + 1), '<M>', substr(x, p + 1, q - p)) ELSE concat('<S>', substr(x, q + 1), '<P>', substr(x, 1, p), '<M>', substr(x, p + 1, q - p)) END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""

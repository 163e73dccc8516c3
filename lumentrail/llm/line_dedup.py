"""Line dedup: drop lines that many documents share.

Lines are exploded under a 128-bit hash of their key, documents are counted per
hash, and texts are put together again, by position, from the lines that stay.

Only hashes travel: the text itself is shuffled once, to meet the hashes it
loses. A line found in a third of all documents is counted in two steps (by
hash and document, then by hash), so that no task gathers its documents.

Defined cases: a null or empty text is one empty line; a null id takes no part
in the counting and keeps its lines; rows that repeat an id count as one
document and are treated alike; other columns pass unchanged, whatever their
names, except ``n_lines`` and ``n_dropped``, which are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import SPACE, ascii_lower, hashed, settle

_ID, _DROPS, _DONE = "__lines_id", "__lines_drops", "__lines_done"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None for a key that is too short to count."""
    key = ascii_lower(line.strip(SPACE))
    return xxhash.xxh3_128_digest(key) if len(key) >= min_chars else None


def _document_hashes(min_chars: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_hash(line, min_chars) for line in text.split("\n")}
                own.discard(None)
                found.extend(own)
                ids.extend([doc_id] * len(own))
            for at in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[at : at + 50_000], pa.binary()), pa.array(ids[at : at + 50_000], batch.schema.field(0).type)], ["line", "doc"]
                )

    return hashes


def _without(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, drops):
            lines = (text or "").split("\n")
            if gone is None or not len(gone):
                rows.append((text or "", len(lines), 0))
                continue
            gone = {bytes(x) for x in gone}
            kept = [x for x in lines if line_hash(x, min_chars) not in gone]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return without


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` documents or more, but for
    the document with the largest id among them; adds ``n_lines`` (before) and
    ``n_dropped``. Keys under ``min_chars`` code points never go."""
    id_type = docs.schema[id_col].dataType.simpleString()
    held = (
        docs.select(id_col, text_col)
        .where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars))
        .mapInArrow(_document_hashes(min_chars), f"line binary, doc {id_type}")
    )
    held = settle(held)
    shared = settle(
        held.groupBy("line", "doc").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs).select("line", "keeper")
    )
    drops = (
        held.join(shared, "line").where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias(_ID)).agg(F.collect_set("line").alias(_DROPS))
    )
    joined = docs.join(hashed(drops, held.count()), docs[id_col] == drops[_ID], "left")
    done = joined.withColumn(_DONE, _without(min_chars)(docs[text_col], F.col(_DROPS)))
    kept = [F.col(f"{_DONE}.text").alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*kept, F.col(f"{_DONE}.n_lines").alias("n_lines"), F.col(f"{_DONE}.n_dropped").alias("n_dropped"))

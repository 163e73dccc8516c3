"""The corpus operators as queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.llm.ann import ann_search
from lumentrail.llm.common import bucket_of, table, tokenizer_file
from lumentrail.llm.html_text import extract_text
from lumentrail.llm.impact_search import impact_search
from lumentrail.llm.line_dedup import line_dedup
from lumentrail.llm.mixing import mix_sources
from lumentrail.llm.ngram_join import ngram_join
from lumentrail.llm.packing import pack
from lumentrail.llm.quality import fit_quality, score_quality
from lumentrail.llm.simhash import simhash_groups
from lumentrail.llm.spelling import spelling_groups
from lumentrail.llm.token_count import count_tokens, read_vocabulary
from lumentrail.llm.toxicity import fit_toxicity, score_toxicity
from lumentrail.llm.voronoi_join import voronoi_top_k


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near neighbours of every hundredth vector."""
    return ann_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products of every fiftieth vector."""
    whole = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x) < float("inf"), x.cast("double")) * 256).cast("double"))
    return voronoi_top_k(table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0)


def _fold(scored: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), modulus) == remainder
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the rows whose crc32 modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(bucket_of(F.col("doc_id"), 5) != 0))
    return _fold(score_quality(docs, model), 5, 0, 0.3)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 over the sources, three uses at most."""
    return mix_sources(table(spark, sf_dir, "documents"), F.array("source"))


def op6_token_count(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces under the pieces and scores of a public sentencepiece vocabulary."""
    pieces, lowest = read_vocabulary(vocabulary or tokenizer_file("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, lowest).select("doc_id", "n_tokens")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the rows whose crc32 modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(bucket_of(F.col("doc_id"), 3) != 1))
    return _fold(score_toxicity(docs, model), 3, 1, 0.7)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids of a public byte-level vocabulary."""
    return pack_public(table(spark, sf_dir, "documents"))


def pack_public(docs: DataFrame) -> DataFrame:
    """``docs`` packed under the public vocabulary of 50k entries."""
    import public_tokenizers

    ranks = Path(tokenizer_file("byte_bpe_50k.tiktoken")).read_bytes()
    return pack(docs, ranks, public_tokenizers.PATTERN)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of 20 code points that three of them share."""
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents of highest score for every benchmark item."""
    return impact_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters and two occurrences, with the form that it is a variant of."""
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at four or fewer differing bits of their fingerprints."""
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_voronoi_top_k": op2_voronoi_top_k,
        "op3_quality": op3_quality,
        "op4_html_text": op4_html_text,
        "op5_mixing": op5_mixing,
        "op6_token_count": op6_token_count,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_ngram_join": op9_ngram_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_impact_search": op11_impact_search,
        "op12_spelling": op12_spelling,
        "op13_simhash": op13_simhash,
        "pipeline": pipeline,
    }


OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

def _op5_sql(rounds: int = 24) -> str:
    """Targets by rounds of water filling, each a CTE: a round beyond the last changes nothing."""
    parts = [
        """sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix' || doc_id) AS draw FROM documents)""",
        """s0 AS (SELECT source, size, [5, 2, 1][1 + (pos - 1) % 3] AS w, CAST(NULL AS DOUBLE) AS t
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sized GROUP BY source))""",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"u{k} AS (SELECT greatest(0, CAST(sum(size) AS DOUBLE) - coalesce(sum(t), 0)) / sum(w) FILTER (WHERE t IS NULL) AS unit FROM s{k - 1})")
        parts.append(f"s{k} AS MATERIALIZED (SELECT source, size, w, CASE WHEN t IS NOT NULL THEN t WHEN unit * w > CAST(3 AS DOUBLE) * size THEN CAST(3 AS DOUBLE) * size END AS t FROM s{k - 1}, u{k})")
    parts.append(f"goal AS (SELECT source, size AS source_size, coalesce(t, unit * w) AS target, CAST(least(round_even(coalesce(t, unit * w), 0), 3 * size) AS BIGINT) AS routed FROM s{rounds}, u{rounds})")
    parts.append("ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, CAST(o.size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE o.size * (routed // source_size) + greatest(0, least(o.size, routed % source_size - before)) END AS BIGINT) AS taken
FROM ordered o JOIN goal g ON o.source IS NOT DISTINCT FROM g.source"""


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM reached GROUP BY node) r ON r.node = d.doc_id
"""

OP10_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND s.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE s.key IS NULL OR s.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key)
GROUP BY k.doc_id
"""


OP11_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counted AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, corpus GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""

# crc32 half a byte at a time, low half first: the sixteen steps of its polynomial are fixed values.
_CRC32 = """xor(4294967295, list_reduce([strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * ((i - 1) // 2) + 2 - (i - 1) % 2, 1)) - 1 for i in range(1, 2 * octet_length(encode({0})) + 1)],
  lambda c, x: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, x) & 15)]), 4294967295))"""

OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), keyed AS (
  SELECT run, times, {_CRC32.format("(doc_id || ':' || run)")} AS h FROM runs
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM keyed
), dictionary AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM dictionary)
), near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION
  SELECT c.word, d.word, d.n FROM cut c JOIN dictionary d ON c.rest = d.word
  UNION
  SELECT d.word, c.word, c.n FROM cut c JOIN dictionary d ON c.rest = d.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM dictionary d LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL
  SELECT f.word, g.form, steps + 1 FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM followed GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_top_k": OP2_SQL, "op5_mixing": _op5_sql(), "op9_ngram_join": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_impact_search": OP11_SQL, "op12_spelling": OP12_SQL}

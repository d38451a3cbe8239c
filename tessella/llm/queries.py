"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), k=13, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = r"\\### Assistant: </turn> ok"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.render(chat.reconstruct(chat.turns_as_events(turns)))
    out = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS te,
    replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3') AS re FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(re) + length(te) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("\\\\", "\\")


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents"), k=5, percent=75)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), length=2048)


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25 import top_k

    docs = _table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 20 = 0"), k=10)


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ego_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from . import stage, warc

    folder = f"{stage.shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to
FROM f
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    out = collocations(_table(spark, sf_dir, "documents"), n=3, at_least=10, percent=50, top=2000)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, d, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS p FROM d
), w AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), i AS (
  SELECT piece, lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, CAST(k AS BIGINT) AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM i, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), c AS (SELECT *, string_split(phrase, ' ') AS s FROM g WHERE k >= 2 AND a >= 10),
bad AS (
  SELECT DISTINCT s.lang, s.phrase FROM c AS s JOIN (
    SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM c WHERE k = 3
  ) AS b ON b.lang = s.lang AND b.phrase = s.phrase AND 100 * b.a >= 50 * s.a
), cuts AS (
  SELECT c.*, j, array_to_string(s[1:j], ' ') AS lp, array_to_string(s[j + 1:k], ' ') AS rp
  FROM c, (VALUES (1), (2)) AS js(j) WHERE j < k AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.lang = c.lang AND bad.phrase = c.phrase)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, j,
    CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN g AS x ON x.lang = cuts.lang AND x.phrase = lp JOIN g AS y ON y.lang = cuts.lang AND y.phrase = rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked
JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang) AS t ON t.lang = ranked.lang
WHERE rank <= 2000
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    out = align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_chat, op3_class_lm, op4_quality, op5_jaccard_join, op6_packing, op7_bm25, op8_piece_bpe, op9_mixing, op10_ego_join, op11_warc, op12_collocations, op13_alignment)
}

ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op11_warc": OP11_SQL, "op12_collocations": OP12_SQL}

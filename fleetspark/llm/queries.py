"""One query for each operator, over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import bpe, chat, decontaminate, jaccard, language, negatives, pieces, pii, quality, shards, toxicity, trie, webtext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


@query("op2_tokens")
def op2_tokens(spark, sf_dir):
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_chat")
def op3_chat(spark, sf_dir):
    return chat.chat_report(table(spark, sf_dir, "conversations"))


@query("op4_web_text")
def op4_web_text(spark, sf_dir):
    return webtext.main_texts(table(spark, sf_dir, "pages"))


BACK = "\\"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_words(pattern: str, lowered: bool = True) -> str:
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if lowered else "coalesce(text, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


NO_BLANK = r"[^\x20\x09-\x0D]+"


def sql_distance(shares: list[str], reference: list[float]) -> str:
    """The Jensen-Shannon distance as it is written in ``quality``."""
    terms = " + ".join(f"CASE WHEN {p} > 0 THEN ({p}) * log2({p}) ELSE 0 END - ({p} + {q!r}) * log2({p} + {q!r})" for p, q in zip(shares, reference, strict=True))
    own = " + ".join(f"{q!r} * log2({q!r})" for q in reference)
    return f"round(sqrt(greatest(1 + ({own} + {terms}) / 2, 0)), 6)"


def sql_count(chars: str) -> str:
    return "length(flat) - length(regexp_replace(flat, '{}+', '', 'g'))".format(chars.replace("'", "''"))


def quality_sql() -> str:
    symbols = quality.SYMBOLS.replace("'", "''")
    classes = ", ".join(f"{sql_count(chars)} AS c_{name}" for name, chars in quality.CLASSES.items())
    shares = [f"c_{name} / greatest(word_chars, 1)" for name in quality.CLASSES]
    shares.append(f"greatest(1 - ({' + '.join(shares)}), 0)")
    signs = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", quality.SIGNS)
    parts = ["c_digit / greatest(word_chars, 1)", "n_signs / greatest(word_chars, 1)", "greatest(word_chars - c_digit - n_signs - n_letters, 0) / greatest(word_chars, 1)"]
    parts.append(f"greatest(1 - ({' + '.join(parts)}), 0)")
    uncased = ", ".join(sql_distance(parts, x) for x in quality.UNCASED)
    by_language, applies = [], []
    for words in quality.COMMON.values():
        counts = [f"len(list_filter(runs, lambda x: x = '{w}'))" for w in words]
        found = [f"{n} / greatest(n_words, 1)" for n in counts]
        found.append(f"greatest(1 - ({' + '.join(found)}), 0)")
        by_language.append(sql_distance(found, [*words.values(), 1 - sum(words.values())]))
        applies.append(f"({' + '.join(counts)} >= {quality.MIN_COMMON_SHARE} * n_words AND {' + '.join(f'({n} > 0)::INT' for n in counts)} >= {quality.MIN_COMMON_KINDS})")
    return f"""
      WITH t AS (SELECT doc_id, coalesce(text, '') AS body, {sql_words(NO_BLANK, False)} AS words,
          translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS flat FROM documents),
      m AS (SELECT *, len(words) AS n_words, length(replace(flat, ' ', '')) AS word_chars, {classes},
          length(body) - length(translate(body, '{symbols}', '')) AS n_symbols, regexp_extract_all(lower(flat), '\\p{{L}}+') AS runs,
          list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{NO_BLANK}')) AS lines FROM t),
      w AS (SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)),
      r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM
          (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS times FROM w) WHERE times > 1) GROUP BY doc_id),
      u AS (SELECT *, CASE WHEN 3 * c_other > word_chars THEN {sql_count("[" + BACK + "p{Lo}" + BACK + "p{Lm}" + BACK + "p{M}]")} ELSE 0 END AS n_uncased FROM m),
      v AS (SELECT *, n_uncased + {sql_count("[" + BACK + "p{Ll}" + BACK + "p{Lu}]")} AS n_letters, {sql_count(signs)} AS n_signs FROM u),
      d AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
          CASE WHEN n_uncased > 0 AND 2 * n_uncased > n_letters THEN least({uncased}) WHEN word_chars > 0 THEN {sql_distance(shares, quality.PROSE)} END AS char_distance,
          CASE WHEN n_words > 0 THEN least({", ".join(by_language)}) END AS word_distance, {" OR ".join(applies)} AS words_apply FROM v LEFT JOIN r USING (doc_id))
      SELECT * EXCLUDE (words_apply), n_words < {quality.MIN_TEXT_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
          NOT (n_words < {quality.MIN_TEXT_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
          AND (word_chars < {quality.MIN_CHARS} OR char_distance <= {quality.MAX_CHAR_DISTANCE})
          AND (n_words < {quality.MIN_WORDS} OR NOT words_apply OR word_distance <= {quality.MAX_WORD_DISTANCE}) AS kept FROM d"""


@query("op5_quality", quality_sql())
def op5_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op6_decontamination", f"""
  WITH d AS (SELECT doc_id, {sql_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS words FROM documents),
  b AS (SELECT item_id, {sql_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS words FROM benchmark),
  bw AS (SELECT DISTINCT item_id, k, words[i:i + k - 1] AS win FROM
    (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
  dw AS (SELECT doc_id, k, i, words[i:i + k - 1] AS win FROM
    (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)),
  hit AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
  n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
  s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM
    (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
  SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""")
def op6_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_jaccard", f"""
  WITH RECURSIVE d AS (SELECT doc_id, {sql_words(NO_BLANK)} AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, words[i:i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)),
  n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * common >= 90 * (na.n_shingles + nb.n_shingles - common)),
  r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
  SELECT r.doc_id, coalesce(n_shingles, 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1, 2""")
def op7_jaccard(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_pieces")
def op8_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    found = toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "sentences")


@query("op10_shards")
def op10_shards(spark, sf_dir):
    return shards.sharded_documents(table(spark, sf_dir, "documents"))


#: Unsigned CRC-32 of a decimal number: bytes are folded in one by one, eight shifts each.
SQL_CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT)"""


@query("op11_trie", f"""
  WITH t AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT *, ({SQL_CRC32} % 9)::BIGINT AS h FROM t),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
  p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
  m AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS done FROM p),
  n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (done) AS ids,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(path[-1][2]) END AS saved FROM m GROUP BY path, depth),
  c AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
  f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path, depth)),
  s AS (SELECT path[1:up] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM
    (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
  SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(f.ids, '')) AS ends_sha256
  FROM f JOIN s ON s.path = f.path LEFT JOIN n q ON q.path = f.path[1:f.depth - 1] AND q.depth = f.depth - 1""")
def op11_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_negatives", """
  WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
    positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10""")
def op12_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_language")
def op13_language(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))

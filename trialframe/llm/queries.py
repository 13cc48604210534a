"""Named queries of the operators over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_mixing, byte_bpe, chat_format, hnsw, html_text, language_id, line_dedup, phrases, quality_rules, simhash, source_mixing, spelling, token_files

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_DEDUP = r"""
WITH parted AS (SELECT doc_id, regexp_extract_all(text, 'PIECE') AS parts FROM documents),
pieces AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS piece FROM parted),
worded AS (
  SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS n FROM pieces),
placed AS (
  SELECT doc_id, pos, regexp_replace(piece, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS piece, n,
         sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS b,
         sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM worded WHERE n > 0),
runs AS (
  SELECT doc_id, sum(n) OVER w AS total, min(pos) OVER w AS a, max(pos) OVER w AS z, list(piece) OVER w AS body
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING)
  UNION ALL
  SELECT doc_id, sum(n) OVER w, min(pos) OVER w, max(pos) OVER w, list(piece) OVER w
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 39 PRECEDING AND CURRENT ROW)),
firsts AS (
  SELECT body, min((doc_id, a)) AS first FROM runs WHERE total >= 40 GROUP BY body),
later AS (
  SELECT DISTINCT doc_id, a, z FROM runs JOIN firsts USING (body) WHERE total >= 40 AND (doc_id, a) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS pos FROM later),
flagged AS (
  SELECT l.doc_id, l.pos, l.piece, g.pos IS NOT NULL AS removed
  FROM pieces l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
cleaned AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY pos) FILTER (NOT removed) AS text,
         count(*) AS n_pieces, count(*) FILTER (removed) AS n_removed
  FROM flagged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text,
       coalesce(n_pieces, 0) AS n_pieces, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id""".replace("PIECE", line_dedup.PIECE.replace("'", "''"))


@query("op4_line_dedup", LINE_DEDUP)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages, whole pieces of lines at a time."""
    df = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return df.select("doc.doc_id", F.col("clean_text").alias("text"), "n_pieces", "n_removed")


CHAT = r"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '<part>', '\lpart>'), '</turn>', '\l/turn>') AS e,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM source)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + CASE WHEN before = role THEN 6 ELSE 6 + length(role) + 1 + 8 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query("op5_chat_format", CHAT)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted text and its loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = chat_format.format_conversations(rows.unionAll(extra))
    df = done.select(
        "conv_id", "formatted", chat_format.parsed(F.col("formatted")).alias("turns"),
        chat_format.trained_text(F.col("segments")).alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUALITY = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
five AS (
  SELECT r, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o
         || chr(10) || lead(w, 4) OVER o AS g FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS hit FROM five),
covered AS (
  SELECT r, max(hit::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
repeats AS (SELECT r, sum(c)::BIGINT AS n FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
seen AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         len(regexp_extract_all(line, '[|»›•·]')) AS seps FROM lines),
ruled AS (
  SELECT *, n > 0 AND (
         (n >= 12 AND NOT regexp_matches(line, '[.!?…:;。！？][\"''”’»)\]]*[\x20\x09-\x0D]*$'))
      OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 > n
      OR len(regexp_extract_all(line, '!')) > n
      OR (seps >= 2 AND seps * 4 >= n)
      OR (n <= 25 AND regexp_matches(lower(line), 'PHRASES'))) AS fails FROM seen),
by_doc AS (
  SELECT r, sum(chars)::BIGINT AS word_chars, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost,
         (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines FROM ruled GROUP BY r),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, lost,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN by_doc USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * lost > 50 * word_chars) AS kept
FROM figures""".replace("PHRASES", "|".join(quality_rules.BOILERPLATE))


@query("op6_quality_rules", QUALITY)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    df = quality_rules.judged(table(spark, sf_dir, "documents"))
    return df.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a public vocabulary, and decoded again."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


MIXING = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, power(n, 0.5) / (SELECT sum(power(n, 0.5)) FROM counts) * 1.0 * (SELECT sum(n) FROM counts) / n AS rate
  FROM counts),
steps AS (SELECT source, rate, greatest(ceil(rate / 64.0), 1)::BIGINT AS steps FROM rates),
dist(source, steps, mean, k, p, total) AS (
  SELECT source, steps, rate / steps, 0, exp(-rate / steps), exp(-rate / steps) FROM steps
  UNION ALL
  SELECT source, steps, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM dist
  WHERE k + 1 <= floor(mean + 12 * sqrt(mean) + 24)),
marked AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
         concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(text), 'null')) AS mark FROM documents),
draws AS (
  SELECT r, mark, d.source, unnest(range(1, steps + 1)) AS j
  FROM marked d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
numbers AS (
  SELECT r, source, ('0x' || substr(md5(concat_ws(':', '17', mark, j::VARCHAR)), 1, 12))::BIGINT
         / 281474976710656.0 AS u FROM draws),
copies AS (
  SELECT r, count(*) AS n FROM numbers n JOIN dist d
  ON n.source IS NOT DISTINCT FROM d.source AND d.total <= n.u GROUP BY r),
out AS (SELECT r, unnest(range(n)) AS copy FROM copies)
SELECT doc_id, source, copy, text, substr(md5(concat_ws(':', 'place17', mark, copy::VARCHAR)), 1, 16) AS place
FROM out JOIN marked USING (r)"""


@query("op3_source_mixing", MIXING)
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to tempered source weights: every copy of every document, in shuffled order."""
    df = source_mixing.mixed(table(spark, sf_dir, "documents"))
    return df.select("doc.doc_id", "doc.source", "copy", "doc.text", "place")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_crc() % 3 == 1, F.lit(False))
    net = language_id.train(language_id.sample(docs.filter(~held)))
    done = language_id.predicted(docs.withColumn("held_out", held), net, keep=("doc_id", "held_out"))
    return done.select("doc_id", "held_out", "lang_pred", "score")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query("op8_hnsw")
def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


@query("op2_bit_mixing")
def op2_bit_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from six sevenths of them."""
    held = _crc() % 7 == 2
    return bit_mixing.scores(table(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")


SPELLING = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v FROM range(256) r(b))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w
  FROM documents),
counted AS (SELECT id, w, count(*) AS n FROM runs GROUP BY id, w),
hexed AS (SELECT id, w, n, hex(encode(id || ':' || w)) AS x FROM counted),
hashed AS (
  SELECT w, n, xor(list_reduce(list_transform(range(1, len(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
  FROM hexed, crc),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
links AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM links GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form,
         CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
led(word, root) AS (
  SELECT word, coalesce(form, word) FROM formed
  UNION SELECT l.word, f.form FROM led l JOIN formed f ON l.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l ON f.word = l.word JOIN formed e ON l.root = e.word AND e.form IS NULL"""


@query("op11_spelling_variants", SPELLING)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent spelling, if there is one, and the root of its spellings."""
    return spelling.grouped(table(spark, sf_dir, "documents"))


PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
piece AS (SELECT lang, doc, generate_subscripts(p, 1) AS j, unnest(p) AS p FROM pieces),
tokens AS (
  SELECT lang, doc, j, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (
    SELECT lang, doc, j, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece)),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM tokens WINDOW o AS (PARTITION BY doc, j ORDER BY i)),
grams AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM ahead
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM ahead WHERE w5 IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM ahead GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m > 1),
spans AS (
  SELECT lang, m, w, a, unnest(range(2, m)) AS size FROM candidates WHERE m > 2),
held AS (
  SELECT lang, array_to_string(w[b : b + size - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS b FROM spans) GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase WHERE coalesce(100 * most < 100 * a, true)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, u.n AS l, v.n AS r, t.n,
         ((1000 * c.a::HUGEINT * t.n::HUGEINT) // (u.n::HUGEINT * v.n::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN f u ON u.lang = c.lang AND u.phrase = c.x JOIN f v ON v.lang = c.lang AND v.phrase = c.y
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed WHERE rank <= 2000"""


@query("op13_phrase_collocations", PHRASES)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by the score of their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back by its key from the binary files that all documents were written to."""
    docs = table(spark, sf_dir, "documents")
    folder = token_files.target(spark)
    token_files.write(docs, folder, public_tokenizers.path(TOKENIZER))
    return token_files.digests(docs, folder).withColumnRenamed("key", "doc_id")

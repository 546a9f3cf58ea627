"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorascope.llm import countrtree, dac, decontaminate, line_frequency, line_join, minhash, packing, phrases, secrets, separators, substrings, tokens, turns, wrappers
from agorascope.llm.store import table, written


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.verdicts(table(spark, sf_dir, "documents"))


def op3_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_join.summary(docs, line_join.removed_lines(docs, least_words=1))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.word_vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = written(dac.write_images(table(spark, sf_dir, "documents"), tokens.byte_vocabulary()), "dac")
    return dac.read_images(images).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.secrets(table(spark, sf_dir, "documents")))


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = written(separators.write_flat(table(spark, sf_dir, "documents"), tokens.byte_vocabulary()), "flat")
    found = separators.scan_flat(flat)
    return found.join(separators.manifest(flat), ["file", "ordinal"]).select(
        "doc_id", "file", "ordinal", "start", "n_tokens", "ended"
    )


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrappers.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_edit_distance_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.report(rows, turns.repair(turns.damaged(rows)))


def op12_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countrtree.components_of(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lsh_forest,
        op2_line_frequency,
        op3_line_similarity_join,
        op4_retrieval_packing,
        op5_addressable_codes,
        op6_decoding_worklist,
        op7_separator_scan,
        op8_wrapper_induction,
        op9_edit_distance_lsh,
        op10_fm_index,
        op11_turn_repair,
        op12_phrase_counts,
        op13_count_rtree,
    )
}

# words, whole texts and line figures of every document in SQL
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_line_frequency": rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '{_WORDS}') AS words FROM d
), line AS (
  SELECT doc_id, host, text, u.i, u.line,
    regexp_replace(trim(translate(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +', ' ', 'g') AS normal,
    len(regexp_extract_all(u.line, '{_WORDS}')) AS n
  FROM d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS i) u
), worded AS (SELECT * FROM line WHERE n > 0),
freq AS (
  SELECT host, normal FROM worded JOIN (SELECT host, count(DISTINCT text) AS host_n FROM d GROUP BY host) USING (host)
  GROUP BY host, normal, host_n
  HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) * 100 > host_n * 10
), removed AS (
  SELECT doc_id, sum(n) AS n_removed_words FROM worded SEMI JOIN freq USING (host, normal) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept,
  n_removed_words
FROM base""",
    "op11_turn_repair": r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), kinds AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))) % 20 AS kind
  FROM given
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), way(s, letters, t, price, initial) AS (VALUES
  (0, 'D', 0, 3, NULL), (1, 'D', 1, 3, NULL), (2, 'D', 2, 3, NULL), (3, 'D', 3, 3, NULL),
  (0, 'R', 2, 2, NULL), (1, 'R', 2, 2, NULL), (2, 'R', 3, 2, NULL), (3, 'R', 2, 2, NULL),
  (0, 'IR', 3, 4, NULL), (1, 'IR', 3, 4, NULL), (2, 'IR', 2, 4, NULL), (3, 'IR', 3, 4, NULL),
  (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'),
  (2, 'IK', 2, 2, 'u'), (0, 'IK', 3, 2, 'a'), (1, 'IK', 3, 2, 'a'), (3, 'IK', 3, 2, 'a')
), steps AS (
  SELECT f.conv_id, f.i, w.s, w.t, w.letters, w.price + CASE WHEN f.fault = 'truncated' AND w.letters <> 'D' THEN 1 ELSE 0 END AS price,
    CASE WHEN w.letters LIKE 'I%' THEN chr(10) || CASE w.s WHEN 2 THEN 'assistant:' ELSE 'user:' END ELSE '' END ||
    CASE right(w.letters, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
         ELSE chr(10) || CASE w.t WHEN 3 THEN 'assistant:' ELSE 'user:' END || f.text END AS added
  FROM faults f JOIN way w ON (w.initial IS NULL OR w.initial = f.initial)
    AND (w.letters = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate'))
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS repaired FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT conv_id, i, t, cost, audit, repaired FROM (
    SELECT b.conv_id, p.i, p.t, b.cost + p.price AS cost, b.audit || p.letters AS audit, b.repaired || p.added AS repaired
    FROM best b JOIN steps p ON b.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = b.i + 1 AND p.s = b.s)
  QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1
), ended AS (
  SELECT conv_id, i, cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost,
    audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    repaired || CASE s WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS repaired
  FROM best
), chosen AS (
  SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC, cost, audit) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(substr(coalesce(repaired, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen b ON o.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op12_phrase_counts": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece),
gram AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(words) >= size
), f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate)
), scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, a, array_to_string(words[p:p + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS m FROM candidate WHERE size > 2))
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN (SELECT lang, phrase, max(a) AS cover FROM inside GROUP BY ALL) i USING (lang, phrase)
  WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000""",
    "op13_count_rtree": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [hash(words)]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: hash(words[i:i + 4])))) END AS items
  FROM w
), uniq AS (SELECT min(doc_id) AS node, items FROM sets WHERE len(items) > 0 GROUP BY items),
item AS (
  SELECT node, n, item, row_number() OVER (PARTITION BY node ORDER BY f, item) AS place
  FROM (SELECT node, len(items) AS n, unnest(items) AS item FROM uniq)
  JOIN (SELECT item, count(*) AS f FROM (SELECT unnest(items) AS item FROM uniq) GROUP BY item) USING (item)
), head AS (SELECT * FROM item WHERE place <= n - ceil(0.8 * n) + 1),
pair AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM head a JOIN head b ON a.item = b.item AND a.node < b.node
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), link AS (
  SELECT a, b FROM pair JOIN uniq x ON x.node = a JOIN uniq y ON y.node = b
  WHERE 180 * len(list_intersect(x.items, y.items)) >= 80 * (len(x.items) + len(y.items))
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, low) AS (
  SELECT node, node FROM uniq
  UNION
  SELECT e.b, r.low FROM reach r JOIN edge e ON r.node = e.a WHERE r.low < e.b
), least AS (SELECT node, min(low) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id
FROM sets s LEFT JOIN uniq USING (items) LEFT JOIN least USING (node)""",
}

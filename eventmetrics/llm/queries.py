"""The numbered queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from eventmetrics.llm import (
    bbit_minhash,
    bloom_dedup,
    compact_windows,
    compression_quality,
    entropy_balance,
    line_windows,
    phrase_counting,
    popcount_tiles,
    prefix_trie,
    quality_rules,
    repeat_intervals,
    sentencepieces,
    url_filter,
)
from eventmetrics.llm.common import table

BLANK = "[\\x20\\x09-\\x0D]+"


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark, sf_dir):
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark, sf_dir):
    return entropy_balance.report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepieces.report(table(spark, sf_dir, "documents"), sentencepieces.load())


def op5_line_window_dedup(spark, sf_dir):
    return line_windows.report(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return bloom_dedup.report(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark, sf_dir):
    return repeat_intervals.report(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark, sf_dir):
    return compact_windows.report(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark, sf_dir):
    return popcount_tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_phrase_mining(spark, sf_dir):
    return phrase_counting.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this folder's operators itself

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_source_mixing": op3_source_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_window_dedup": op5_line_window_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_compact_windows": op8_compact_windows,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrase_mining": op13_phrase_mining,
    "pipeline": pipeline,
}

OP5_SQL = """
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
win AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS key
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS nth
  FROM win WHERE key IS NOT NULL AND regexp_matches(key, '[^\\x20\\x09-\\x0D]')
),
gone AS (
  SELECT DISTINCT doc_id, pos + step AS pos FROM ranked, (VALUES (0), (1), (2)) AS s(step) WHERE nth > 1
),
marked AS (
  SELECT line.doc_id, line.pos, line, gone.pos IS NOT NULL AS removed,
         lag(gone.pos IS NOT NULL, 1, false) OVER (PARTITION BY line.doc_id ORDER BY line.pos) AS before
  FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.pos = line.pos
),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
         count(*) FILTER (WHERE removed AND NOT before) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""

OP6_SQL = f"""
WITH norm AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM norm WINDOW same AS (PARTITION BY text_sha256)
"""


def _op10_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
word AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS w FROM split),
win AS (
  SELECT doc_id, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' '
         || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS key
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
twice AS (
  SELECT doc_id, pos, key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1 AS hit FROM win
),
covered AS (
  SELECT doc_id, max(hit::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
  FROM twice
),
rep AS (SELECT doc_id, sum(hit)::BIGINT AS n FROM covered GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(words) AS n_words,
         length(regexp_replace(text, '{BLANK}', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         len(list_intersect(words, [{stops}])) AS n_stop_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM split s LEFT JOIN rep ON rep.doc_id = s.doc_id
),
v AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 20 THEN 'min_words' END,
    CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_windows' END,
    CASE WHEN word_chars < 2 * n_words THEN 'mean_word_low' END,
    CASE WHEN word_chars > 15 * n_words THEN 'mean_word_high' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
    CASE WHEN 100 * n_upper > 40 * word_chars THEN 'capitals' END,
    CASE WHEN n_stop_words < 2 THEN 'stop_words' END,
    CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 'duplicate_lines' END,
    CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 'ellipsis_lines' END
  ], lambda x: x IS NOT NULL) AS failed_rules
  FROM m
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, len(failed_rules) = 0 AS kept FROM v
"""


# The head length needs CRC-32, bit by bit: each byte is followed by eight steps.
OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_concat([4294967295::BIGINT],
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  ), 4294967295::BIGINT) % 4 AS h
  FROM own
),
conv AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
),
member AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM conv
),
node AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(len(list_filter(
           regexp_split_to_array(any_value(turns[depth].text), '{BLANK}'), lambda w: w <> '')), 0) AS own_saved
  FROM member GROUP BY path, depth
),
child AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
marked AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.path = node.path AND child.depth = node.depth
),
up AS (SELECT path, depth, unnest(range(depth + 1)) AS top, own_saved, n_children FROM marked),
sums AS (
  SELECT path[1:top] AS path, top AS depth, sum(own_saved)::BIGINT AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM up GROUP BY ALL
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM marked m JOIN sums s ON s.path = m.path AND s.depth = m.depth
LEFT JOIN marked p ON m.depth > 0 AND p.path = m.path[1:m.depth - 1] AND p.depth = m.depth - 1
"""

OP13_SQL = """
WITH piece AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda w: w <> '') AS words
    FROM documents
  )
),
word AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM piece),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
phrase AS (
  SELECT lang, words[i:i + m - 1] AS w, m, count(*) AS f
  FROM word, (VALUES (1), (2), (3), (4)) AS size(m) WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30
),
side AS (SELECT lang, w, m, f AS a, unnest(range(1, m)) AS k FROM phrase WHERE m > 1),
half AS (SELECT lang, w, a, k, w[1:k] AS first, w[k + 1:] AS rest FROM side),
cut AS (
  SELECT h.lang, h.w, a, x.f AS l, y.f AS r, k, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
  FROM half h JOIN phrase x ON x.lang = h.lang AND x.w = h.first JOIN phrase y ON y.lang = h.lang AND y.w = h.rest
),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inner_phrase AS (
  SELECT lang, w[s:s + m2 - 1] AS w, max(f) AS f
  FROM phrase, (VALUES (1), (2), (3)) AS a(s), (VALUES (2), (3)) AS b(m2) WHERE m2 < m AND s + m2 - 1 <= m GROUP BY ALL
),
kept AS (
  SELECT low.*, array_to_string(low.w, ' ') AS phrase FROM low LEFT JOIN inner_phrase i ON i.lang = low.lang AND i.w = low.w
  WHERE i.f IS NULL OR 100 * i.f < 80 * a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op5_line_window_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_quality_rules": _op10_sql(),
    "op12_prefix_trie": OP12_SQL,
    "op13_phrase_mining": OP13_SQL,
}

"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from paddock.llm import automata, chat, collisions, collocations, compression, decontaminate, language, minmax, packing, pii, structure, suffixes, toxicity
from paddock.llm.common import read

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


TOKENIZER = "byte_bpe_50k.json"


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return compression.quality(documents, compression.train(documents, read(spark, sf_dir, "labels")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text")))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return toxicity.severities(documents, toxicity.train(documents, read(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents)).drop("family")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"))


def op11_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automata.remove_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_damaged(read(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_suffixes, op2_packing, op3_personal_data, op4_decontamination, op5_compression, op6_chat, op7_toxicity, op8_language, op9_near_vectors, op10_min_max)
    + (op11_automata, op12_structure, op13_collocations)
}

_COMPONENTS = """
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  walk AS (SELECT id AS node, id AS reached FROM nodes UNION SELECT w.node, e.b FROM walk w JOIN edges e ON w.reached = e.a),
  component AS (SELECT node, min(reached) AS component_id FROM walk GROUP BY node)
"""

ORACLES = {
    "op6_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + length(regexp_replace(regexp_replace(role, '<(\||/?s>|</?SYS>>)|\[(/?INST\])', chr(1), 'g'), '[^\x01]', '', 'g'))
    + length(regexp_replace(regexp_replace(text, '<(\||/?s>|</?SYS>>)|\[(/?INST\])', chr(1), 'g'), '[^\x01]', '', 'g'))
    + length('<|turn|><|content|><|end|>') AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_near_vectors": f"""
WITH RECURSIVE
  good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  nodes AS (SELECT vec_id AS id FROM embeddings),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
  {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON node = vec_id""",
    "op10_min_max": rf"""
WITH RECURSIVE
  w AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS grams FROM w),
  g AS (SELECT doc_id, hash(unnest(grams)) AS gram FROM s),
  nodes AS (SELECT doc_id AS id FROM documents),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.grams) + len(y.grams) - n)),
  {_COMPONENTS}
SELECT doc_id, len(grams) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN component ON node = doc_id""",
    "op11_automata": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  win AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS seen FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) > 12)),
  least AS (SELECT seen, min(doc_id) AS first FROM win GROUP BY seen),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (seen) WHERE first < doc_id),
  word AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)""",
    "op12_structure": r"""
WITH RECURSIVE
  slots AS (SELECT list(v ORDER BY i) AS slot FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
  plain AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
  coded AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, slot[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM plain, slots),
  hurt AS (SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0),
  turns AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
  shown AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before FROM turns),
  faults AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS again, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM shown),
  walk AS (
    SELECT g, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 99999999::BIGINT, 'a': '~'} AS s1, {'c': 3::BIGINT, 'a': 'I'} AS s2, {'c': 6::BIGINT, 'a': 'II'} AS s3 FROM (SELECT DISTINCT g FROM faults)
    UNION ALL
    SELECT g, i, n0, n1, m2, list_min([n3, {'c': m2.c + 3, 'a': m2.a || 'I'}]) FROM (
      SELECT *, list_min([n2, {'c': n0.c + 3, 'a': n0.a || 'I'}, {'c': n1.c + 3, 'a': n1.a || 'I'}, {'c': n3.c + 3, 'a': n3.a || 'I'}]) AS m2 FROM (
        SELECT g, i, {'c': s0.c + 4, 'a': s0.a || 'D'} AS n0,
          list_min([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': s0.c + e + CASE WHEN x = 's' THEN 0 ELSE 99999999 END, 'a': s0.a || 'K'}]) AS n1,
          list_min([{'c': s2.c + 4, 'a': s2.a || 'D'}] || list_transform([s0, s1, s3], lambda s: {'c': s.c + e + CASE WHEN x = 'u' THEN 0 ELSE 99999999 END, 'a': s.a || 'K'})
            || list_transform([s0, s1, s3], lambda s: {'c': s.c + e + 3, 'a': s.a || 'R'})) AS n2,
          list_min([{'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': s2.c + e + CASE WHEN x = 'a' THEN 0 ELSE 99999999 END, 'a': s2.a || 'K'}, {'c': s2.c + e + 3, 'a': s2.a || 'R'}]) AS n3
        FROM (SELECT w.* EXCLUDE (i), f.i, x, CASE WHEN blank OR again THEN 99999999 WHEN cut THEN 3 ELSE 0 END AS e FROM walk w JOIN faults f ON f.g = w.g AND f.i = w.i + 1)))),
  final AS (SELECT g, list_min([s0, s3]) AS best FROM walk JOIN (SELECT g, max(i) AS i FROM faults GROUP BY g) USING (g, i)),
  letters AS (SELECT g, unnest(string_split(best.a, '')) AS letter, unnest(range(1, len(best.a) + 1)) AS pos, len(replace(best.a, 'D', '')) AS m FROM final WHERE best.a <> ''),
  placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER upto AS i, count(*) FILTER (WHERE letter <> 'D') OVER upto AS k FROM letters WINDOW upto AS (PARTITION BY g ORDER BY pos)),
  mended AS (SELECT p.g, pos, CASE letter WHEN 'K' THEN f.role ELSE CASE WHEN (k + m) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE f.text END AS line
    FROM placed p LEFT JOIN faults f ON f.g = p.g AND f.i = p.i WHERE letter <> 'D'),
  texts AS (SELECT g, string_agg(line, chr(10) ORDER BY pos) AS whole FROM mended GROUP BY g),
  counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM plain) LEFT JOIN counts USING (g) LEFT JOIN final USING (g) LEFT JOIN texts USING (g)""",
    "op13_collocations": rf"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
  starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
  grams AS (SELECT lang, words[i:i + k - 1] AS gram FROM (SELECT *, unnest(range(1, 6)) AS k FROM starts) WHERE i + k - 1 <= len(words)),
  f AS (SELECT lang, gram, count(*) AS f FROM grams GROUP BY lang, gram HAVING count(*) >= 100),
  cuts AS (SELECT lang, gram, f AS a, unnest(range(1, len(gram))) AS k FROM f WHERE len(gram) > 1),
  scores AS (SELECT c.lang, c.gram, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1:k] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1:len(c.gram)]),
  worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
  inside AS (SELECT DISTINCT lang, gram[i:i + m - 1] AS gram, f AS a FROM (SELECT *, unnest(range(1, len(gram) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(gram))) AS m FROM f WHERE len(gram) > 2))),
  kept AS (SELECT * FROM worst w WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.gram = w.gram AND i.a >= w.a))
SELECT lang, rank, array_to_string(gram, ' ') AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank FROM kept) WHERE rank <= 2000""",
}

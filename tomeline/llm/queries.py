"""One query for each operator, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.llm import alignment, ann, chat, exact_topk, jaccard_join, language_id, lexical, licenses, mixing, pieces, repeats, token_files, url_filter, url_labels
from tomeline.llm.common import new_folder, table

RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
WORD_TOKENIZER, BYTE_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentation_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_offset")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.read_back(chat.format_conversations(chat.message_events(rows, revised=True))))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = url_filter.judged_urls(table(spark, sf_dir, "pages"), RULES)
    return url_filter.filter_urls(urls, url_filter.fit(url_labels.labelled_urls()))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_files.read_tokens(spark, path, want_ids=False)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates, telling = licenses.all_templates()
    return licenses.best_license(licenses.scan_licenses(table(spark, sf_dir, "documents"), templates, telling=telling))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.ann_search(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.fit_dictionaries(language_id.training_rows(docs))
    found = language_id.predict(docs, learned)
    held_out = F.coalesce(language_id.remainder(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sentencepiece, op2_exact_topk, op3_mixing, op4_chat, op5_url_filter, op6_token_files, op7_licenses, op8_ann, op9_language, op10_jaccard, op11_alignment, op12_ranked_search, op13_substring_dedup]
    return {f.__name__: f for f in found}


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# shares by largest remainder, one period by earliest deadline first (a slot for each step), then arithmetic
OP3_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY 1
), exact AS (
  SELECT source, 1024 * sqrt(n) / sum(sqrt(n)) OVER () AS x FROM counts
), whole AS (
  SELECT *, greatest(1, CAST(floor(x) AS BIGINT)) AS f FROM exact
), shares AS (
  SELECT source, f + CASE WHEN row_number() OVER (ORDER BY f - x, source) <= 1024 - sum(f) OVER () THEN 1 ELSE 0 END AS share FROM whole
), s AS (
  SELECT list(CAST(share AS BIGINT) ORDER BY source) AS share, list(source ORDER BY source) AS names FROM shares
), e(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(share, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (
    SELECT slot, done, list_sort(list_filter(
      list_transform(share, lambda c, i: {'due': ((done[i] + 1) * 1024 + c - 1) // c, 'at': CAST(i AS BIGINT), 'open': done[i] * 1024 // c <= slot + 1 AND done[i] < c}),
      lambda j: j.open))[1].at AS p
    FROM e, s WHERE slot < 1023
  )
), placed AS (
  SELECT names[pick] AS source, done[pick] - 1 AS i, slot FROM e, s WHERE slot >= 0
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS k FROM documents
)
SELECT r.doc_id, r.source AS mix_source, CAST(r.k // 16 AS BIGINT) AS mix_block, CAST(r.k // 16 // h.share * 1024 + p.slot AS BIGINT) AS mix_slot, CAST(r.k % 16 AS BIGINT) AS mix_offset
FROM ranked r JOIN shares h USING (source) JOIN placed p ON p.source = r.source AND p.i = r.k // 16 % h.share
"""

# lengths of the template: start mark, line break, end mark with its line break; escapes add one character each
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
    + length(role) + length(regexp_replace(text, '\\', '\\\\', 'g'))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN f USING (g) JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * docs // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""

# windows as lists of words; each word is gone if it is among the 13 from the start of one that a smaller id holds
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM d
), f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s
), m AS (
  SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (s), range(13) AS t(k) WHERE low < doc_id
), x AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), k AS (
  SELECT x.doc_id, count(*) AS n, count(m.i) AS gone, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE m.i IS NULL) AS kept
  FROM x LEFT JOIN m ON x.doc_id = m.doc_id AND x.i = m.i GROUP BY x.doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op3_mixing": OP3_SQL, "op4_chat": OP4_SQL, "op10_jaccard": OP10_SQL, "op12_ranked_search": OP12_SQL, "op13_substring_dedup": OP13_SQL}

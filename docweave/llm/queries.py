"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, table
from . import conversations, credentials, decontam, exactdedup, langid, merkle, minhash, packing, quality, shards, simhash, substrings, suffixes


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.held_out(F.col("doc_id"))
    scores, _ = quality.scored(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ready(spark), sf_dir, "documents"))


def op3_interval_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(table(ready(spark), sf_dir, "documents"))


def op4_level_doubling_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(table(ready(spark), sf_dir, "documents"))


def op5_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.summary(table(ready(spark), sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(ready(spark), sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_multipart_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.summary(table(ready(spark), sf_dir, "documents"))


def op8_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.labelled(docs.select("doc_id", "text"), model, with_spans=False)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_stateful_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(ready(spark), sf_dir, "documents")).drop("keep_locator")


def op11_recursive_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(ready(spark), sf_dir, "documents"))


def op12_iterative_deepening_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(ready(spark), sf_dir, "conversations")))


def op13_lsh_forest_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(ready(spark), sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rule_ensemble_quality, op2_golay_simhash, op3_interval_tree_dedup, op4_level_doubling_substrings, op5_size_tiered_shards, op6_best_fit_packing, op7_multipart_credentials, op8_viterbi_language, op9_wu_manber_decontamination, op10_stateful_exact_dedup, op11_recursive_merkle_climb, op12_iterative_deepening_repair, op13_lsh_forest_minhash)}


_ORACLES = {
    "op3_interval_tree_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d)),
again AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
step AS (SELECT doc_id, s, lag(s) OVER w AS before, lead(s) OVER w AS after FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
run AS (SELECT doc_id, s, least(400, coalesce(after - s, 400)) AS n, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM step),
span AS (SELECT doc_id, r, min(s) AS lo, max(s) + 400 AS hi, sum(n) AS n FROM run GROUP BY 1, 2),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span
    UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), max(len(h) // 2) FROM d LEFT JOIN span USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a, b) AS t FROM gap JOIN d USING (doc_id) GROUP BY 1),
total AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS spans FROM span GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)""",
    "op4_level_doubling_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_wu_manber_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s+m-1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s+m-1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw))),
occ AS (SELECT doc_id, s, m, item_id FROM dw JOIN bw USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM occ) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op10_stateful_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain, length(coalesce(text, '')) AS size FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r""",
    "op11_recursive_merkle_climb": r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, concat('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS start FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM l),
inner_ AS (SELECT tree, 0 AS level, idx, size, leaf AS hash FROM p
    UNION ALL SELECT tree, level + 1, idx // 8, max((size + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM inner_ WHERE size > 1 GROUP BY tree, level, idx // 8),
tops AS (SELECT tree, max(level) AS height, arg_max(hash, level) AS subroot FROM inner_ GROUP BY tree),
outer_ AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM tops) AS size, subroot AS hash FROM tops
    UNION ALL SELECT level + 1, idx // 8, max((size + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM outer_ WHERE size > 1 GROUP BY level, idx // 8),
run AS (SELECT tree, level, idx, size, hash, tree || '/' || level || '/' || idx // 8 AS run FROM inner_ WHERE size > 1 UNION ALL SELECT -1, level, idx, size, hash, 'root/' || level || '/' || idx // 8 FROM outer_ WHERE size > 1),
climb AS (SELECT p.tree, p.idx, 0 AS step, p.start AS folded, CASE WHEN p.size > 1 THEN p.tree ELSE -1 END AS at_tree, 0 AS at_level, CASE WHEN p.size > 1 THEN p.idx ELSE p.tree END AS at_idx, '' AS proof FROM p
    UNION ALL SELECT c.tree, c.idx, max(c.step) + 1, sha256(string_agg(CASE WHEN r.idx = c.at_idx THEN c.folded ELSE r.hash END, '' ORDER BY r.idx)),
        CASE WHEN max(c.at_tree) >= 0 AND max(c.at_level) + 1 = max(t.height) THEN -1 ELSE max(c.at_tree) END,
        CASE WHEN max(c.at_tree) >= 0 AND max(c.at_level) + 1 = max(t.height) THEN 0 ELSE max(c.at_level) + 1 END,
        CASE WHEN max(c.at_tree) >= 0 AND max(c.at_level) + 1 = max(t.height) THEN c.tree ELSE max(c.at_idx) // 8 END,
        max(c.proof) || coalesce(string_agg(r.hash, '' ORDER BY r.idx) FILTER (r.idx <> c.at_idx), '')
    FROM climb c JOIN tops t ON t.tree = c.tree JOIN run r ON r.run = CASE WHEN c.at_tree < 0 THEN 'root' ELSE c.at_tree::VARCHAR END || '/' || c.at_level || '/' || c.at_idx // 8 GROUP BY c.tree, c.idx),
done AS (SELECT tree, idx, arg_max(folded, step) AS folded_root, arg_max(proof, step) AS proof FROM climb GROUP BY tree, idx),
root AS (SELECT arg_max(hash, level) AS root FROM outer_)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN done USING (tree, idx) JOIN tops USING (tree), root""",
    "op12_iterative_deepening_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 20 AS hit FROM conversations),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
r AS (SELECT conv_id, turn, role, text, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS letter, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i FROM e),
ins(q, added, price, q2, new_lines) AS (VALUES (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 5, 2, ['user:']), (0, 'II', 10, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 5, 2, ['user:']), (1, 'II', 10, 3, ['user:', 'assistant:']),
    (2, '', 0, 2, []), (2, 'I', 5, 3, ['assistant:']), (2, 'II', 10, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 5, 2, ['user:']), (3, 'II', 10, 3, ['user:', 'assistant:'])),
dp AS (SELECT DISTINCT conv_id, 0 AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM c
    UNION ALL SELECT conv_id, i + 1, q3, min(total), arg_min(way, lpad(total::VARCHAR, 9, '0') || way), arg_min(became, lpad(total::VARCHAR, 9, '0') || way) FROM (
        SELECT dp.conv_id, dp.i, CASE edit WHEN 'D' THEN q2 WHEN 'K' THEN CASE letter WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE q2 WHEN 2 THEN 3 ELSE 2 END END AS q3,
            cost + price + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END AS total, audit || added || edit AS way,
            lines || new_lines || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE q2 WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS became
        FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.i = dp.i + 1 JOIN ins USING (q) CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS edits(edit)
        WHERE edit = 'D' OR (fault IN ('', 'truncated') AND (edit = 'R' OR (letter = 's' AND q2 = 0) OR (letter = 'u' AND q2 <> 2) OR (letter = 'a' AND q2 = 2))))
    GROUP BY conv_id, i, q3),
n AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
fin AS (SELECT dp.conv_id, min(cost + price) AS cost, arg_min(audit || added, lpad((cost + price)::VARCHAR, 9, '0') || audit || added) AS audit, arg_min(lines || new_lines, lpad((cost + price)::VARCHAR, 9, '0') || audit || added) AS lines
    FROM dp JOIN n ON n.conv_id = dp.conv_id AND n.n = dp.i JOIN ins USING (q) WHERE q2 IN (0, 3) GROUP BY dp.conv_id),
pairs AS (SELECT conv_id, turn, fault, lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter AS pair FROM r),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM fin LEFT JOIN stat USING (conv_id)""",
    "op13_lsh_forest_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id WHERE ways.b > reach.root),
least AS (SELECT id AS doc_id, min(root) AS root FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

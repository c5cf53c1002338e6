"""One query opN_<name> per corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.llm import chat, decontaminate, html, langid, middle, minmax, packing, pii, quality, repair, simhash, sketch, substring
from isobarn.llm.common import table


def tokenizer_path() -> str:
    """The byte-level vocabulary; ISOBARN_TOKENIZER names another file."""
    if found := os.environ.get("ISOBARN_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.learned(pages))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_spans(documents, pii.selector(documents))
    counts = [F.expr(f"bigint(size(filter(_found.base, s -> s.kind = {i})))").alias(f"n_{kind}") for i, kind in enumerate(pii.BASE_KINDS)]
    base = F.sha2(pii.spans_text("_found.base"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.spans_text("_found.spans").alias("spans"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    kinds = [f.dataType.simpleString() for f in rows.schema]
    more = spark.sql(f"SELECT cast(a AS {kinds[0]}) AS conv_id, cast(b AS {kinds[1]}) AS turn, cast(c AS {kinds[2]}) AS role, cast(d AS {kinds[3]}) AS text FROM VALUES (-1, 0, 'user', '{fixed}'), (-1, 1, 'assistant', '{fixed}') AS f(a, b, c, d)")
    found = chat.read_back(chat.formatted(chat.canonical(rows.unionByName(more))))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.learned(documents))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = quality.trained(documents, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(documents, network)
    held_out = F.coalesce(~quality.learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    cuts = [F.col(f"{part}_units").alias(f"{part}_chars") for part in ("prefix", "middle")]
    return found.select("doc_id", "n", "form", *cuts, F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_minmax_near_dedup": op11_minmax_near_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL over the same tables.
ORACLE = {
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS r FROM documents),
s AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT gram FROM s GROUP BY gram HAVING count(*) > 1),
g AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM s JOIN d USING (gram))),
n AS (SELECT r, list(k) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (r)
""",
    "op6_benchmark_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (
  SELECT DISTINCT item, l, array_to_string(ws[i : i + l - 1], ' ') AS gram
  FROM (SELECT item, ws, least(len(ws), 13) AS l, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT l FROM g),
p AS (SELECT r, l, ws, unnest(range(1, len(ws) - l + 2)) AS i FROM w, ls WHERE len(ws) >= l),
h AS (SELECT p.r, p.i, p.l, g.item FROM (SELECT r, l, i, array_to_string(ws[i : i + l - 1], ' ') AS gram FROM p) p JOIN g ON p.gram = g.gram AND p.l = g.l),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
""",
    "op8_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
  replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '<|', '%3C|'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]') AS body,
  replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), '|', '%7C'), chr(10), '%0A') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(length(text) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(text, 1, a) AS head, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, CAST(i AS INT), 1)) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS what FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
s AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS r, body = '' AS blank, seen AND body <> '' AS dup,
    body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS cut, body = '' OR seen AS bad FROM o),
p AS (
  SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS more, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS wrong FROM s),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(dup::BIGINT) AS duplicate,
    sum(cut::BIGINT) AS truncated, sum(wrong::BIGINT) AS illegal, count(*) AS n FROM p GROUP BY conv_id),
-- least cost and string of edits from each of four states, from the last row on
v AS (
  SELECT conv_id, n AS i, {'c': 0::BIGINT, 'e': ''} AS q0, {'c': 6::BIGINT, 'e': 'II'} AS q1, {'c': 3::BIGINT, 'e': 'I'} AS q2, {'c': 0::BIGINT, 'e': ''} AS q3 FROM g
  UNION ALL
  SELECT conv_id, i - 1, least(w0, {'c': w2.c + 3, 'e': 'I' || w2.e}, {'c': w3.c + 6, 'e': 'II' || w3.e}), least(w1, {'c': w2.c + 3, 'e': 'I' || w2.e}, {'c': w3.c + 6, 'e': 'II' || w3.e}),
    least(w2, {'c': w3.c + 3, 'e': 'I' || w3.e}), least(w3, {'c': w2.c + 3, 'e': 'I' || w2.e})
  FROM (
    SELECT v.conv_id, v.i,
      least({'c': q0.c + 4, 'e': 'D' || q0.e}, CASE WHEN bad THEN {'c': 999999999999, 'e': ''} ELSE {'c': q2.c + more + 3, 'e': 'R' || q2.e} END,
        CASE WHEN bad OR r NOT IN ('s', 'u') THEN {'c': 999999999999, 'e': ''} WHEN r = 's' THEN {'c': q1.c + more, 'e': 'K' || q1.e} ELSE {'c': q2.c + more, 'e': 'K' || q2.e} END) AS w0,
      least({'c': q1.c + 4, 'e': 'D' || q1.e}, CASE WHEN bad THEN {'c': 999999999999, 'e': ''} ELSE {'c': q2.c + more + 3, 'e': 'R' || q2.e} END,
        CASE WHEN bad OR r <> 'u' THEN {'c': 999999999999, 'e': ''} ELSE {'c': q2.c + more, 'e': 'K' || q2.e} END) AS w1,
      least({'c': q2.c + 4, 'e': 'D' || q2.e}, CASE WHEN bad THEN {'c': 999999999999, 'e': ''} ELSE {'c': q3.c + more + 3, 'e': 'R' || q3.e} END,
        CASE WHEN bad OR r <> 'a' THEN {'c': 999999999999, 'e': ''} ELSE {'c': q3.c + more, 'e': 'K' || q3.e} END) AS w2,
      least({'c': q3.c + 4, 'e': 'D' || q3.e}, CASE WHEN bad THEN {'c': 999999999999, 'e': ''} ELSE {'c': q2.c + more + 3, 'e': 'R' || q2.e} END,
        CASE WHEN bad OR r <> 'u' THEN {'c': 999999999999, 'e': ''} ELSE {'c': q2.c + more, 'e': 'K' || q2.e} END) AS w3
    FROM v JOIN p ON p.conv_id IS NOT DISTINCT FROM v.conv_id AND p.i = v.i)),
best AS (SELECT conv_id, q0.c AS cost, q0.e AS audit FROM v WHERE i = 0),
-- the edits one after another: how many rows and how many repaired turns stand before each
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best),
m AS (
  SELECT conv_id, j, audit[j] AS e, length(replace(audit[1:j], 'I', '')) AS i, length(replace(audit[1:j], 'D', '')) AS place FROM l),
x AS (
  SELECT m.conv_id, m.j, m.e, m.place, p.role, p.text FROM m LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.i = m.i AND m.e <> 'I' WHERE m.e <> 'D'),
y AS (SELECT *, max(CASE WHEN place = 1 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM x),
a AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS repaired FROM y GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}

"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import cobuckets, collocations, decontam, langid, licenses, mixing, packing, pii, quality, sharding, simhash, substrings, tokencount
from .common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pack_mixed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_cobuckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cobuckets.co_bucket(documents(spark, sf_dir, "sales"), documents(spark, sf_dir, "sale_lines"))[1]


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_quality_rules, op4_decontamination, op5_token_counts, op6_best_fit_packing, op7_simhash, op8_pii, op9_sharding, op10_language_id, op11_mixture_packing, op12_cobuckets, op13_collocations)}


SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) i)),
least_doc AS (SELECT g, min(doc_id) m FROM win GROUP BY 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) p FROM win JOIN least_doc USING (g) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) p, unnest(ws) word FROM w)
SELECT w.doc_id, count(word) n_words, count(cov.p) n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (cov.p IS NULL), '')) kept_sha256
FROM w LEFT JOIN words ON words.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = words.doc_id AND cov.p = words.p GROUP BY 1
"""

QUALITY = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) g FROM w),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT doc_id, line, length(array_to_string(lw, '')) chars, len(lw) n, len(list_filter(lw, lambda x: x IN ('|', '»', '>', '·', '•', '/'))) bars,
    len(list_filter(lw, lambda x: regexp_matches(x, '[!?]{2,}$') OR regexp_matches(x, '[#*$%&|<>@^~={}\\]{2,}'))) odd,
    list_max(list_transform(list_distinct(lw), lambda x: len(list_filter(lw, lambda y: y = x)))) most,
    length(array_to_string(list_filter(lw, lambda x: regexp_matches(x, '^([a-z]+://|www\.)')), '')) links, regexp_matches(lw[-1], '[.!?…:;,"''”»)。！？؟।]$') ends FROM lines),
failed AS (SELECT *, (bars >= 3 AND bars * 5 >= n) OR 2 * links > chars OR (odd >= 2 AND odd * 4 >= n) OR NOT regexp_matches(line, '\pL') OR (n <= 3 AND NOT ends) OR (n >= 8 AND 2 * most > n)
    OR (n <= 30 AND regexp_matches(line, '(?i)all rights reserved|cookie policy|accept (?:all )?cookies|terms of (?:use|service)|privacy policy|click here|sign up|log ?in\b|subscribe (?:now|to)|share (?:this|on)|read more|skip to content|back to top|enable javascript|powered by|lorem ipsum|tous droits réservés|politique de confidentialité|accepter (?:tous )?les cookies|mentions légales|cliquez ici|lire la suite|alle rechte vorbehalten|datenschutzerklärung|impressum|cookies akzeptieren|hier klicken|weiterlesen|todos los derechos reservados|política de (?:privacidad|cookies)|aceptar (?:todas las )?cookies|aviso legal|haga clic aquí|leer más')) bad FROM judged),
sums AS (SELECT doc_id, count(*) - count(DISTINCT line) dup, coalesce(sum(chars) FILTER (bad), 0) lost, count(*) FILTER (bad) n_bad FROM failed GROUP BY 1),
base AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, '')) word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
    coalesce(dup, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(lost, 0) lost, coalesce(n_bad, 0) n_failed_lines FROM w LEFT JOIN sums USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= word_chars kept, n_failed_lines FROM base
"""

CONTAMINATION = r"""
WITH b AS (SELECT item_id::VARCHAR item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) wl, array_to_string(list_slice(ws, i, i + 9), ' ') g, least(len(ws), 10) n FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 8))) i) WHERE len(ws) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') g FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) i)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (g, n)),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1),
terms AS MATERIALIZED (SELECT g, unnest(wl) word, unnest(range(len(wl))) o FROM (SELECT DISTINCT g, wl FROM iw WHERE n >= 3)),
places AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(ws) word, unnest(range(len(ws))) p FROM d) SEMI JOIN terms USING (word)),
often AS (SELECT word, count(*) f FROM places GROUP BY 1),
ranked AS MATERIALIZED (SELECT g, word, o, row_number() OVER (PARTITION BY g ORDER BY coalesce(f, 0), o) r FROM terms LEFT JOIN often USING (word)),
three AS MATERIALIZED (SELECT a.g, a.word w1, b.word w2, b.o - a.o o2, c.word w3, c.o - a.o o3 FROM ranked a JOIN ranked b USING (g) JOIN ranked c USING (g) WHERE a.r = 1 AND b.r = 2 AND c.r = 3),
first AS MATERIALIZED (SELECT g, w2, o2, w3, o3, doc_id, p FROM three JOIN places ON word = w1),
close1 AS MATERIALIZED (SELECT DISTINCT g, w3, o3, doc_id, f.p FROM (SELECT g, w2, w3, o3, doc_id, p, unnest(range(p + o2 - 3, p + o2 + 4)) q FROM first) f JOIN places y USING (doc_id) WHERE y.word = w2 AND y.p = q),
close2 AS MATERIALIZED (SELECT DISTINCT g, doc_id, f.p FROM (SELECT g, w3, doc_id, p, unnest(range(p + o3 - 3, p + o3 + 4)) q FROM close1) f JOIN places y USING (doc_id) WHERE y.word = w3 AND y.p = q),
near AS (SELECT doc_id, count(*) n_near FROM close2 GROUP BY 1),
near_items AS (SELECT doc_id, count(*) n, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id FROM close2 JOIN iw USING (g)) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items.ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
    coalesce(n_near, 0)::BIGINT n_near, coalesce(near_items.n, 0) n_near_items, coalesce(near_items.ids, '') near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') ws FROM p),
totals AS (SELECT lang, sum(len(ws))::HUGEINT n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, g, count(*)::HUGEINT f FROM (SELECT lang, array_to_string(list_slice(ws, i, i + k - 1), ' ') g FROM w, (SELECT unnest([1, 2, 3, 4, 5]) k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) i)) GROUP BY 1, 2 HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT lang, g, f, string_split(g, ' ') ws FROM f WHERE contains(g, ' ')),
inner_ones AS (SELECT DISTINCT lang, unnest([array_to_string(ws[1:-2], ' '), array_to_string(ws[2:], ' ')]) g, f FROM c WHERE len(ws) > 2),
cuts AS (SELECT lang, g, f, k, array_to_string(list_slice(ws, 1, k), ' ') one, array_to_string(list_slice(ws, k + 1, len(ws)), ' ') two FROM c ANTI JOIN inner_ones USING (lang, g, f), LATERAL (SELECT unnest(range(1, len(ws))) k)),
scored AS (SELECT lang, cuts.g phrase, cuts.f a, a.f l, b.f r, n, (1000 * cuts.f * n) // (a.f * b.f) score FROM cuts JOIN f a USING (lang) JOIN f b USING (lang) JOIN totals USING (lang) WHERE a.g = one AND b.g = two
    QUALIFY row_number() OVER (PARTITION BY lang, cuts.g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n::BIGINT n, score::BIGINT score FROM scored QUALIFY rank <= 2000
"""


def license_sql() -> str:
    """The definition without index or frequencies: every place where a key phrase stands, with the share of the passage's words around it that are in place."""
    rows = ", ".join(f"({i}, '{label}', '{' '.join(body)}', '{' '.join(key)}')" for i, (label, body, key) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH t AS MATERIALIZED (SELECT tid, label, string_split(body, ' ') b, string_split(k, ' ') k FROM (VALUES {rows}) v(tid, label, body, k)),
keyed AS MATERIALIZED (SELECT *, list_position(list_transform(range(1, len(b) - len(k) + 2), lambda i: list_slice(b, i, i + len(k) - 1) = k), true) - 1 AS a, k[1] word FROM t),
d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) word, unnest(range(len(ws))) i FROM d),
phrases AS (SELECT string_split(p, ' ') p, split_part(p, ' ', 1) word, label FROM (VALUES ('mit license', 'mit'), ('apache license', 'apache'), ('general public license', 'gpl')) v(p, label)),
heads AS MATERIALIZED (SELECT doc_id, word, i FROM dw WHERE word IN (SELECT word FROM keyed UNION SELECT word FROM phrases)),
finds AS (SELECT doc_id, label, len(list_filter(range(len(b)), lambda j: i - a + j >= 0 AND coalesce(ws[i - a + j + 1] = b[j + 1], false))) / len(b) score
    FROM heads JOIN keyed USING (word) JOIN d USING (doc_id) WHERE list_slice(ws, i + 1, i + len(k)) = k),
places AS (SELECT doc_id, label, i AS s FROM heads JOIN phrases USING (word) JOIN d USING (doc_id) WHERE list_slice(ws, i + 1, i + len(p)) = p),
labelled AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM finds) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, CASE WHEN n > 0 THEN 0.5 ELSE 0 END)::DOUBLE score
FROM d LEFT JOIN (SELECT doc_id, count(*) n, min(s) first_word, max(s) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM places GROUP BY 1) USING (doc_id)
LEFT JOIN labelled USING (doc_id) LEFT JOIN (SELECT doc_id, max(score) score FROM finds GROUP BY 1) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """For the other queries SQL lacks a tokenizer, XXH64, match positions, a compressor or an iterative partition: tests hold them against brute force."""
    return {"op1_substring_dedup": SUBSTRINGS, "op2_license_scan": license_sql(), "op3_quality_rules": QUALITY, "op4_decontamination": CONTAMINATION, "op13_collocations": COLLOCATIONS}

"""The queries of the operators, each over its whole table with production parameters, and SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).drop("text_hash")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    placed = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), 400, texts=False).drop("kept_text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", 2, 4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), 35, texts=False).drop("kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, token_file_path, write_token_files

    path = token_file_path(spark)
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), "bytes", 0)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"), 4, 85)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back
    from .storage import written

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(written(format_conversations(turns), "chat"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, 10)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import digest, find_personal

    return digest(find_personal(_table(spark, sf_dir, "documents"), texts=False))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


QUERIES = {"op1_suffixes": op1_suffixes, "op2_packing": op2_packing, "op3_substrings": op3_substrings, "op4_token_files": op4_token_files, "op5_jaccard": op5_jaccard, "op6_chat": op6_chat, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_sharding": op9_sharding, "op10_neighbours": op10_neighbours, "op11_divergence": op11_divergence, "op12_codes": op12_codes, "op13_personal": op13_personal, "pipeline": pipeline}
#: SQL for DuckDB, exact and by comparing everything. The other operators need tokenizers, iterations or approximations that it lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_quality": """
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, host, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM d),
n AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k,
  translate(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM l),
common AS (SELECT host, norm FROM n GROUP BY host, norm HAVING count(DISTINCT text) > 20),
gone AS (SELECT doc_id, sum(k) AS removed FROM n JOIN common ON n.host IS NOT DISTINCT FROM common.host AND n.norm = common.norm GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
u AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 2], ' ')) AS k FROM u),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(j) WHERE k > 1 GROUP BY doc_id),
s AS (SELECT d.doc_id, len(words)::bigint AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
  coalesce(removed, 0)::bigint AS n_boilerplate_words FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= 0.3 * n_words AS kept FROM s""",
    "op1_suffixes": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM rep),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM runs UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN runs ON d.doc_id = runs.doc_id GROUP BY d.doc_id),
kept AS (SELECT d.doc_id, string_agg(hex(array_slice(b, f, t)), '' ORDER BY f) FILTER (t >= f) AS k FROM d JOIN cuts ON d.doc_id = cuts.doc_id GROUP BY d.doc_id),
gone AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id""",
    "op3_substrings": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 35) t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op5_jaccard": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.x""",
    "op6_chat": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
n AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(lag(role) OVER w, 'start') AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, regexp_replace(text, '<(!*)\\|', '<!\\1|', 'g') AS e, replace(replace(regexp_replace(role, '<(!*)\\|', '<!\\1|', 'g'), '\\', '\\\\'), chr(10), '\\n') AS er,
  (before, role) NOT IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS wrong FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(12 + length(er) + 1 + length(e) + 11)::bigint AS formatted_chars,
  NOT bool_or(wrong) AND arg_max(role, k) = 'assistant' AS ok, arg_min('turn ' || k || ': ' || chr(39) || role || chr(39) || ' after ' || before, k) FILTER (wrong) AS error FROM f GROUP BY conv_id""",
    "op9_sharding": """
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, octet_length(b)::bigint + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda p: ('0x' || p)::bigint)), lambda c, v: xor(c >> 8, codes[xor(c & 255, v) + 1])), 4294967295) AS text_crc32 FROM d, c),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total FROM x),
p AS (SELECT *, least(7, floor((2 * start + size) * 8 / (2 * total)))::int AS shard FROM s)
SELECT doc_id, size, text_crc32::bigint AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start, doc_id) - 1 AS slot, NULL::int AS grown_shard FROM p""",
    "op11_divergence": """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN n ON g.lang = n.lang AND g.source = n.source AND kept.term = n.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::hugeint AS p FROM counts JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::hugeint AS q FROM whole JOIN v USING (lang)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p - q)::bigint FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM found QUALIFY part = 'pair' OR rank <= 50""",
    "op12_codes": """
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT k, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM e, range(16) t(p)),
b0 AS (SELECT p, k AS entry, x AS c FROM parts WHERE k < 64),
a1 AS (SELECT k, parts.p, x, arg_min(entry, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry)) AS entry FROM parts JOIN b0 ON parts.p = b0.p GROUP BY k, parts.p, x),
s1 AS (SELECT p, entry, i, floor_div AS c FROM (SELECT p, entry, i, (sum(y) - ((sum(y) % count(*) + count(*)) % count(*))) // count(*) AS floor_div FROM (SELECT p, entry, unnest(x) AS y, unnest(range(len(x))) AS i FROM a1) GROUP BY p, entry, i)),
b1 AS (SELECT b0.p, b0.entry, coalesce(m.c, b0.c) AS c FROM b0 LEFT JOIN (SELECT p, entry, list(c::bigint ORDER BY i) AS c FROM s1 GROUP BY p, entry) m ON b0.p = m.p AND b0.entry = m.entry),
a2 AS (SELECT k, parts.p, x, arg_min(entry, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry)) AS entry FROM parts JOIN b1 ON parts.p = b1.p GROUP BY k, parts.p, x),
s2 AS (SELECT p, entry, i, (sum(y) - ((sum(y) % count(*) + count(*)) % count(*))) // count(*) AS c FROM (SELECT p, entry, unnest(x) AS y, unnest(range(len(x))) AS i FROM a2) GROUP BY p, entry, i),
b2 AS (SELECT b1.p, b1.entry, coalesce(m.c, b1.c) AS c FROM b1 LEFT JOIN (SELECT p, entry, list(c::bigint ORDER BY i) AS c FROM s2 GROUP BY p, entry) m ON b1.p = m.p AND b1.entry = m.entry),
far AS (SELECT k, parts.p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM parts JOIN b2 ON parts.p = b2.p),
a3 AS (SELECT k, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM far GROUP BY k, p),
coded AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM a3 GROUP BY k)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM b2) AS codebooks_sha256 FROM coded JOIN e USING (k)""",
    "op13_personal": """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
rules(ord, kind, base, score, boost, malus, words, against, pattern) AS (VALUES
  (1, 'email', true, 90, 10, 0, 'mail|email|contact|write|kontakt|correo', NULL, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'),
  (2, 'ip', true, 70, 20, 40, 'ip|host|server|addr|address|client', 'version|release|section|chapter', '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'),
  (3, 'card', true, 80, 20, 0, 'card|cards|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta', NULL, '[0-9]([\\x20-]?[0-9])+'),
  (4, 'phone', true, 80, 20, 0, 'phone|telephone|tel|telefon|telefono|mobile|mobil|movil|cell|call|fax|handy|anruf|appel', NULL, '\\+[0-9][\\x20().0-9-]+[0-9]'),
  (5, 'iban', false, 70, 30, 0, 'iban|bank|account|konto|compte|cuenta|bic|swift', NULL, '(?:NO)[0-9]{2}(?: ?[A-Z0-9]){11}|(?:BE)[0-9]{2}(?: ?[A-Z0-9]){12}|(?:DK|FI|FO|GL|NL)[0-9]{2}(?: ?[A-Z0-9]){14}|(?:MK|SI)[0-9]{2}(?: ?[A-Z0-9]){15}|(?:AT|BA|EE|KZ|LT|LU|XK)[0-9]{2}(?: ?[A-Z0-9]){16}|(?:CH|HR|LI|LV)[0-9]{2}(?: ?[A-Z0-9]){17}|(?:BG|BH|CR|DE|GB|GE|IE|ME|RS|VA)[0-9]{2}(?: ?[A-Z0-9]){18}|(?:AE|GI|IL|IQ|TL)[0-9]{2}(?: ?[A-Z0-9]){19}|(?:AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG)[0-9]{2}(?: ?[A-Z0-9]){20}|(?:PT)[0-9]{2}(?: ?[A-Z0-9]){21}|(?:IS|TR)[0-9]{2}(?: ?[A-Z0-9]){22}|(?:FR|GR|IT|MC|MR|SM)[0-9]{2}(?: ?[A-Z0-9]){23}|(?:AL|AZ|BY|CY|DO|GT|HU|LB|PL)[0-9]{2}(?: ?[A-Z0-9]){24}|(?:BR|EG|PS|QA|UA)[0-9]{2}(?: ?[A-Z0-9]){25}|(?:JO|KW|MU)[0-9]{2}(?: ?[A-Z0-9]){26}|(?:MT|SC)[0-9]{2}(?: ?[A-Z0-9]){27}|(?:LC)[0-9]{2}(?: ?[A-Z0-9]){28}'),
  (6, 'card', false, 30, 50, 0, 'card|cards|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta', NULL, '[0-9]([ ._/-]{0,2}[0-9])+'),
  (7, 'ssn', false, 40, 50, 0, 'ssn|social security|security number', NULL, '[0-9]{3}-[0-9]{2}-[0-9]{4}'),
  (8, 'phone', false, 30, 40, 0, 'phone|telephone|tel|telefon|telefono|mobile|mobil|movil|cell|call|fax|handy|anruf|appel', NULL, '[(]?[0-9]{2,5}[)]?([ ./-]{1,2}[0-9]{2,5}){1,4}')),
f AS (SELECT id, text, rules.* EXCLUDE (pattern), regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gaps FROM d, rules),
m AS (SELECT * EXCLUDE (ms, gaps), unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM f WHERE len(ms) > 0),
p AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY id, ord ORDER BY i) - length(m))::bigint AS s FROM m),
q AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS compact, string_split(m, '.') AS nums, string_split(m, '-') AS dashed,
  translate(substr(text, greatest(0, s - 50)::bigint + 1, least(50, s)::bigint) || '|' || substr(text, (s + length(m) + 1)::bigint, 25), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS around FROM p),
luhn AS (SELECT *, len(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(digits)), lambda k: CASE WHEN k % 2 = 0 THEN substr(digits, len(digits) - k, 1)::int ELSE (2 * substr(digits, len(digits) - k, 1)::int) // 10 + (2 * substr(digits, len(digits) - k, 1)::int) % 10 END)) % 10 = 0 AS is_card FROM q),
ok AS (SELECT *, CASE ord WHEN 1 THEN true WHEN 2 THEN len(list_filter(nums, lambda x: length(ltrim(x, '0')) > 3 OR ('0' || right(x, 3))::int > 255)) = 0 WHEN 3 THEN is_card WHEN 6 THEN is_card WHEN 4 THEN len(digits) BETWEEN 9 AND 15
  WHEN 5 THEN list_reduce(list_prepend(0, list_transform(string_split(substr(compact, 5) || substr(compact, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1
  WHEN 7 THEN dashed[1] NOT IN ('000', '666') AND dashed[1] < '900' AND dashed[2] <> '00' AND dashed[3] <> '0000' WHEN 8 THEN len(digits) BETWEEN 7 AND 12 END AS fine,
  score + CASE WHEN regexp_matches(around, '(^|[^a-z])(' || words || ')([^a-z]|$)') THEN boost ELSE 0 END - CASE WHEN against IS NOT NULL AND regexp_matches(around, '(^|[^a-z])(' || against || ')([^a-z]|$)') THEN malus ELSE 0 END AS total FROM luhn),
accepted AS (SELECT * FROM ok WHERE fine AND (base OR (total >= 60 AND NOT regexp_matches(substr(text, s::bigint, CASE WHEN s > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, (e + 1)::bigint, 1), '[A-Za-z0-9]')))),
spans AS (SELECT id, ord, base, s, e, kind, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) AS k FROM accepted a WHERE base OR NOT EXISTS (SELECT 1 FROM accepted b WHERE b.id = a.id AND b.ord < a.ord AND b.s < a.e AND a.s < b.e))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (base), '')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e), '') AS spans
FROM d LEFT JOIN spans USING (id) GROUP BY id""",
}

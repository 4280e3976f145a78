"""One query for each operator: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import brown, chat, decontaminate, jaccard, langid, licenses, merkle, mixing, packing, quality, secrets, spelling, warc
from evigraph.plans.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = brown.part(F.col("doc_id")) == 1
    model, counts = brown.fit(docs.where(~held_out))
    return brown.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit(spark, secrets.example_findings(secrets.sample_texts(docs)))
    return secrets.scan(docs, model).drop("row_hash")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.part(F.col("doc_id"), 4) == 2
    return langid.identify(docs, held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(materialize(chat.pieces(conversations), "chat"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), received=F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_score": op1_brown_score,
    "op2_quality_outliers": op2_quality_outliers,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_pattern_packing": op11_pattern_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Words with A-Z as a-z.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+')"
RUN = "array_to_string(list_slice(w, i, i + {k} - 1), ' ')"

#: CRC-32: its table by rule, as a row ``crc(tbl)``; then of a list of byte values ``{b}``, a byte at a time.
CRC_TABLE = "crc AS (SELECT list(t ORDER BY k) AS tbl FROM (SELECT k, list_reduce(list_prepend(k::BIGINT, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS t FROM range(256) z(k)))"
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"

PLAIN = WORDS.replace("[^ \\x09-\\x0D]+", "[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")
_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c if c != "text" else "({t})") for c in merkle.COLUMNS) + ")"
_VALUES = ", ".join("('{}', '{}')".format(f"{a}/{b}", c.replace("'", "''")) for a, b, c in licenses.TEMPLATES)

ORACLES: dict[str, str] = {
    "op4_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS size, md5('{mixing.SEED}' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM z),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, sid)),
g AS (SELECT *, level <= cap / weight AS free FROM f),
t AS (SELECT source, source_size, sid, CASE WHEN free THEN weight * (SELECT level FROM g WHERE free ORDER BY cap / weight, sid LIMIT 1) ELSE cap END::DOUBLE AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, floor(t.target)::BIGINT AS stop,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT sid, t.target, ceil(floor(t.target) / {mixing.BLOCK})::BIGINT AS need FROM t),
q AS (SELECT *, floor(sum(target) OVER (ORDER BY sid) / (SELECT sum(target) FROM n) * {1 << mixing.UNIT_BITS})::BIGINT AS upto, row_number() OVER (ORDER BY sid DESC) AS back FROM n),
b AS (SELECT sid, need, coalesce(lag(CASE back WHEN 1 THEN {1 << mixing.UNIT_BITS} ELSE upto END) OVER (ORDER BY sid), 0) AS begin, CASE back WHEN 1 THEN {1 << mixing.UNIT_BITS} ELSE upto END AS stop FROM q),
u AS (SELECT slot, (slot::HUGEINT * {mixing.STEP} % {1 << mixing.UNIT_BITS})::BIGINT AS u FROM (SELECT unnest(range(coalesce((SELECT sum(need) FROM n), 0)::BIGINT)) AS slot)),
k AS (SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM u JOIN b ON u.u >= b.begin AND u.u < b.stop WHERE need > 0),
o AS (SELECT n.sid, n.need, coalesce(c, 0) AS got FROM n LEFT JOIN (SELECT sid, count(*) AS c FROM k GROUP BY sid) x ON x.sid = n.sid),
e AS (SELECT *, coalesce(sum(greatest(need - got, 0)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(need) OVER () AS m FROM o),
l AS (SELECT slot, sid, rank FROM k WHERE rank < need UNION ALL SELECT (m + prior - got + rank)::BIGINT, sid, rank FROM e, LATERAL (SELECT unnest(range(got, need)) AS rank)),
y AS (SELECT p.*, row_number() OVER () AS rn FROM p),
h AS (SELECT rn, y.sid, a + j * source_size AS x, least(a + j * source_size + size, stop) AS z FROM y, (VALUES (0), (1), (2)) v(j)),
r AS (SELECT rn, sid, z - x AS words, x // {mixing.BLOCK} AS lo, (z - 1) // {mixing.BLOCK} AS hi FROM h WHERE z > x),
v AS (SELECT rn, min(slot) AS first_slot, count(*) AS n_pieces FROM (SELECT rn, sid, unnest(range(lo, hi + 1)) AS rank FROM r) JOIN l USING (sid, rank) GROUP BY rn)
SELECT doc_id, size, source_size, target, (greatest(least(a + size, stop) - a, 0) + greatest(least(a + size, stop - source_size) - a, 0) + greatest(least(a + size, stop - 2 * source_size) - a, 0))::BIGINT AS taken,
  first_slot, coalesce(n_pieces, 0) AS n_pieces FROM y LEFT JOIN v USING (rn)""",
    "op5_license_scan": f"""
WITH t(template, text) AS (VALUES {_VALUES}),
tw AS (SELECT template, {PLAIN} AS w FROM t),
tk AS (SELECT template, w, least(5, len(w)) AS k FROM tw WHERE len(w) > 0),
ts AS (SELECT DISTINCT template, k, {RUN.format(k="k")} AS s FROM tk, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
tn AS (SELECT template, count(*) AS n_shingles FROM ts GROUP BY template),
d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM tk),
ds AS (SELECT DISTINCT doc_id, k, {RUN.format(k="k")} AS s FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
m AS (SELECT doc_id, template, count(*) AS n_shared FROM ds JOIN ts USING (k, s) GROUP BY ALL)
SELECT doc_id, split_part(template, '/', 1) AS license, template, n_shared, n_shingles FROM m JOIN tn USING (template) WHERE n_shared >= 0.75 * n_shingles""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op7_decontaminate": f"""
WITH it AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM it WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, {RUN.format(k="k")} AS s FROM iw, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
isz AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM iw),
dsh AS (SELECT DISTINCT doc_id, k, {RUN.format(k="k")} AS s FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
m AS (SELECT dsh.doc_id, ish.item_id, count(*) AS n_shared FROM dsh JOIN ish ON dsh.k = ish.k AND dsh.s = ish.s GROUP BY ALL)
SELECT m.doc_id, m.item_id, m.n_shared, isz.n_shingles FROM m JOIN isz USING (item_id) WHERE m.n_shared >= 0.75 * isz.n_shingles""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, sha256(text) AS o,
  len(regexp_replace(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<\|role\|>|<\|text\|>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS n,
  len(regexp_replace(regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|<\|role\|>|<\|text\|>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, o)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, o) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(CASE role WHEN 'user' THEN n + 13 WHEN 'assistant' THEN n + 4 ELSE r + n + 20 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
dk AS (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, {RUN.format(k="k")} AS s FROM dk, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT x AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[{spelling.LETTERS}]{{{spelling.LEAST_LENGTH},}}')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
g AS (SELECT doc, run, count(*) AS c FROM o GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS bytes FROM g),
h AS (SELECT run, c, {CRC32.format(b="bytes")} AS h FROM b, crc),
r AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM r WHERE len(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {spelling.LEAST_COUNT}),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS u FROM v, LATERAL (SELECT unnest(range(len(word)))::INT AS i)),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.u = y.u AND x.word <> y.word UNION SELECT d.word, v.word FROM d JOIN v ON d.u = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.u = v.word),
k AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS place, count(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON b = v.word),
f AS (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= {spelling.RATIO} * v.n THEN k.b END AS form, CASE WHEN k.n >= {spelling.RATIO} * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON v.word = k.a AND place = 1),
t AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE},
v AS (SELECT row_number() OVER () AS rn, documents.*, coalesce({CRC32.format(b="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 2 = 0, false) AS bad FROM documents, crc),
x AS (SELECT rn, doc_id, source, {_LEAF.format(t="text")} AS leaf, {_LEAF.format(t="CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END")} AS other FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS place FROM x),
t AS (SELECT source, 0 AS level, place AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM y
  UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, i // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place AS i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3),
a AS (SELECT source, 1 AS up, level, i, h, n FROM t UNION ALL SELECT '' AS source, 2, level, i, h, n FROM u),
g AS (SELECT up, source, level, i // 3 AS j, list(h ORDER BY i) AS run FROM a WHERE n > 1 GROUP BY ALL),
d AS (SELECT source, max(level) AS levels FROM t GROUP BY source),
p AS (SELECT y.rn, y.doc_id, y.source, y.leaf, y.place, s.subroot, s.place AS splace, d.levels, y.other AS h, 0 AS k, '' AS proof
  FROM y JOIN s ON y.source IS NOT DISTINCT FROM s.source JOIN d ON y.source IS NOT DISTINCT FROM d.source
  UNION ALL SELECT p.rn, p.doc_id, p.source, p.leaf, p.place, p.subroot, p.splace, p.levels,
    sha256(array_to_string(list_slice(run, 1, o), '') || p.h || array_to_string(list_slice(run, o + 2, 3), '')), k + 1, proof || array_to_string(list_slice(run, 1, o), '') || array_to_string(list_slice(run, o + 2, 3), '')
  FROM (SELECT *, CASE WHEN k < levels THEN place // (3 ** k)::BIGINT ELSE splace // (3 ** (k - levels))::BIGINT END AS own, own % 3 AS o FROM p) p
  JOIN g ON g.up = CASE WHEN k < levels THEN 1 ELSE 2 END AND g.level = CASE WHEN k < levels THEN k ELSE k - levels END AND g.j = own // 3 AND (k >= levels OR g.source IS NOT DISTINCT FROM p.source)),
w AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY k DESC) AS last FROM p),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM w, r WHERE last = 1""",
}

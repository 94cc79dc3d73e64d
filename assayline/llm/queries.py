"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import decontam, licenses, mixing, packing, quality, runs, simhash, substring, toxicity, trie, urls, vectors, warc
from assayline.llm.common import LOWER, UPPER, durable, fold_of, table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def held_out(folds: int, fold: int):
    """Whether a document's labels are kept from learning; a null id is in no fold."""
    return F.coalesce(fold_of(F.col("doc_id"), folds) == fold, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return found.withColumn("headers", F.array_join(lines, ";"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = quality.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ~held_out(5, 0))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ~held_out(4, 2))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of the hundred's first conversation, then one's own after h."""
    turns = durable(turns)
    own = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = own.select("conv_id", F.col("n").alias("own_n"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("had", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = durable(convs.select("conv_id", "base", "h", "had", (F.col("had") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("n")))
    heads = turns.where("pos < 5").select(F.col("conv_id").alias("base"), "pos", F.col("h").alias("digest"), "chars").join(convs, "base").where("pos < had").select("conv_id", "pos", F.col("digest").alias("h"), "chars")
    rest = turns.select("conv_id", "pos", F.col("h").alias("digest"), "chars").join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("had")).alias("pos"), F.col("digest").alias("h"), "chars")
    return heads.unionByName(rest), convs.select("conv_id", "n")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = trie.prefix_trie(*_rebuilt(trie.ordered_turns(table(spark, sf_dir, "conversations"))))
    digests = trie.end_digests(ends).select(F.col("end_conv_id").alias("conv_id"), "depth", "ends_sha256")
    return nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(trie.EMPTY_SHA256)))


def _planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the contract's periodic endings in about a tenth of the texts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    a = g % F.nullif(n, F.lit(0))  # a text without words has no place
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8))
    mine = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("a", a.cast("int")).withColumn("p", p.cast("int"))
    i = F.sequence(F.lit(0), n - 1)
    made = F.array_join(F.transform(i, lambda k: F.get("w", F.when(k < F.col("a"), k).otherwise(F.col("a") + (k - F.col("a")) % F.col("p")))), " ")
    return mine.select("doc_id", F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # exact comparison of length / period by cross products
    ahead = F.array_sort("runs", lambda x, y: F.when(x.length * y.period != y.length * x.period, F.when(x.length * y.period > y.length * x.period, -1).otherwise(1)).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0)))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    best = F.get(ahead, 0)
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least USING (s) WHERE win.doc_id > lo)),
each AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""

_OP3 = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, '"' || md5(coalesce(html, '') || CASE WHEN page_id % 11 = 5 THEN 'changed' ELSE '' END) || '"' AS tag2, strftime(to_timestamp(page_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS day, strftime(to_timestamp(page_id * 60 + 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS later,
    regexp_replace(regexp_replace(trim(url), '(?s)#.*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), '@UPPER', '@LOWER'), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(.)/+$', '\1') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda x: x != '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))), '&') AS query FROM p),
u AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM q),
full_ AS (SELECT page_id * 2 AS record_id, canonical_url, page_id * 60 AS t, tag, day FROM u WHERE page_id % 7 != 3),
again AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, page_id * 60 + 86400 AS t, CASE WHEN page_id % 5 = 4 OR page_id % 13 = 6 THEN NULL WHEN page_id % 2 = 1 THEN 'W/' || tag2 ELSE tag2 END AS tag, CASE WHEN page_id % 13 = 6 THEN NULL WHEN page_id % 11 = 5 THEN later ELSE day END AS modified, later FROM u),
latest AS (SELECT canonical_url, t, max(record_id) AS ref_id FROM full_ WHERE canonical_url IS NOT NULL GROUP BY ALL),
found AS (SELECT a.*, l.ref_id FROM again a ASOF LEFT JOIN latest l ON a.canonical_url = l.canonical_url AND a.t > l.t),
judged AS (
  SELECT f.*, r.tag AS tag0, r.day AS day0,
    CASE WHEN ref_id IS NULL THEN 'missing' WHEN f.tag IS NOT NULL THEN CASE WHEN regexp_replace(f.tag, '^W/', '') = r.tag THEN 'resolved' ELSE 'mismatch' END WHEN f.modified = r.day THEN 'resolved' WHEN f.modified IS NOT NULL THEN 'mismatch' ELSE 'unchecked' END AS outcome
  FROM found f LEFT JOIN full_ r ON f.ref_id = r.record_id)
SELECT record_id, canonical_url, 'response' AS kind, record_id AS ref_id, 'full' AS outcome, 'content-type=text/html;date=' || day || ';etag=' || tag || ';last-modified=' || day AS headers FROM full_
UNION ALL
SELECT record_id, canonical_url, 'revisit', ref_id, outcome,
  'content-type=' || CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'text/html' ELSE 'none' END || ';date=' || later
    || coalesce(';etag=' || coalesce(tag, CASE WHEN outcome IN ('resolved', 'unchecked') THEN tag0 END), '') || coalesce(';last-modified=' || coalesce(modified, CASE WHEN outcome IN ('resolved', 'unchecked') THEN day0 END), '')
FROM judged
""".replace("@UPPER", UPPER).replace("@LOWER", LOWER)

_OP8 = r"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>') AS link, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>') AS meta
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
target AS (
  SELECT url, trim(replace(t, '&amp;', '&')) AS t FROM (
    SELECT url, unnest([coalesce(nullif(regexp_extract(link, '(?is)\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(link, '(?is)\bhref\s*=\s*''([^'']*)''', 1), ''), regexp_extract(link, '(?is)\bhref\s*=\s*([^\s"''>]+)', 1)), regexp_extract(meta, '(?is)\burl\s*=\s*[''"]?\s*([^''"\s>;]+)', 1)]) AS t FROM tags) WHERE t != ''),
base AS (SELECT *, regexp_extract(url, '^[^:/?#]+:') AS scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS origin, regexp_extract(url, '^[^?#]*') AS plain FROM target),
resolved AS (
  SELECT url, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN plain || t WHEN plain = origin THEN origin || '/' || t ELSE regexp_extract(plain, '(?s)^.*/') || t END AS t FROM base),
bare AS (SELECT regexp_replace(url, '(?s)#.*', '') AS u, regexp_replace(t, '(?s)#.*', '') AS v FROM resolved WHERE t IS NOT NULL),
e AS (SELECT translate(regexp_extract(u, '^[^/?]*://[^/?]*'), '@UPPER', '@LOWER') || substr(u, 1 + length(regexp_extract(u, '^[^/?]*://[^/?]*'))) AS a, translate(regexp_extract(v, '^[^/?]*://[^/?]*'), '@UPPER', '@LOWER') || substr(v, 1 + length(regexp_extract(v, '^[^/?]*://[^/?]*'))) AS b FROM bare),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
urls AS (SELECT url, 'p' AS k, page_id FROM pages UNION ALL SELECT a, 'n', NULL FROM (SELECT DISTINCT a FROM both_)),
rest AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM urls),
parts AS (SELECT *, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), '@UPPER', '@LOWER') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ruled AS (
  SELECT k, url, page_id, host, path, (SELECT arg_max({'rule': h || p, 'action': action}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS m FROM parts),
reach AS (SELECT url AS a FROM ruled WHERE k = 'n' AND m.action = 'block' UNION SELECT both_.b FROM reach JOIN both_ USING (a))
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.action, CASE WHEN (translate(regexp_extract(regexp_replace(url, '(?s)#.*', ''), '^[^/?]*://[^/?]*'), '@UPPER', '@LOWER') || substr(regexp_replace(url, '(?s)#.*', ''), 1 + length(regexp_extract(regexp_replace(url, '(?s)#.*', ''), '^[^/?]*://[^/?]*')))) IN (SELECT a FROM reach) THEN 'block' END, 'allow') AS verdict
FROM ruled WHERE k = 'p'
""".replace("@UPPER", UPPER).replace("@LOWER", LOWER)

_OP9 = (
    "WITH t0 AS (SELECT * FROM (VALUES "
    + ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)
    + rf""") AS v(license, text)),
t AS (SELECT license, {_WORDS} AS w FROM t0),
s AS (SELECT DISTINCT license, len(w) AS half, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
size AS (SELECT license, count(*) AS n FROM s GROUP BY license),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, i - 1 AS p, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
hit AS (SELECT doc_id, license, half, p, s, unnest([p // half, p // half - 1]) AS k FROM pos JOIN s USING (s)),
c AS (SELECT doc_id, license, half, k, count(DISTINCT s) AS n FROM hit WHERE k >= 0 AND p + 5 <= (k + 2) * half GROUP BY ALL)
SELECT doc_id, license, max(c.n / size.n) AS containment, count(*) AS windows, min(k * half)::BIGINT AS first_word
FROM c JOIN size USING (license) WHERE c.n / size.n >= 0.8 GROUP BY doc_id, license
"""
)

_OP10 = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS s FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(k)),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][sid % 3 + 1] AS weight FROM s0),
-- sources fill up in order of size by weight; the level is that of the first which doesn't
s2 AS (SELECT *, sum(2 * size) OVER w - 2 * size AS room, sum(weight) OVER (ORDER BY size / weight DESC, sid DESC) AS open, 2 * size / weight AS own FROM s1 WINDOW w AS (ORDER BY size / weight, sid)),
level AS (SELECT coalesce(min((1.5::DOUBLE * (SELECT sum(size) FROM s1) - room) / open), 0) AS l FROM (SELECT * FROM s2 WHERE own > (1.5::DOUBLE * (SELECT sum(size) FROM s1) - room) / open ORDER BY own LIMIT 1)),
s3 AS (SELECT *, least(2::DOUBLE * size, l * weight) AS target FROM s1, level),
q1 AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, sid, j) AS place FROM s3, unnest(range(1, size // 4 + 9)) AS r(j) WHERE target > 0),
s4 AS (SELECT s3.*, coalesce(k, 0) AS blocks, greatest(1, ceil(n / 4096))::BIGINT AS shards FROM s3 LEFT JOIN (SELECT sid, count(*) AS k FROM q1 WHERE place <= floor(1.5::DOUBLE * (SELECT sum(size) FROM s1) / 16 + 0.5) GROUP BY sid) USING (sid)),
e AS (SELECT doc_id, d.size, h, sid, s4.size AS source_size, target, blocks, h % shards AS shard FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
f AS (SELECT *, sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS pos, sum(size) OVER (PARTITION BY sid, shard) AS ring FROM e),
h AS (SELECT DISTINCT sid, shard, ring, blocks FROM f),
q2 AS (SELECT sid, shard, blocks, row_number() OVER (PARTITION BY sid ORDER BY ring / (2 * j - 1) DESC, shard, j) AS place FROM h, unnest(range(1, (ring // 4)::BIGINT + 9)) AS r(j) WHERE ring > 0),
k AS (SELECT sid, shard, count(*) AS quota FROM q2 WHERE place <= blocks GROUP BY ALL),
g AS (SELECT f.*, least(coalesce(quota, 0) * 16, 2 * ring) AS given, 16 * (('0x' || substr(md5('42|' || sid || '|' || shard), 1, 15))::BIGINT % greatest(1, ceil(ring / 16))::BIGINT) AS start FROM f LEFT JOIN k USING (sid, shard))
SELECT doc_id, size, source_size, target, (greatest(0, least(pos + size, start + given) - greatest(pos, start)) + greatest(0, least(pos + ring + size, start + given) - greatest(pos + ring, start)) + greatest(0, least(pos + 2 * ring + size, start + given) - greatest(pos + 2 * ring, start)))::BIGINT AS taken FROM g
"""

#: crc32 of the text @T.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(@T, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"

_OP12 = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, conv_id - conv_id % 100 AS base, {_CRC32.replace("@T", "conv_id::VARCHAR")} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS had FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, i, role, text FROM k JOIN t ON t.conv_id = base AND i < had UNION ALL SELECT k.conv_id, i - h + had, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND i >= h),
seq AS (SELECT k.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS s FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
pre AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM seq, unnest(range(len(s) + 1)) AS u(d)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (p)),
below AS (SELECT u.a AS d, f.p[1:u.a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * chars) AS saved FROM full_ f, unnest(range(f.d + 1)) AS u(a) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN below USING (p, d) LEFT JOIN node up ON f.d > 0 AND up.p = f.p[1:f.d - 1]
"""

_OP13 = rf"""
WITH h0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32.replace("@T", "doc_id::VARCHAR")} AS h FROM documents),
h AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM h0),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
each AS (SELECT doc_id, n, i, w[i + 1] AS word FROM d, unnest(range(n)) AS r(i)),
eq AS (SELECT x.doc_id, x.n, y.i - x.i AS q, x.i FROM each x JOIN each y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS k, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_dedup, op3_revisit_resolution, op4_quality, op5_simhash_dedup, op6_packing, op7_toxicity, op8_url_filter, op9_license_scan, op10_decontamination, op11_source_mix, op12_prefix_trie, op13_periodic_runs)}
ORACLE_SQL = {"op1_substring_dedup": _OP1, "op2_embedding_dedup": _OP2, "op3_revisit_resolution": _OP3, "op8_url_filter": _OP8, "op9_license_scan": _OP9, "op10_decontamination": _OP10, "op11_source_mix": _OP11, "op12_prefix_trie": _OP12, "op13_periodic_runs": _OP13}

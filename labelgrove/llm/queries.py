"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrove.llm.byte_repeats import remove_byte_repeats
from labelgrove.llm.catalog import query
from labelgrove.llm.class_lm import score
from labelgrove.llm.common import table
from labelgrove.llm.decontaminate import contamination
from labelgrove.llm.language import identify
from labelgrove.llm.lexical import search
from labelgrove.llm.licences import licence_findings
from labelgrove.llm.merkle import manifest
from labelgrove.llm.near_dedup import near_duplicates
from labelgrove.llm.pack import pack
from labelgrove.llm.repeats import kept_hash, remove_repeats
from labelgrove.llm.secrets import secret_findings
from labelgrove.llm.topk import top_k
from labelgrove.llm.url_filter import host_of, listed

#: ASCII-only lower case of a column.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BENCH_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op3_near_duplicates", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WHITE_WORDS.format(LOWER.format('text'))} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION
  SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least USING (doc_id)""")
def _near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_decontamination", f"""
WITH d AS (SELECT doc_id, {BENCH_WORDS.format(LOWER.format('text'))} AS w FROM documents),
b AS (SELECT item_id, {BENCH_WORDS.format(LOWER.format('text'))} AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 10) AS size,
        unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS pattern
      FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM p),
x AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT x.doc_id, x.pos, x.size, p.item_id FROM x JOIN p
         ON x.size = p.size AND array_to_string(x.w[x.pos:x.pos + x.size - 1], ' ') = p.pattern),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit
          FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def _decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_substring_dedup", f"""
WITH d AS (SELECT doc_id, {WHITE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS win FROM x),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM f WHERE nth > 1),
gone_list AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
        CASE WHEN places IS NULL THEN w ELSE
          list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN gone_list USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def _substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", kept_hash().alias("kept_sha256"))


@query("op2_best_fit_packing")
def _best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op5_exact_top_k", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
             embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def _exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op6_url_filter", r"""
WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS host,
             regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path,
             DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages),
hosts AS (SELECT DISTINCT host, CAST(('0x' || substr(md5(host), 1, 6)) AS BIGINT) AS h FROM u WHERE host <> ''),
entries AS (
  SELECT CASE WHEN regexp_matches(host, 'casino|bets') THEN 'gambling' ELSE 'adult' END AS list, host AS pattern,
         DATE '2024-01-01' + CAST(h % 180 AS INTEGER) AS since,
         CASE WHEN h % 3 = 0 THEN DATE '2024-01-01' + CAST(h % 180 + 1 + h % 150 AS INTEGER) END AS until
  FROM hosts WHERE regexp_matches(host, 'casino|bets') OR h % 10 = 0
  UNION ALL
  SELECT 'language', host || '/fr', DATE '2024-01-01' + CAST(h % 200 AS INTEGER), NULL FROM hosts WHERE h % 4 = 1),
keys AS (SELECT page_id, day, unnest(list_distinct(list_concat(
           list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
             lambda i: array_to_string(string_split(host, '.')[i:], '.')),
           list_transform(range(1, len(string_split(path, '/')) + 1),
             lambda i: host || array_to_string(string_split(path, '/')[1:i], '/'))))) AS key FROM u WHERE host <> ''),
hits AS (SELECT page_id, list, pattern, since,
           row_number() OVER (PARTITION BY page_id, list ORDER BY len(pattern) DESC, pattern DESC, since DESC) AS nth
         FROM keys JOIN entries ON key = pattern AND since <= day AND (until IS NULL OR day < until))
SELECT page_id, list, pattern, since FROM hits WHERE nth = 1""")
def _url_filter(spark, sf_dir):
    """Captures are the pages, fetched on days that follow from their ids; the dated lists name
    hosts and paths of the pages, with days that follow from the hosts."""
    pages = table(spark, sf_dir, "pages")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select(F.col("page_id").alias("id"), "url", day(F.col("page_id") % 366).alias("at"))
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct().withColumn("h", h)
    bets = F.col("host").rlike("casino|bets")
    named = hosts.where(bets | (F.col("h") % 10 == 0)).select(
        F.when(bets, "gambling").otherwise("adult").alias("list"), F.col("host").alias("pattern"), "h")
    language = hosts.where("h % 4 = 1").select(
        F.lit("language").alias("list"), F.concat("host", F.lit("/fr")).alias("pattern"), F.lit("add").alias("action"),
        day(F.col("h") % 200).alias("at"))
    added = named.select("list", "pattern", F.lit("add").alias("action"), day(F.col("h") % 180).alias("at"))
    removed = named.where("h % 3 = 0").select(
        "list", "pattern", F.lit("remove").alias("action"), day(F.col("h") % 180 + 1 + F.col("h") % 150).alias("at"))
    found = listed(captures, added.unionByName(removed).unionByName(language))
    return found.select(F.col("id").alias("page_id"), "list", "pattern", "since")


@query("op8_language_id")
def _language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


@query("op9_lm_scoring")
def _lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


@query("op1_secret_scans")
def _secret_scans(spark, sf_dir):
    return secret_findings(table(spark, sf_dir, "documents"))


@query("op10_licence_scans")
def _licence_scans(spark, sf_dir):
    return licence_findings(table(spark, sf_dir, "documents"))


#: `doc_id` etc. as the manifest encodes them.
ENCODED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = " || ".join(ENCODED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 of a decimal id, a bit at a time.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
FOLDED = LOWER.format("text").replace("coalesce(text, '')", "text")


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes and siblings of the trees over `leaves(t, i, n, h)`; i and n count the nodes of a level."""
    return f"""
{name} AS (SELECT t, 0 AS lv, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, h FROM {leaves}
  UNION ALL SELECT t, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY t, lv, i // 8),
{name}_sib AS (SELECT a.t, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM {name} a LEFT JOIN {name} b ON a.t = b.t AND a.lv = b.lv AND a.i // 8 = b.i // 8 AND a.i <> b.i WHERE a.n > 1 GROUP BY 1, 2, 3)"""


def _climb_sql(name: str, start: str, tree: str) -> str:
    """Every leaf of `start(doc_id, t, i, proof, node)` climbs to the root of its tree."""
    return f"""
{name} AS (SELECT doc_id, t, 0 AS lv, CAST(i AS BIGINT) AS i, proof, node FROM {start}
  UNION ALL SELECT c.doc_id, c.t, c.lv + 1, c.i // 8, c.proof || s.l || s.r, sha256(s.l || c.node || s.r)
  FROM {name} c JOIN {tree}_sib s ON c.t = s.t AND c.lv = s.lv AND c.i = s.i)"""


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({LEAF} || {ENCODED.format('text')}) AS leaf,
    CASE WHEN {CRC} % 3 = 0 THEN sha256({LEAF} || {ENCODED.format('(' + FOLDED + ')')})
      ELSE sha256({LEAF} || {ENCODED.format('text')}) END AS bad FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
low AS (SELECT t, i, n, leaf AS h FROM r), {_tree_sql('nodes', 'low')},
tops AS (SELECT '' AS t, t AS name, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql('forest', 'tops')},
starts AS (SELECT doc_id, t, i, '' AS proof, bad AS node FROM r), {_climb_sql('climb', 'starts', 'nodes')},
inner_end AS (SELECT doc_id, t, arg_max(proof, lv) AS proof, arg_max(node, lv) AS node FROM climb GROUP BY 1, 2),
again AS (SELECT e.doc_id, '' AS t, tops.i, e.proof, e.node FROM inner_end e JOIN tops ON e.t = tops.name),
{_climb_sql('climb_top', 'again', 'forest')},
fin AS (SELECT doc_id, arg_max(proof, lv) AS proof, arg_max(node, lv) AS node FROM climb_top GROUP BY 1)
SELECT r.doc_id, r.leaf, tops.h AS subroot, (SELECT h FROM forest WHERE n = 1) AS root, sha256(fin.proof) AS proof_sha256,
  fin.node AS folded_root, fin.node = (SELECT h FROM forest WHERE n = 1) AS verified
FROM r JOIN tops ON r.t = tops.name JOIN fin ON r.doc_id = fin.doc_id""")
def _merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_lexical_search", f"""
WITH d AS (SELECT doc_id, {TERMS.format(LOWER.format('text'))} AS w FROM documents),
size AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
q AS (SELECT item_id, unnest(list_distinct({TERMS.format(LOWER.format('text'))})) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM df, total),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""")
def _lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_byte_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 399)) AS i, x FROM d WHERE len(x) >= 800),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM w) y),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE n > 1),
g AS (SELECT doc_id, i, count(*) FILTER (WHERE p IS NULL OR i > p + 400) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
k AS (SELECT s.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s) s JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def _byte_dedup(spark, sf_dir):
    kept = remove_byte_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

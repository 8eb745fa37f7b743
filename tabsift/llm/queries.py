"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.llm.common import LOWER, UPPER, prepared
from tabsift.llm.decontam import contaminated
from tabsift.llm.embeddings import near_vectors
from tabsift.llm.fst import token_counts
from tabsift.llm.jaccard import similar_documents
from tabsift.llm.langid import identify
from tabsift.llm.lexical import search
from tabsift.llm.lm import score_documents
from tabsift.llm.packing import pack_documents
from tabsift.llm.repair import audit_damaged
from tabsift.llm.secrets import KINDS, scan_secrets
from tabsift.llm.sharding import shard
from tabsift.llm.suffixes import remove_repeats
from tabsift.llm.warc import archive

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- 1: language ID ---------------------------------------------------------------------------

@query
def op1_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


# ---- 2: best-fit packing ------------------------------------------------------------------------

@query
def op2_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


# ---- 3: language-model scoring ------------------------------------------------------------------

@query
def op3_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


# ---- 4: token counts ----------------------------------------------------------------------------

@query
def op4_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


# ---- 5: benchmark decontamination ---------------------------------------------------------------

@query
def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("_mark")


def shingle_sql(source: str, id: str, lower: str = "lower(coalesce(text, ''))") -> str:
    """The distinct five-word shingles of a table, or all words where there are fewer."""
    return f"""
SELECT DISTINCT {id}, unnest(CASE
         WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
FROM (SELECT {id}, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source})"""


SQL["op5_minhash_containment"] = f"""
WITH i AS ({shingle_sql('benchmark', 'item_id')}),
sizes AS (SELECT 5 AS k UNION SELECT len(string_split(s, ' ')) FROM i WHERE len(string_split(s, ' ')) < 5),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s
      FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), sizes
      WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_matched FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_matched, n_item, n_matched / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_matched >= 75 * n_item"""


# ---- 6: embedding near-dedup --------------------------------------------------------------------

@query
def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op6_subspace_pigeonhole"] = """
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings
          UNION SELECT y, c FROM reach JOIN links ON x = vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(max(n.n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id"""


# ---- 7: jump consistent hashing ---------------------------------------------------------------

@query
def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


def _jump_sql(name: str, shards: int) -> str:
    """Unrolled: each draw moves ahead, so there are at most ``shards`` draws."""
    step = "(({s} * 2862933555777941757 + 1) % 18446744073709551616)"
    lines = [f"{name}0 AS (SELECT k, k AS s, 0::BIGINT AS place, 0::BIGINT AS ahead FROM keys)"]
    for i in range(shards):
        lines.append(
            f"{name}{i + 1} AS (SELECT k, n AS s, CASE WHEN ahead < {shards} THEN ahead ELSE place END AS place, "
            f"CASE WHEN ahead < {shards} THEN CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / "
            f"((n // 8589934592)::DOUBLE + 1))) AS BIGINT) ELSE ahead END AS ahead "
            f"FROM (SELECT *, {step.format(s='s')} AS n FROM {name}{i}))"
        )
    return ", ".join(lines)


SQL["op7_jump_sharding"] = f"""
WITH keys AS (SELECT DISTINCT ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616) AS k FROM documents),
{_jump_sql('a', 8)}, {_jump_sql('b', 9)},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents),
bits AS (SELECT i, list_reduce(range(0, 9), lambda c, n: CASE WHEN n = 0 THEN c
         WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)),
lookup AS (SELECT list(v ORDER BY i) AS l FROM bits),
crc AS (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(range(0, strlen(t)), lambda p: ('0x' || substr(hex(t), (2 * p + 1)::INT, 2))::BIGINT)),
          lambda c, x: xor(c // 256, l[xor(c % 256, x) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT t FROM d), lookup)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, a8.place::INT AS shard,
       row_number() OVER (PARTITION BY a8.place ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot,
       b9.place::INT AS grown_shard
FROM d JOIN crc USING (t) JOIN a8 ON a8.k = (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 JOIN b9 ON b9.k = a8.k"""


# ---- 8: WARC ------------------------------------------------------------------------------------

@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


# Five hexadecimal digits are four letters of base32.
SQL["op8_warc_archive"] = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
e AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)),
        'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_page,
             row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS rn FROM e)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rn > 1 THEN first_page END AS refers_to
FROM f"""


# ---- 9: secret scans ----------------------------------------------------------------------------

@query
def op9_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        own = F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), "n_layers", "n_unopened")


# ---- 10: n-gram Jaccard join --------------------------------------------------------------------

@query
def op10_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


SQL["op10_adaptive_jaccard"] = f"""
WITH RECURSIVE
d AS ({shingle_sql('documents', 'doc_id', f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")}),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b USING (s)
        WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
          WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS c FROM documents
          UNION SELECT y, c FROM reach JOIN links ON x = doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY ALL"""


# ---- 11: conversation structure repair ------------------------------------------------------------

@query
def op11_block_table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_damaged(table(spark, sf_dir, "conversations"))


def _edit_sql(cost: str, letter: str, *states: str) -> str:
    """The cheapest of some states after an edit: eight digits of cost, then the letters so far."""
    done = [f"(lpad(({s}[1:8]::INT + {cost})::VARCHAR, 8, '0') || {s}[9:] || '{letter}')" for s in states]
    return done[0] if len(done) == 1 else f"least({', '.join(done)})"


# One step per row; a state holds its cheapest edits, of equal ones the least. Null: not reached.
SQL["op11_block_table_repair"] = f"""
WITH RECURSIVE
bits AS (SELECT i, list_reduce(range(0, 9), lambda c, n: CASE WHEN n = 0 THEN c
         WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)),
lookup AS (SELECT list(v ORDER BY i) AS l FROM bits),
ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
dealt AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(range(0, strlen(key)), lambda p: ascii(substr(key, (p + 1)::INT, 1))::BIGINT)),
            lambda c, x: xor(c // 256, l[xor(c % 256, x) + 1])), 4294967295) % 20 AS deal FROM raw, lookup),
bad AS (SELECT k, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
               CASE deal WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN deal = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM dealt WHERE deal <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM bad),
r AS (SELECT *, left(role, 1) AS c, body = '' OR nth > 1 AS must,
             (right(body, 1) NOT IN ('.', '!', '?'))::INT AS cut,
             lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair FROM seen),
dp AS (
  SELECT k, 0::BIGINT AS i, '00000000' AS v0, NULL::VARCHAR AS v1, '00000002I' AS v2, '00000004II' AS v3 FROM ids
  UNION ALL
  SELECT k, i, n0, n1, m2, least(n3, {_edit_sql('2', 'I', 'm2')}) FROM (
    SELECT *, least(n2, {_edit_sql('2', 'I', 'n0', 'n1', 'n3')}) AS m2 FROM (
      SELECT r.k, r.i, {_edit_sql('3', 'D', 'v0')} AS n0,
        least({_edit_sql('3', 'D', 'v1')}, CASE WHEN NOT must AND c = 's' THEN {_edit_sql('cut', 'K', 'v0')} END) AS n1,
        least({_edit_sql('3', 'D', 'v2')}, CASE WHEN NOT must THEN least({_edit_sql('2 + cut', 'R', 'v0', 'v1', 'v3')},
              CASE WHEN c = 'u' THEN {_edit_sql('cut', 'K', 'v0', 'v1', 'v3')} END) END) AS n2,
        least({_edit_sql('3', 'D', 'v3')}, CASE WHEN NOT must THEN least({_edit_sql('2 + cut', 'R', 'v2')},
              CASE WHEN c = 'a' THEN {_edit_sql('cut', 'K', 'v2')} END) END) AS n3
      FROM dp JOIN r ON r.k = dp.k AND r.i = dp.i + 1))),
best AS (SELECT k, arg_max(least(v0, v3), i) AS b FROM dp GROUP BY k),
steps AS (SELECT k, b[9:] AS audit, unnest(range(1, strlen(b) - 7)) AS p FROM best),
edits AS (SELECT s.k, p, audit[p:p] AS e, r.role, r.text, strlen(replace(audit[1:p], 'D', '')) AS j
          FROM steps s LEFT JOIN r ON r.k = s.k AND r.i = strlen(replace(audit[1:p], 'I', '')) AND audit[p:p] <> 'I'),
system AS (SELECT k, bool_or(j = 1 AND e = 'K' AND role[1:1] = 's') AS s FROM edits WHERE e <> 'D' GROUP BY k),
done AS (SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (j % 2 = 1) <> s THEN 'user' ELSE 'assistant' END
                              || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
         FROM edits JOIN system USING (k) WHERE e <> 'D' GROUP BY k),
f AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (body = '') AS blank, count(*) FILTER (body <> '' AND nth > 1) AS duplicate,
             count(*) FILTER (NOT must AND cut = 1) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b[1:8]::BIGINT AS cost,
       b[9:] AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN best USING (k) LEFT JOIN f USING (k) LEFT JOIN done USING (k)"""


# ---- 12: suffix-array dedup -----------------------------------------------------------------------

@query
def op12_index_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


# Two hexadecimal digits are a byte; the strings are told apart by their MD5.
SQL["op12_index_family"] = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, hex(coalesce(text, '')) AS h,
                  strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(h, (2 * i + 1)::INT, 200)) AS s
      FROM (SELECT r, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
gone AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM w) WHERE k > 1),
steps AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -101) + 100)::INT AS fresh FROM gone),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM steps),
spans AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY r, g),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT r, string_agg(substr(h, (2 * p + 1)::INT, (2 * (a - p))::INT), '' ORDER BY a)
                   || substr(any_value(h), (2 * max(b) + 1)::INT) AS h, sum(b - a) AS n_removed, count(*) AS n_spans
         FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


# ---- 13: ranked lexical search ------------------------------------------------------------------

@query
def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


SQL["op13_bag_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql('text')} AS w FROM documents),
t AS (SELECT r, unnest(w) AS term FROM d),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
f AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, g),
m AS (SELECT r, 100 - 25 + (25 * n * docs) // terms AS m FROM n, g),
q AS (SELECT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark),
p AS (SELECT item_id, term, count(*) AS q FROM q GROUP BY ALL),
s AS (SELECT item_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20"""

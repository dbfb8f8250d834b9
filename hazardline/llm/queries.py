"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardline.llm import mixing
from hazardline.llm.contamination import contamination
from hazardline.llm.jaccard_join import jaccard_components
from hazardline.llm.near_copies import near_copies
from hazardline.llm.neighbours import nearest
from hazardline.llm.phrases import collocations
from hazardline.llm.prefix_trie import prefix_trie
from hazardline.llm.quality import fit_quality, held_out, quality_scores
from hazardline.llm.secrets import secret_scan
from hazardline.llm.substring import substring_dedup
from hazardline.llm.suffixes import suffix_dedup
from hazardline.llm.url_filter import url_verdicts
from hazardline.llm.wrappers import extract
from hazardline.session import ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: ship_code(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_substring_dedup")
def op1(table):
    return substring_dedup(table("documents")).drop("kept", "spans")


@query("op9_suffix_dedup")
def op9(table):
    return suffix_dedup(table("documents")).drop("kept")


@query("op10_near_copies")
def op10(table):
    return near_copies(table("documents")).drop("copy", "root")


@query("op6_contamination")
def op6(table):
    return contamination(table("documents"), table("benchmark")).drop("items", "spans")


@query("op8_secret_scan")
def op8(table):
    return secret_scan(table("documents"))


@query("op4_quality")
def op4(table):
    labels = table("labels").select("doc_id", F.col("quality").alias("label")).where(~held_out("doc_id"))
    docs = table("documents")
    scored = quality_scores(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_mixing", mixing.ORACLE)
def op2(table):
    return mixing.mix_sources(table("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_url_filter")
def op3(table):
    return url_verdicts(table("pages"))


@query("op5_html_extraction")
def op5(table):
    return extract(table("pages"))


@query("op7_neighbours")
def op7(table):
    return nearest(table("embeddings"))


SQL_TRIE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(4294967295,
      list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 END AS h
    FROM t GROUP BY conv_id),
  k AS (SELECT c.conv_id, any_value(h) AS h, count(t.pos) AS k FROM c LEFT JOIN t ON t.conv_id = base AND t.pos <= h GROUP BY c.conv_id),
  rebuilt AS (SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = base AND t.pos <= h
    UNION ALL SELECT t.conv_id, t.pos - h + k, role, text FROM t JOIN k ON t.conv_id = k.conv_id WHERE t.pos > h),
  p AS (SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix,
      len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
  e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
  nodes AS (SELECT prefix, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY prefix),
  linked AS (SELECT n.*, up.prefix AS above, up.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.prefix = n.prefix[:-65]),
  kids AS (SELECT above, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above),
  full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids ON kids.above = l.prefix),
  sums AS (SELECT p.prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * u.words) AS saved_tokens
    FROM full_nodes u JOIN p ON p.conv_id = u.conv_id AND p.d <= u.depth GROUP BY p.prefix)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (prefix)"""


@query("op11_prefix_trie", SQL_TRIE)
def op11(table):
    conv = F.col("conv_id")
    return prefix_trie(table("conversations"), (conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4))


SQL_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
  g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i:i + size - 1])) AS g
    FROM w, (VALUES (1), (2), (3), (4)) v(size) WHERE len(ws) >= size),
  f AS (SELECT lang, g, count(*) AS c FROM g GROUP BY lang, g),
  o AS (SELECT * FROM f WHERE c >= 30),
  total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
  cand AS (SELECT * FROM o WHERE len(g) > 1),
  cuts AS (SELECT lang, g, c, k, g[1:k] AS x, g[k + 1:] AS y FROM cand, (VALUES (1), (2), (3)) v(k) WHERE k < len(g)),
  scored AS (SELECT u.lang, u.g, u.c, k, x.c AS l, y.c AS r, 2000000::HUGEINT * u.c // (x.c + y.c) AS score
    FROM cuts u JOIN o x ON x.lang = u.lang AND x.g = u.x JOIN o y ON y.lang = u.lang AND y.g = u.y
    QUALIFY row_number() OVER (PARTITION BY u.lang, u.g ORDER BY score, k) = 1),
  inner_spans AS (SELECT lang, c, g[s:s + m - 1] AS sub FROM cand, (VALUES (1), (2), (3)) a(s), (VALUES (2), (3)) b(m) WHERE m < len(g) AND s + m - 1 <= len(g)),
  gone AS (SELECT DISTINCT i.lang, sub FROM inner_spans i JOIN cand s ON s.lang = i.lang AND s.g = sub WHERE 100 * i.c >= 80 * s.c),
  ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, c AS a, l, r, score::BIGINT AS score,
      row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, array_to_string(g, ' ')) AS rank
    FROM scored s WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = s.lang AND gone.sub = s.g))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op12_phrases", SQL_PHRASES)
def op12(table):
    return collocations(table("documents"))


SQL_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE
    list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS grams FROM w),
  sizes AS (SELECT doc_id, len(grams)::BIGINT AS n FROM s),
  e AS (SELECT doc_id, n, unnest(list_transform(grams, lambda g: hash(g))) AS g FROM s JOIN sizes USING (doc_id)),
  lists AS (SELECT doc_id, any_value(n) AS n, list(g) AS gs FROM e GROUP BY doc_id),
  ranked AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY often, g) AS place
    FROM e JOIN (SELECT g, count(*) AS often FROM e GROUP BY g) USING (g)),
  rare AS (SELECT doc_id, n, g FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
  pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n),
  links AS (SELECT x, y FROM (SELECT x, y, p.n + q.n AS both_sizes, len(list_intersect(p.gs, q.gs)) AS common
    FROM pairs JOIN lists p ON p.doc_id = x JOIN lists q ON q.doc_id = y) WHERE 100 * common >= 85 * (both_sizes - common)),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n"""


@query("op13_jaccard_join", SQL_JACCARD)
def op13(table):
    return jaccard_components(table("documents"))

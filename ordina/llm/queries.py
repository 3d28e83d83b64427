"""The registered queries of the corpus operators and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import html_extract, language_id, mixing, nearest, quality, substring_dedup, url_filter, warc
from ordina.llm.common import fold_of, materialise, scratch_path, table
from ordina.llm.decontaminate import find_contamination
from ordina.llm.near_dedup import MinHash, near_duplicates

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_lines=True)
    return cut.select("doc_id", F.col("dedup.n_units").alias("n_units"), F.col("dedup.n_removed").alias("n_removed"), _span_text(F.col("dedup.spans")).alias("removed_spans"), "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leak.*")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), machine)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialise(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")  # texts are read and cut into words once
    mixed = mixing.mix(sized, size_col="size")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path, payloads=False).where("kind = 'record'")
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:ordina:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), cfg=MinHash(words=3, percent=85))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_url_filter, op4_quality, op5_html_extract, op6_mixing, op7_warc, op8_near_dedup, op9_language_id, op10_nearest, pipeline)}

_BLANK = r"[ \t\n\v\f\r]+"
_CUT = "text"
for _end in substring_dedup.ENDS:
    _CUT = f"replace({_CUT}, '{_end} ', '{_end}' || chr(10))"

#: A unit's line is the number of line ends in the text before it.
OP1_SQL = f"""
WITH cut AS (SELECT doc_id, text, string_split({_CUT}, chr(10)) AS us FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, text, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM cut),
placed AS (SELECT *, CAST(sum(length(u) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(u) - 1 AS s FROM raw),
normal AS (SELECT *, trim(regexp_replace(lower(u), '{_BLANK}', ' ', 'g')) AS norm, sum(CASE WHEN s = 0 OR substr(text, CAST(s AS INT), 1) = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM placed),
units AS (SELECT doc_id, text, s, norm, line, length(norm) - length(replace(norm, ' ', '')) + 1 AS nw, row_number() OVER w AS idx,
          coalesce(lead(s) OVER w, length(text)) AS nxt FROM normal WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
whole AS (SELECT doc_id, line, string_agg(norm, ' ' ORDER BY idx) AS norm FROM units GROUP BY doc_id, line),
late_lines AS (SELECT doc_id, line, rank() OVER (PARTITION BY norm ORDER BY doc_id, line) > 1 AS late FROM whole),
marked AS (SELECT *, rank() OVER (PARTITION BY norm ORDER BY doc_id, idx) > 1 AS dup FROM units),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, dup ORDER BY idx) AS run FROM marked),
judged AS (SELECT r.*, late OR (dup AND sum(nw) OVER (PARTITION BY r.doc_id, dup, run) >= 25) AS gone FROM runs r JOIN late_lines USING (doc_id, line)),
joined AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, gone ORDER BY idx) AS span FROM judged),
spans AS (SELECT doc_id, min(s) AS a, max(nxt) AS b FROM joined WHERE gone GROUP BY doc_id, span),
span_text AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, min(s) AS first_s,
         string_agg(CASE WHEN gone THEN '' ELSE substr(text, CAST(s AS INT) + 1, CAST(nxt - s AS INT)) END, '' ORDER BY s) AS rest FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_spans, '') AS removed_spans,
       CASE WHEN n_units IS NULL THEN d.text ELSE substr(d.text, 1, CAST(first_s AS INT)) || rest END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN span_text USING (doc_id)
"""

_WORD2 = r"regexp_extract_all(translate(text, '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
OP2_SQL = f"""
WITH items AS (SELECT item_id, {_WORD2} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w, least(len(ws), 10) AS n
            FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {_WORD2} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows w ON g.w = w.w AND g.n = w.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _rank_sql(kind: str) -> str:
    """CTEs of the steps of the personalised PageRank of a kind, and their sum."""
    rounds = url_filter.rounds_for()
    out = [f"{kind}_0 AS MATERIALIZED (SELECT host, {kind} AS mass FROM hosts WHERE {kind} > 0)"]
    for i in range(1, rounds + 1):
        out.append(f"{kind}_{i} AS MATERIALIZED (SELECT dst AS host, sum(mass / degree) * {url_filter.DAMPING}::DOUBLE AS mass FROM {kind}_{i - 1} r JOIN steps s ON s.kind = '{kind}' AND r.host = s.src GROUP BY dst)")
    every = " UNION ALL ".join(f"SELECT * FROM {kind}_{i}" for i in range(rounds + 1))
    return ", ".join([*out, f"{kind}_all AS (SELECT host, sum(mass) AS score FROM ({every}) GROUP BY host)"])


def _rule_sql(what: int, path: str = "path") -> str:
    cases = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE{cases} END"


_LINK_SQL = url_filter.LINK.replace("'", "''").replace('\\"', '"')
_NAMED_SQL = r"[^.:@\[\]]+(\.[^.:@\[\]]+)*\.[a-z][a-z0-9\-]*"
_WHOLE_SQL = _rule_sql(1, "'/'")
OP3_SQL = f"""
WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, html, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
read AS (SELECT page_id, html, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM parts),
judged AS (SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS ruled FROM read),
shares AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*) AS a, count(*) FILTER (WHERE ruled = 'block') / count(*) AS b, {_WHOLE_SQL} AS whole FROM judged WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (SELECT host, CASE whole WHEN 'allow' THEN 1.0::DOUBLE WHEN 'block' THEN 0.0::DOUBLE ELSE a + {url_filter.BENEFIT}::DOUBLE * (1 - a - b) END AS trust,
          CASE whole WHEN 'allow' THEN 0.0::DOUBLE WHEN 'block' THEN 1.0::DOUBLE ELSE b END AS distrust FROM shares),
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK_SQL}', 1)), '{UPPER}', '{LOWER}') AS dst FROM read WHERE host <> '') WHERE src <> dst),
named AS (SELECT DISTINCT string_split(host, '.') AS p FROM (SELECT host FROM hosts UNION SELECT dst FROM links) WHERE length(host) <= 253 AND regexp_full_match(host, '{_NAMED_SQL}')),
up AS (SELECT DISTINCT array_to_string(p[i:], '.') AS sub, array_to_string(p[i + 1:], '.') AS dom FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM named)),
edges AS (SELECT 'trust' AS kind, src, dst FROM links UNION SELECT 'distrust', dst, src FROM links UNION SELECT kind, sub, dom FROM up, (VALUES ('trust'), ('distrust')) k(kind) UNION SELECT kind, dom, sub FROM up, (VALUES ('trust'), ('distrust')) k(kind)),
steps AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM edges),
{_rank_sql("trust")}, {_rank_sql("distrust")}
SELECT j.page_id, j.host, j.path, j.rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) * (1 + 1e-9::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN trust_all t ON j.host = t.host LEFT JOIN distrust_all d ON j.host = d.host
"""

_SIZE_SQL = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, {_SIZE_SQL} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
levels AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
           FROM weighed WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
goals AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
queue AS (SELECT doc_id, size, g.source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
          FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * ((2 * upto - size <= 2 * target)::INT + (2 * (source_size + upto) - size <= 2 * target)::INT + (2 * (2 * source_size + upto) - size <= 2 * target)::INT) AS taken
FROM queue
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = " || ".join(f"substr('{_BASE32}', CAST((v >> {k}) & 31 AS INT) + 1, 1)" for k in (15, 10, 5, 0))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)), lambda v: {_FIVE}), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.a
"""

OP10_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER o AS INT) AS rank, vec_id, score FROM p WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_url_filter": OP3_SQL, "op6_mixing": OP6_SQL, "op7_warc": OP7_SQL, "op8_near_dedup": OP8_SQL, "op10_nearest": OP10_SQL}

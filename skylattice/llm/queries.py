"""One query per operator over its whole table, and the SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.ball_tree import top_inner_products, whole_numbers
from skylattice.llm.byte_pairs import round_trips
from skylattice.llm.common import materialize, table
from skylattice.llm.decontamination import contamination
from skylattice.llm.kd_shards import kd_shards
from skylattice.llm.lexical_search import best_documents
from skylattice.llm.mixing import SEED, leaf_budgets, leaf_cuts, measured, taken
from skylattice.llm.near_duplicates import near_duplicates
from skylattice.llm.personal_data import personal_data
from skylattice.llm.quality_rules import quality_verdicts
from skylattice.llm.revisits import resolved
from skylattice.llm.spelling_variants import spelling_variants
from skylattice.llm.token_counts import token_counts
from skylattice.llm.token_files import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


#: Production weights of the mixture; names that are not listed weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}
MIX_PERCENT, MIX_EPOCHS = 75, 2


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(measured(table(spark, sf_dir, "documents")), "sizes")
    cuts = materialize(leaf_cuts(sizes, leaf_budgets(sizes, WEIGHTS, MIX_PERCENT, MIX_EPOCHS), MIX_EPOCHS, SEED), "cuts")
    return taken(sizes, cuts, SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _case(level: str) -> str:
    rules = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {rules} ELSE 1 END" if rules else "1"


def _level_sql(name: str, level: str, parent: list[str], above: str) -> str:
    """Budgets of one level, stated again: children exhausted in the order of capacity per weight, the rest by weight."""
    own = ", ".join([*parent, level])
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"{by} ORDER BY capacity / w, {level} NULLS FIRST"
    join = " AND ".join(f"c.{p} IS NOT DISTINCT FROM u.{p}" for p in parent) or "TRUE"
    return f"""
{name}_c AS (SELECT {own}, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS capacity, {_case(level)} AS w FROM leaves GROUP BY {own}),
{name}_g AS (SELECT c.*, u.budget AS given FROM {name}_c c JOIN {above} u ON {join}),
{name}_f AS (SELECT *, capacity * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS done FROM {name}_g),
{name}_r AS (SELECT *, given - coalesce(sum(capacity) FILTER (done) OVER ({by}), 0) AS rest, coalesce(sum(w) FILTER (NOT done) OVER ({by}), 0) AS whole,
    coalesce(sum(CASE WHEN done THEN 0 ELSE w END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto FROM {name}_f),
{name} AS (SELECT {own}, CASE WHEN done THEN capacity ELSE (rest * upto)::HUGEINT // whole::HUGEINT - (rest * (upto - w))::HUGEINT // whole::HUGEINT END AS budget FROM {name}_r)"""


ORACLES["op1_mixing"] = f"""
WITH sizes AS (SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other'
        ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INTEGER % 4) END AS domain, lang, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens, substr(md5(text), 1, 16) AS mark FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM sizes GROUP BY ALL),
top AS (SELECT least(sum(tokens)::HUGEINT * {MIX_PERCENT} // 100, sum(tokens)::HUGEINT * {MIX_EPOCHS}) AS budget FROM leaves),
{_level_sql("b1", "domain", [], "top")},
{_level_sql("b2", "lang", ["domain"], "b1")},
{_level_sql("b3", "source", ["domain", "lang"], "b2")},
wants AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS wanted
    FROM leaves l JOIN b3 b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
keyed AS (SELECT s.*, full_epochs, wanted, sum(n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source
        ORDER BY md5(concat_ws('|', '{SEED}', (full_epochs + 1)::BIGINT::VARCHAR, coalesce(s.doc_id::VARCHAR, ''), coalesce(mark, ''))), copy ROWS UNBOUNDED PRECEDING) AS upto
    FROM (SELECT *, row_number() OVER (PARTITION BY domain, lang, source, doc_id, mark) AS copy FROM sizes) s JOIN wants w ON s.domain = w.domain AND s.lang IS NOT DISTINCT FROM w.lang AND s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, domain, lang, source, n_tokens, e::INTEGER AS epoch FROM keyed, range(1, {MIX_EPOCHS} + 1) r(e)
WHERE e <= full_epochs OR (e = full_epochs + 1 AND upto <= wanted)
"""


@query
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_inner_products(whole_numbers(table(spark, sf_dir, "embeddings"), 64), every=20, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op3_ball_tree"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page once in full, and two revisits: one a day later under another form of its
    URL, for every fifth page with other validators, and one half a minute before the full response."""
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    digest, kind = F.md5("html"), F.pmod("page_id", F.lit(4))
    quoted = F.concat(F.lit('"'), digest, F.lit('"'))
    tag = F.when(kind.isin(0, 3), quoted).when(kind == 1, F.concat(F.lit("W/"), quoted))
    date = F.when(kind.isin(2, 3), at - 3_600).cast("string")
    moved = F.pmod("page_id", F.lit(5)) == 0
    new_tag = F.when(tag.isNotNull(), F.when(moved, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), quoted)))
    new_date = F.when(date.isNotNull(), F.when(moved, F.lit("0")).otherwise(date))
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.octet_length("html")), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), text(at))
    fresh = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), text(at + 86_400), F.lit("age"), F.lit("1"))
    record = lambda n, url, kind, time, etag, modified, headers, size: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), time.cast("long").alias("time"), F.lit(kind).alias("kind"), etag.alias("etag"), modified.alias("last_modified"),
        headers.alias("headers"), size.cast("long").alias("payload_bytes"),
    )
    none = F.lit(None).cast("string")
    again = F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://WWW."), F.lit("#again"))
    records = F.array(
        record(0, F.col("url"), "response", at, tag, date, stored, F.octet_length("html")),
        record(1, again, "revisit", at + 86_400, new_tag, new_date, fresh, F.lit(None)),
        record(2, F.col("url"), "revisit", at - 30, none, none, fresh, F.lit(None)),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


@query
def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines)


ORACLES["op7_revisits"] = r"""
WITH base AS (SELECT page_id, url, 1700000000 + page_id * 60 AS seen, page_id % 4 AS kind, '"' || md5(html) || '"' AS tag, page_id % 5 = 0 AS moved, strlen(html) AS bytes FROM pages),
bare AS (SELECT *, regexp_replace(url, '(?s)#.*$', '') AS u FROM base),
cut AS (SELECT *, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) AS host, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params FROM bare),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(host), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM cut),
responses AS (SELECT page_id * 4 AS id, url_key, seen AS t, CASE WHEN kind IN (0, 3) THEN tag WHEN kind = 1 THEN 'W/' || tag END AS etag,
    CASE WHEN kind IN (2, 3) THEN (seen - 3600)::VARCHAR END AS modified, seen, bytes FROM keyed),
revisits AS (SELECT page_id * 4 + 1 AS id, url_key, seen + 86400 AS t, CASE WHEN kind <> 2 THEN CASE WHEN moved THEN '"other"' ELSE 'W/' || tag END END AS etag,
    CASE WHEN kind IN (2, 3) THEN CASE WHEN moved THEN '0' ELSE (seen - 3600)::VARCHAR END END AS modified, seen FROM keyed
    UNION ALL SELECT page_id * 4 + 2, url_key, seen - 30, NULL, NULL, seen FROM keyed),
ranked AS (SELECT v.id, v.url_key, v.t, v.seen, v.etag AS e1, v.modified AS m1, r.id AS rid, r.etag AS e2, r.modified AS m2, r.seen AS rat, r.bytes,
    row_number() OVER (PARTITION BY v.id ORDER BY r.t DESC NULLS LAST, r.id DESC) AS n FROM revisits v LEFT JOIN responses r ON v.url_key = r.url_key AND r.t < v.t),
judged AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
    WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN regexp_replace(e1, '^W/', '') = regexp_replace(e2, '^W/', '') THEN 'resolved' ELSE 'changed' END
    WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN CASE WHEN m1 = m2 THEN 'resolved' ELSE 'changed' END ELSE 'no_validator' END AS outcome FROM ranked WHERE n = 1)
SELECT id AS record_id, url_key, t AS time, rid AS response_id, outcome,
    CASE WHEN outcome = 'resolved' THEN 'age: 1' || chr(10) || 'cache-control: max-age=600' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (seen + 86400) END AS headers,
    CASE WHEN outcome = 'resolved' THEN bytes END AS payload_bytes FROM judged
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query
def op11_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _folded(text: str) -> str:
    """Words of a text in SQL, after A-Z are lower-cased one by one (other letters stay)."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES["op11_aho_corasick"] = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_folded("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') AS window_text
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_folded("text")}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS window_text FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, sizes)),
found AS (SELECT g.r, g.n, g.pos, v.item FROM grams g JOIN windows v ON g.n = v.n AND g.window_text = v.window_text),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query
def op12_lemp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op12_lemp"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_folded("text")} AS w FROM documents),
sized AS (SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS rows_n, sum(n)::BIGINT AS total FROM sized),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
items AS (SELECT row_number() OVER () AS i, item_id, {_folded("text")} AS w FROM benchmark),
wanted AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM items),
weights AS (SELECT term, floor(1000 * ln((2 * rows_n + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
scored AS (SELECT q.i, q.item_id, t.r, s.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * s.n * rows_n) // total)))))::BIGINT AS score
    FROM wanted q JOIN weights USING (term) JOIN tf t USING (term) JOIN sized s ON s.r = t.r, whole GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 10
"""


@query
def op13_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


#: crc32: the table of its 256 bytes, eight shifts each.
_CRC_STEP = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC_TABLE = f"list_transform(range(256), lambda b: list_reduce(range(8), lambda x, k: {_CRC_STEP}, b))"

ORACLES["op13_part_enum"] = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT d, run, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d,
    unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS cased, translate(cased, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY d, run),
coded AS (SELECT run, c, hex(encode(d || ':' || run)) AS bytes FROM runs WHERE length(run) >= 5),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda x, b: xor(x >> 8, t[(xor(x & 255, b) + 1)::BIGINT]), 4294967295::BIGINT)) AS h FROM coded, crc),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (SELECT word, n, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
ordered AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
forms AS (SELECT w.word, w.n, coalesce(o.n_near, 0)::BIGINT AS n_near, CASE WHEN o.other_n >= 2 * w.n THEN o.other END AS form, CASE WHEN o.other_n >= 2 * w.n THEN o.other_n END AS form_n
    FROM words w LEFT JOIN ordered o ON w.word = o.word AND o.k = 1),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n::BIGINT AS form_n, c.at AS root FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.at = e.word AND e.form IS NULL
"""

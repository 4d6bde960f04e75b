"""The corpus operators as queries over whole tables, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import click_windows, divergence, exact_dedup, licenses, line_dedup, minhash, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity
from tidewatch.llm.common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(read(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_depth", "shard_bytes", "shard_rows", "n_bytes")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "words_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op13_expiring_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_windows.expiring_windows(click_windows.replayed_copies(read(spark, sf_dir, "clicks")), click_windows.BATCHES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_quality_rules, op4_best_fit_packing, op5_ngram_jaccard_join, op6_source_mixing, op7_sharding, op8_toxicity, op9_line_dedup, op10_token_counts, op11_minhash_near_dedup, op12_source_divergence, op13_expiring_clicks, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TEMPLATES = _values([(t, *row) for t, row in enumerate(licenses.TEMPLATES)])
_PHRASES = _values(list(licenses.PHRASES.items()))

ORACLE_SQL = {
    # the index from document counts, votes per offset, phrases at every word
    "op2_license_scan": rf"""
        WITH t(t, label, phrase, wording) AS (VALUES {_TEMPLATES}), ph(phrase, label) AS (VALUES {_PHRASES}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM d),
        vocabulary AS (SELECT DISTINCT unnest(string_split(wording, ' ')) AS w FROM t),
        hit AS (SELECT r, p, w FROM x JOIN vocabulary USING (w)),
        df AS (SELECT v.w, count(DISTINCT r) AS n FROM vocabulary v LEFT JOIN hit USING (w) GROUP BY v.w),
        pos AS (SELECT t, unnest(string_split(wording, ' ')) AS w, generate_subscripts(string_split(wording, ' '), 1) - 1 AS q FROM t),
        rare AS (SELECT t, w, q FROM pos JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, q) <= 8),
        held AS (SELECT t, count(*) AS n FROM rare GROUP BY t),
        votes AS (SELECT r, t, count(*) AS c FROM hit JOIN rare USING (w) GROUP BY r, t, p - q),
        best AS (SELECT r, t, least(1.0, max(c) / any_value(n)) AS share FROM votes JOIN held USING (t) GROUP BY r, t),
        sure AS (SELECT r, list(label) AS labels, max(share) AS share FROM best JOIN t USING (t) JOIN d USING (r)
                 WHERE share >= 0.6 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ') GROUP BY r),
        places AS (SELECT x.r, label, p FROM x JOIN ph ON x.w = string_split(phrase, ' ')[1] JOIN d ON d.r = x.r AND d.w[p + 1 : p + len(string_split(phrase, ' '))] = string_split(phrase, ' ')),
        base AS (SELECT r, count(*) AS n, min(p) AS first, max(p) AS last, list(label) AS labels FROM places GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, sure.labels))), ','), '') AS labels,
               greatest(coalesce(sure.share, 0.0), CASE WHEN base.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
        FROM d LEFT JOIN sure USING (r) LEFT JOIN base USING (r)""",
    # shingles as texts, all pairs that share one, and what links reach
    "op5_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        o AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
        x AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, p, n, concat_ws(' ', w, lead(w, 1) OVER t, lead(w, 2) OVER t, lead(w, 3) OVER t, lead(w, 4) OVER t) AS g FROM o WINDOW t AS (PARTITION BY doc_id ORDER BY p)) WHERE p = 1 OR p <= n - 4),
        n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id),
        often AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1), y AS MATERIALIZED (SELECT x.* FROM x JOIN often USING (g)),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
    # the same over two-word shingles
    "op11_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        o AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
        x AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, p, n, concat_ws(' ', w, lead(w, 1) OVER t) AS g FROM o WINDOW t AS (PARTITION BY doc_id ORDER BY p)) WHERE p = 1 OR p <= n - 1),
        n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id),
        often AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1), y AS MATERIALIZED (SELECT x.* FROM x JOIN often USING (g)),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id, n.doc_id <= coalesce(min(reach.b), n.doc_id) AS kept FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
    # every prefix's size; a row's shard is its shortest prefix that fits
    "op7_sharding": rf"""
        WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                          lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce('=' || text, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
        l AS (SELECT unnest(range(0, 61)) AS depth),
        s AS (SELECT depth, left(bits, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM r, l GROUP BY ALL HAVING sum(n_bytes) <= {sharding.LIMIT_BYTES} OR min(bits) = max(bits))
        SELECT doc_id, shard, depth::INTEGER AS shard_depth, shard_bytes, shard_rows, n_bytes FROM r, l JOIN s USING (depth) WHERE s.shard = left(bits, depth)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1""",
    # every pair of groups times every kept term, in 128-bit numbers
    "op12_source_divergence": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS MATERIALIZED (SELECT lang, source, r, t, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS t FROM d) GROUP BY ALL),
        k AS MATERIALIZED (SELECT lang, t, sum(n)::HUGEINT AS n FROM x GROUP BY ALL HAVING count(*) >= 3),
        l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM k GROUP BY ALL),
        c AS MATERIALIZED (SELECT x.lang, source, t, sum(x.n)::HUGEINT AS n FROM x JOIN k USING (lang, t) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
        p AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.terms) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.terms) AS q
              FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term' AS part, t AS item, (((p - q) * (p - q)) // q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, t)::INTEGER AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= 200""",
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}

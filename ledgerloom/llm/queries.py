"""The numbered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, collocations, decontaminate, embed_dedup, langid, mixing, near_dedup, quality_rules, secret_scan, substring_dedup, token_counts, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = warc.new_archive(table(spark, sf_dir, "pages"))
    read = warc.read_records(index, path)
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")  # a page's label is that of the document with its id
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    n = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    base, every = secret_scan.joined(F.col("base")), secret_scan.joined(F.col("spans"))
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokens(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_decontaminate, op3_substring_dedup, op4_url_filter, op5_language_id, op6_embedding_dedup, op7_mixing, op8_secret_scan, op9_near_dedup, op10_token_counts, op11_token_alignment, op12_quality_rules, op13_collocations)
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _secrets_sql() -> str:
    """Positions from the lengths of matches and of the pieces between them, as in the operator."""
    kinds = "regexp_replace(regexp_replace(regexp_replace(y, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g')"
    like = f"len(y) >= {secret_scan.PIECE} AND len(regexp_replace({kinds}, '[Aa]+', 'a', 'g')) - 1 >= {secret_scan.CHANGES} AND (len(replace({kinds}, 'Aa', 'a')) - 1) * {secret_scan.EVERY} >= len(y)"

    def found(pattern: str, group: int, kind: int) -> str:
        quoted = pattern.replace("'", "''")
        return f"""SELECT doc_id, owner, {kind} AS k, v, off + gaps AS s, off + gaps + n AS e FROM (
                SELECT doc_id, owner, i, v[i] AS v, len(m[i]) AS n, coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0) AS off,
                       list_sum(list_transform(p[1:i], lambda y: len(y))) AS gaps
                FROM (SELECT doc_id, owner, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, owner, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS p FROM d)))"""

    return f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
             base AS (SELECT * FROM ({found(secret_scan.ASSIGN, 2, 0)}) WHERE len(v) >= 6 UNION ALL {found(secret_scan.ACCESS, 0, 1)} UNION ALL {found(secret_scan.HEX, 0, 2)}),
             cand AS (SELECT * FROM ({found(secret_scan.TOKEN, 0, 3)}) WHERE len(list_filter(string_split_regex(v, '[/_+-]'), lambda y: {like})) > 0),
             every AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
             live AS (SELECT v FROM every GROUP BY v HAVING count(DISTINCT owner) <= 1 AND count(DISTINCT doc_id) <= 20),
             own AS (SELECT c.* FROM cand c JOIN live USING (v) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
             spans AS (SELECT doc_id, s, k, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM own)),
             a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
                          string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS b, string_agg(x, ',' ORDER BY s, k) AS x FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
        FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _quality_sql() -> str:
    """The counts from lists of words and windows; cutoffs in order, as far as the binomial tail stays within its share."""
    score = {
        "symbols": "CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END", "repeats": "CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END",
        "lines": "CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END", "long_words": "CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END",
        "short_words": "CASE WHEN n_words > 0 THEN -(word_chars * 100 // n_words) ELSE -1000000 END",
    }
    grid = ", ".join(f"('{rule}', {i + 1}, {c})" for rule, cs in quality_rules.CUTOFFS.items() for i, c in enumerate(cs))
    p = quality_rules.ALPHA / len(score)
    scored = " UNION ALL ".join(f"SELECT doc_id, stratum, '{rule}' AS rule, {s} AS score FROM m WHERE NOT base_failed" for rule, s in score.items())
    return rf"""
        WITH w AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
             g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
             h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
             r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM h) GROUP BY doc_id),
             l AS (SELECT w.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w),
             c AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
                          CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                          CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM l LEFT JOIN r USING (doc_id)),
             m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
             s AS ({scored}),
             good AS (SELECT s.* FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
             grid AS (SELECT * FROM (VALUES {grid}) AS v(rule, step, cutoff)),
             strata AS (SELECT count(DISTINCT stratum) AS strata FROM good),
             k AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k FROM good JOIN grid USING (rule) GROUP BY ALL),
             q AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) <= {quality_rules.DELTA!r} / ({len(score)} * strata) AS ok FROM k, strata),
             o AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS all_ok FROM q),
             limits AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM o WHERE all_ok GROUP BY ALL),
             bad AS (SELECT DISTINCT doc_id FROM s JOIN limits USING (stratum, rule) WHERE score > cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
             f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100""",
    "op3_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
             s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
             c AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
             r AS (SELECT doc_id, list(i ORDER BY i) AS hits FROM s WHERE g IN (SELECT g FROM c) GROUP BY doc_id),
             e AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(hits, lambda x: range(x, x + 35)))) AS i FROM r),
             gone AS (SELECT doc_id, list(i) AS cut, count(*) AS n FROM e GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
                      ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(cut, x)), lambda x: ws[x]), ' ') END) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
                WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.93),
             reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
             c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
             n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op7_mixing": rf"""
        WITH s AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
             g AS (SELECT source, sum(size) AS n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s GROUP BY source),
             t AS (SELECT *, 2.0 * n AS top, 1.5 * sum(n) OVER () AS total, sum(w) OVER () AS all_w,
                          row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS place, coalesce(sum(2.0 * n) OVER b, 0) AS used, coalesce(sum(w) OVER b, 0) AS gone
                   FROM g WINDOW b AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             u AS (SELECT *, (total - used) / (all_w - gone) AS lv FROM t),
             m AS (SELECT arg_min(lv, place) FILTER (WHERE lv * w <= top) AS level FROM u),
             r AS (SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN level IS NULL THEN top ELSE least(top, level * w) END AS target FROM u, m),
             p AS (SELECT s.doc_id, s.size, r.source_size, CAST(r.target AS DOUBLE) AS target, CASE WHEN r.source_size > 0 THEN CAST(r.target AS DOUBLE) / r.source_size ELSE 0 END AS rate,
                          CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS h
                   FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN h < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM p""",
    "op9_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
                   FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
             k AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN k ON d.doc_id = k.a LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_secret_scan": _secrets_sql(),
    "op12_quality_rules": _quality_sql(),
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
             g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
                   UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)
                   UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
             f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
             n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
             c AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
             x AS (SELECT *, 1 AS k, ws[1] AS head, array_to_string(ws[2:], ' ') AS rest FROM c UNION ALL SELECT *, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE size = 3),
             o AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
             s AS (SELECT x.lang, x.phrase, size, a, x.k, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score
                   FROM x JOIN o l ON l.lang = x.lang AND l.phrase = x.head JOIN o r ON r.lang = x.lang AND r.phrase = x.rest),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
             kept AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL) i ON b.lang = i.lang AND b.phrase = i.phrase WHERE most IS NULL OR 100 * most < 50 * b.a),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
}

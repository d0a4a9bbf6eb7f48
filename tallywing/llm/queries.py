"""The operators applied to their whole tables: one query each, with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.llm import ann, dedup_bytes, fim, gam, lexical, licence, linededup, minhash, mixing, packing, rules, secretscan, warc
from tallywing.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary lies; the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), both_ways=True)
    return cut.select("doc_id", "n_lines", "n_removed", "kept_words")


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words",
        "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.labelled(licence.scan(table(spark, sf_dir, "documents")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.counted(secretscan.scan(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{d}_sha256") for c, d in (("output", "output"), ("restored", "restored"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_nearest, op3_lines, op4_repeated_bytes, op5_mixing, op6_classifier, op7_quality_rules, op8_warc, op9_licences,
    op10_near_duplicates, op11_secrets, op12_ranked_search, op13_fill_in_middle)}

_HEX = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

ORACLES: dict[str, str] = {
    "op2_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_lines": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
        b AS (SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k,
                     sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n WHERE w > 0),
        c AS (SELECT a.doc_id, a.k, z.k AS last FROM b AS a JOIN b AS z
              ON a.doc_id = z.doc_id AND z.k >= a.k AND z.upto - a.upto + a.w >= 10),
        e AS (SELECT doc_id, k, min(last) AS last FROM c GROUP BY doc_id, k UNION SELECT doc_id, max(k), last FROM c GROUP BY doc_id, last),
        m AS (SELECT e.doc_id, e.k, e.last, string_agg(z.line, chr(10) ORDER BY z.k) AS name FROM e JOIN b AS z
              ON e.doc_id = z.doc_id AND z.k BETWEEN e.k AND e.last GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, k) AS place FROM m),
        gone AS (SELECT DISTINCT z.doc_id, z.k FROM r JOIN b AS z ON r.doc_id = z.doc_id AND z.k BETWEEN r.k AND r.last WHERE place > 1)
        SELECT d.doc_id, count(b.k) AS n_lines, count(gone.k) AS n_removed,
               coalesce(sum(b.w) FILTER (gone.k IS NULL), 0)::BIGINT AS kept_words
        FROM documents AS d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN gone ON b.doc_id = gone.doc_id AND b.k = gone.k
        GROUP BY d.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        k AS (SELECT *, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM k""",
    "op11_secrets": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        k(kind, place, pattern) AS (VALUES
            ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{6,}'),
            ('access', 2, 'AKIA[A-Z0-9]{16,}'), ('hex', 3, '[0-9a-f]{24,}'), ('host', 4, 'gh[pousr]_[A-Za-z0-9]{36,}'),
            ('signed', 5, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{10,}'), ('key', 6, '-----BEGIN ([A-Z]+ )*PRIVATE KEY-----')),
        m AS (SELECT r, kind, place, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS hits FROM d, k),
        u AS (SELECT r, kind, place, length(unnest(gaps[1:len(hits)])) AS gap, length(unnest(hits)) AS hit, generate_subscripts(hits, 1) AS i
              FROM m WHERE len(hits) > 0),
        s AS (SELECT r, kind, place, CAST(sum(gap + hit) OVER w - hit AS BIGINT) AS a, CAST(sum(gap + hit) OVER w AS BIGINT) AS b FROM u
              WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
        g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                     count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans,
                     string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place <= 3) AS base FROM s GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op12_ranked_search": r"""
        WITH lower_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS little, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, little), term) AS ts FROM documents, lower_case),
        i AS (SELECT row_number() OVER () AS k, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), big, little), term)) AS ts
              FROM (SELECT DISTINCT item_id, text FROM benchmark), lower_case),
        q AS (SELECT k, unnest(ts) AS t FROM i),
        n AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
        f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, n GROUP BY t, n),
        m AS (SELECT r, doc_id, 10 + 90 * len(ts) * n // l AS m FROM d, n WHERE len(ts) > 0),
        c AS (SELECT f.r, f.t, w * (1000000000 * tf // (1000 * tf + 8 * m)) AS share FROM f JOIN w USING (t) JOIN m USING (r)),
        s AS (SELECT q.k, c.r, CAST(sum(share) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY q.k, c.r),
        o AS (SELECT s.k, doc_id, score, CAST(row_number() OVER (PARTITION BY s.k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
              FROM s JOIN m USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o JOIN i USING (k) WHERE rank <= 10""",
    "op13_fill_in_middle": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        c AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_HEX} FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
        p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                                ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}

"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, divergence, exact_dedup, fixity, imatch, mixing, packing, prefix_trie, quality, secrets, simhash, token_files, toxicity
from sparkloom.llm.common import shared_folder, table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.token_spans(token_files.read_token_files(spark, folder))


def op3_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    return fixity.fixity_audit(records, fixity.damaged(records))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_files": op2_token_files,
    "op3_fixity_audit": op3_fixity_audit,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_quality": op9_quality,
    "op10_source_mixing": op10_source_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_divergence_audit": op13_divergence_audit,
}

ORACLES = {
    "op3_fixity_audit": r"""
        WITH r AS (SELECT page_id // 512 AS file, page_id,
            'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
            || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
            || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
            || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
        o AS (SELECT *, coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id, record
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r),
        d AS (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 64 AS draw, length(record) // 2 AS mid FROM o)
        SELECT file, "offset", page_id, CASE draw WHEN 1 THEN 'missing' ELSE 'changed' END AS damage, sha256(record) AS first_sha256,
            CASE draw WHEN 0 THEN sha256(substr(record, 1, mid - 1) || '~' || substr(record, mid + 1)) END AS second_sha256
        FROM d WHERE draw IN (0, 1)""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op10_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':'
                || row_number() OVER (PARTITION BY doc_id, coalesce(text, ''))), 1, 8))::BIGINT / 4294967296::DOUBLE AS draw FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, list_extract([5, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
        r AS (SELECT *, source_size * 3::DOUBLE / weight AS ratio FROM w),
        l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - 3 * coalesce(sum(source_size) OVER up, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level FROM r
            WINDOW up AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(3::DOUBLE * source_size, weight * coalesce(
            (SELECT min({'ratio': ratio, 'level': level}) FROM l WHERE level <= ratio)['level'], 0)) AS target FROM l),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
        SELECT doc_id, size, p.source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source""",
    "op11_prefix_trie": r"""
        WITH poly AS (SELECT list(list_reduce([a] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY a) AS t
            FROM range(256) r(a)),
        ids AS (SELECT DISTINCT conv_id, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc FROM conversations, poly WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM ids),
        own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations GROUP BY conv_id),
        built AS (SELECT c.conv_id, list_concat(coalesce(b.s[:c.h], []), o.s[c.h + 1:]) AS s
            FROM convs c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = c.base),
        steps AS (SELECT conv_id, d::BIGINT AS depth, s[:d] AS prefix, d = len(s) AS ends FROM built, unnest(range(len(s) + 1)) u(d)),
        nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY depth, prefix),
        marked AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved,
            (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[:n.depth] = n.prefix) AS n_children FROM nodes n),
        under AS (SELECT a.depth, a.prefix, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum(b.saved) AS saved_tokens
            FROM marked a JOIN marked b ON b.depth >= a.depth AND b.prefix[:a.depth] = a.prefix GROUP BY a.depth, a.prefix)
        SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves,
            u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
        FROM marked m JOIN under u ON u.depth = m.depth AND u.prefix = m.prefix
        LEFT JOIN marked p ON p.depth = m.depth - 1 AND p.prefix = m.prefix[:m.depth - 1]""",
    "op13_divergence_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
        g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p
            FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS q FROM k JOIN v USING (lang)),
        pairs AS (SELECT g.lang, g.source, o.source AS item FROM g JOIN g o ON g.lang = o.lang AND g.source != o.source),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
        every AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
            UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}

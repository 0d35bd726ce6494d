"""Queries that draw from a corpus, store it as token files and whiten its embeddings."""

from __future__ import annotations

import public_tokenizers

from changeflow.llm.importance import resample
from changeflow.llm.queries import query, table
from changeflow.llm.token_frames import open_tokens, token_digests, write_tokens
from changeflow.llm.whitening import whitened_components
from changeflow.session import work_dir

# The CRC-32 of each distinct feature, bit by bit: a reflected register with the fixed polynomial 0xEDB88320.
OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM w),
bf AS (SELECT unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS f FROM b),
bytes AS (SELECT f, [instr('123456789ABCDEF', hex(f)[2 * i - 1]) * 16 + instr('123456789ABCDEF', hex(f)[2 * i]) FOR i IN range(1, strlen(f) + 1)] AS bs
    FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x:
        list_reduce(list_prepend(xor(c, x), range(8)), lambda r, s: CASE WHEN r % 2 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END))) % 10000 AS bucket
    FROM bytes),
s AS (SELECT bucket, count(*) AS n FROM df JOIN k ON df.f = k.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN k ON bf.f = k.f GROUP BY bucket),
g AS (SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
d AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
    FROM df JOIN k ON df.f = k.f JOIN g ON g.bucket = k.bucket GROUP BY doc_id),
scored AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || w.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM w LEFT JOIN d ON w.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k FROM scored)
SELECT doc_id, n_words, n_features, weight, score,
    CASE WHEN n_words >= 20 AND k <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN k END AS rank FROM r
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark, sf_dir):
    """The weight, score and place in the draw of every document, with ``benchmark`` as the target."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


@query("op12_token_frames")
def op12(spark, sf_dir):
    """Place, length and checksum of every document's ids, read back from the files written."""
    folder = work_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_digests(spark, open_tokens(spark, folder))


@query("op13_polar_whitening")
def op13(spark, sf_dir):
    """The first 32 whitened components of every embedding."""
    return whitened_components(table(spark, sf_dir, "embeddings"))

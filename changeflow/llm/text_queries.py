"""Queries over ``documents``."""

from __future__ import annotations

import public_tokenizers

from changeflow.llm.byte_cnn import learn_quality, score_quality
from changeflow.llm.compression_toxicity import learn_toxicity, score_toxicity
from changeflow.llm.license_scan import GAPS, LOWER, TEMPLATES, THRESHOLD, UPPER, bounds, license_scan, template_words
from changeflow.llm.minhash import near_duplicates
from changeflow.llm.packing import pack
from changeflow.llm.piece_codec import sentencepiece_digests
from changeflow.llm.queries import query, table
from changeflow.llm.repetition import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_LIMIT, repetition_rules
from changeflow.llm.token_counts import token_counts

WORD = r"'[^\x20\x09-\x0D]+'"



def _gram(n: int) -> str:
    return " || ' ' || ".join(["word", *(f"x{k}" for k in range(1, n))])


def _met(n: int) -> str:
    return f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1"


def _inside(flag: str, n: int) -> str:
    return f"max({flag}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1"


OP5_SQL = f"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
x AS (SELECT doc_id, i, word, {", ".join(f"lead(word, {k}) OVER doc AS x{k}" for k in range(1, max(NGRAM_LIMITS)))}
    FROM w WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, length(word) AS chars, {", ".join(f"{_gram(n)} AS g{n}" for n in (3, *NGRAM_LIMITS))} FROM x),
flags AS (SELECT doc_id, i, chars,
    CAST(g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS INTEGER) AS f3,
    {", ".join(f"CAST({_met(n)} AS INTEGER) AS f{n}" for n in NGRAM_LIMITS)} FROM g),
inside AS (SELECT doc_id, chars, {_inside("f3", 3)} AS s3,
    {", ".join(f"{_inside(f'f{n}', n)} AS s{n}" for n in NGRAM_LIMITS)} FROM flags),
grams AS (SELECT doc_id, count(*) FILTER (s3) AS rep,
    {", ".join(f"sum(chars) FILTER (s{n}) AS c{n}" for n in NGRAM_LIMITS)} FROM inside GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM l)),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
        FROM lines WHERE regexp_matches(line, {WORD})) WHERE k > 1 GROUP BY doc_id),
base AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars,
    {", ".join(f"CAST(coalesce(c{n}, 0) AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)}
  FROM l LEFT JOIN dup ON l.doc_id = dup.doc_id LEFT JOIN grams ON l.doc_id = grams.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM base)
SELECT *, NOT (base_failed OR 100 * dup_line_chars > {LINE_LIMIT} * word_chars
    {" ".join(f"OR 100 * dup_{n}gram_chars > {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())}) AS kept
FROM judged
"""


@query("op3_quality_cnn")
def op3(spark, sf_dir):
    """The quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, learn_quality(docs, labels))


LETTERS = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP4_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all({LETTERS}, {WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS shingle FROM l),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
      GROUP BY 1, 2),
links AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, b FROM reach r JOIN links ON a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
    d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""


@query("op4_minhash_dedup", OP4_SQL)
def op4(spark, sf_dir):
    """The component of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_repetition_coverage", OP5_SQL)
def op5(spark, sf_dir):
    """Repetition counts and the verdict of every document."""
    return repetition_rules(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        words = template_words(text)
        least, most = bounds(len(words) - 1, THRESHOLD)
        grams = ", ".join(f"'{a} {b}'" for a, b in zip(words, words[1:], strict=False))
        rows.append(f"('{name}', {len(words) - 1}, {least}, {most}, [{grams}])")
    return ", ".join(rows)


OP6_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_template_rows()}) v(license, n, least, most, grams)),
tg AS (SELECT license, gram, count(*) AS k FROM (SELECT license, unnest(grams) AS gram FROM t) GROUP BY ALL),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}', ' ', 'g') AS s FROM documents),
ls AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(s, chr(10)) AS ls FROM d)),
units AS (SELECT * FROM ls UNION ALL SELECT doc_id, regexp_replace(s, '[ \\n]+', ' ', 'g'), 0 FROM d WHERE contains(s, chr(10))),
words AS (SELECT doc_id, line, string_split(trim(s), ' ') AS ws FROM units),
likely AS (SELECT DISTINCT w.* FROM words w JOIN t ON len(ws) - 1 BETWEEN least AND most),
grams AS (SELECT doc_id, line, n, gram, count(*) AS k FROM (
    SELECT doc_id, line, len(ws) - 1 AS n, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS gram FROM likely) GROUP BY ALL),
scores AS (SELECT doc_id, line, g.n, tg.license, sum(least(g.k, tg.k)) AS common FROM grams g JOIN tg ON g.gram = tg.gram GROUP BY ALL),
word AS (SELECT doc_id, line, word, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS place FROM (
    SELECT doc_id, line, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM words WHERE line > 0) WHERE word <> ''),
pair AS (SELECT doc_id, line, place, word || ' ' || lead(word) OVER w AS gram, count(*) OVER (PARTITION BY doc_id) - 1 AS total
    FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
hits AS (SELECT p.*, tg.license, tg.k, t.n FROM pair p JOIN tg ON p.gram = tg.gram JOIN t ON t.license = tg.license),
often AS (SELECT doc_id, license FROM hits GROUP BY doc_id, license, n HAVING count(*) >= 0.6 * n),
near AS (SELECT hits.* FROM hits JOIN often USING (doc_id, license)),
inside AS (SELECT h.doc_id, h.license, h.place, h.line, h.n, least(h.n, h.total - h.place) AS size, x.gram, least(count(*), any_value(x.k)) AS k
    FROM near h JOIN near x ON h.doc_id = x.doc_id AND h.license = x.license AND x.place BETWEEN h.place AND h.place + h.n - 1 GROUP BY ALL),
windows AS (SELECT doc_id, line, license, 2.0::DOUBLE * sum(k) / (size + n) AS score, sum(k) AS common FROM inside GROUP BY doc_id, license, place, line, n, size),
found AS (SELECT doc_id, line, s.license, 2.0::DOUBLE * common / (s.n + t.n) AS score, common FROM scores s JOIN t ON s.license = t.license
    WHERE s.n BETWEEN least AND most UNION ALL SELECT doc_id, line, license, score, common FROM windows),
named AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY score DESC, line, common DESC) AS k FROM found WHERE score >= {THRESHOLD}),
best AS (SELECT doc_id, line, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, score DESC, line, license) AS k,
    count(*) OVER (PARTITION BY doc_id) AS n FROM named WHERE k = 1)
SELECT d.doc_id, CAST(coalesce(b.n, 0) AS BIGINT) AS n_matches, b.license, CAST(b.line AS INTEGER) AS line, b.score
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.k = 1
"""


@query("op6_license_dice", OP6_SQL)
def op6(spark, sf_dir):
    """The best license match of every document."""
    return license_scan(table(spark, sf_dir, "documents"))


@query("op7_toxicity_compression")
def op7(spark, sf_dir):
    """The toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, learn_toxicity(docs, labels))


@query("op8_token_counts")
def op8(spark, sf_dir):
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    return sentencepiece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_bestfit_packing")
def op10(spark, sf_dir):
    """The place of every piece of every document in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

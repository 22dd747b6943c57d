"""One registered query for each operator, over its whole table, with reference SQL where there is some."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradecut.llm import chat, decontaminate, language, lexical, licenses, mainpage, pieces, quality, reputation, simhash, topk
from gradecut.llm import toxicity, whitening
from gradecut.llm.common import held_out, read_table


ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the sentences that offend."""
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_on_folds(documents, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "spans"
    )


def op3_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return mainpage.extract_pages(read_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the training examples of every conversation, and of one with control strings, say."""
    kind = "conv_id bigint, turn bigint, role string, text string"
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], kind)
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(conversations.unionByName(odd)))


def op6_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = reputation.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    documents = read_table(spark, sf_dir, "documents")
    return language.predict(documents, language.fit_on_folds(documents)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every document with the benchmark."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n best segmentations of every document, and whether the best one decodes to its text."""
    return pieces.tokenize(read_table(spark, sf_dir, "documents"), pieces.load_vocabulary())


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every query vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each benchmark item best."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the quality rules keep it."""
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_mainpage": op3_mainpage,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_reputation": op6_reputation,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_pieces": op9_pieces,
    "op10_topk": op10_topk,
    "op11_lexical": op11_lexical,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

_CHAT = """
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
),
turns AS (
    SELECT conv_id, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n,
        22 + length(replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), '<', '\\<'))
           + length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '<', '\\<')) AS chars
    FROM given
),
grown AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM turns
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(prefix) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
"""

_REPUTATION = """
WITH rest AS (
    SELECT page_id, url,
        coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END, '') AS rest
    FROM pages
),
split AS (
    SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
),
parts AS (
    SELECT page_id, url,
        translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM split
),
labelled AS (
    SELECT host, string_split(host, '.') AS labels FROM (SELECT DISTINCT host FROM parts)
),
suffixed AS (
    SELECT host, labels,
        len(labels) > 2 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
            AND length(labels[-1]) = 2 AS two
    FROM labelled
),
names AS (
    SELECT host,
        CASE WHEN two THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix,
        CASE WHEN two THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain
    FROM suffixed
),
marks AS (
    SELECT doc_id,
        CAST(coalesce(min(quality), 1) > 0 AND coalesce(max(toxic), 0) <= 0 AS INT) AS good
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
shown AS (
    SELECT host, good FROM parts
    JOIN marks ON TRY_CAST(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) AS BIGINT) = marks.doc_id
),
seen AS (
    SELECT host, suffix, domain, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS k
    FROM shown JOIN names USING (host) GROUP BY ALL
),
whole AS (
    SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5e0) / (sum(n) + 1) ELSE 0.5e0 END AS rate FROM seen
),
s0 AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS m FROM seen, whole GROUP BY suffix
),
s1 AS (
    SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN 1e0 / least(greatest(
        (sum((k - n * m) * (k - n * m) / n) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 1e0 / 201), 1e0 / 3) - 1 END, 200e0) AS s
    FROM s0
),
by_suffix AS (SELECT suffix, (k + s * m) / (n + s) AS mean, s FROM s0, s1),
d0 AS (
    SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS m
    FROM seen JOIN by_suffix USING (suffix) GROUP BY domain, suffix
),
d1 AS (
    SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN 1e0 / least(greatest(
        (sum((k - n * m) * (k - n * m) / n) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 1e0 / 201), 1e0 / 3) - 1 END, 200e0) AS s
    FROM d0
),
by_domain AS (SELECT domain, (k + s * m) / (n + s) AS mean, s FROM d0, d1),
h0 AS (SELECT host, n, k, mean AS m FROM seen JOIN by_domain USING (domain)),
h1 AS (
    SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN 1e0 / least(greatest(
        (sum((k - n * m) * (k - n * m) / n) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 1e0 / 201), 1e0 / 3) - 1 END, 200e0) AS s
    FROM h0
),
by_host AS (SELECT host, (k + s * m) / (n + s) AS mean, n + s AS weight FROM h0, h1),
known AS (
    SELECT host,
        coalesce(h.mean, d.mean, f.mean, rate) AS mean,
        CASE WHEN h.mean IS NOT NULL THEN h.weight WHEN d.mean IS NOT NULL THEN d.s WHEN f.mean IS NOT NULL THEN f.s ELSE 2e0 END AS weight
    FROM names LEFT JOIN by_host h USING (host) LEFT JOIN by_domain d USING (domain) LEFT JOIN by_suffix f USING (suffix), whole
),
judged AS (
    SELECT page_id, host, path, mean,
        mean - sqrt(mean * (1 - mean) / (weight + 1)) AS bound,
        CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
        END AS rule
    FROM parts JOIN known USING (host)
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN bound >= 0.6e0 THEN 'allow' ELSE 'block' END AS verdict
FROM judged
"""

_TOPK = """
WITH whole AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: floor(64e0 * CAST(x AS DOUBLE)))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
    FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_LEXICAL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
asked AS (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
wanted AS (SELECT q, item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
whole AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs),
each AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM each SEMI JOIN wanted USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole
),
scored AS (
    SELECT q, item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM wanted JOIN tf USING (term) JOIN weighted USING (term), whole
    GROUP BY q, item_id, r, doc_id
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INT) AS rank
    FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_STOPS = sorted({w for words in quality.STOP_WORDS.values() for w in words.split()})

_QUALITY = rf"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: x IN ({", ".join(f"'{w}'" for w in _STOPS)}))) AS stops
    FROM given
),
places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM cut),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM places
),
repeated AS (
    SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE times > 1) GROUP BY r
),
counts AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, stops, len(lines) AS n_lines
    FROM cut LEFT JOIN repeated USING (r)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * word_chars BETWEEN 250 * n_words AND 1200 * n_words AND 100 * n_symbols <= 20 * n_words
        AND 100 * stops >= 6 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM based
"""

ORACLES: dict[str, str] = {
    "op5_chat": _CHAT,
    "op6_reputation": _REPUTATION,
    "op10_topk": _TOPK,
    "op11_lexical": _LEXICAL,
    "op13_quality": _QUALITY,
}

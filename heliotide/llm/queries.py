"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotide.llm import automaton, collocations, decontaminate, divergence, exact, licences, near, packing, quality, secrets, suffixes, tokenfile, toxicity
from heliotide.llm.arrow import remainder
from heliotide.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op7_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), w AS (
    SELECT doc_id, norm,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    vectors = cut_lineage(quality.statistics_of(docs))
    model = quality.fit(vectors.join(labels, "doc_id"))
    return quality.scored(vectors, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _canonical_sql(text: str) -> str:
    out = f"lower({text})"
    for pattern, to in licences.EQUIVALENT:
        # RE2 has no look-ahead: the one pattern that has it is written with a group instead.
        pattern, to = pattern.replace("(?=[0-9])", "([0-9])"), to.replace("$1", chr(92) + "1")
        to = to + (chr(92) + "1" if "([0-9])" in pattern else "")
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{to}', 'g')"
    return f"regexp_replace(regexp_replace({out}, '{licences.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _licence_sql() -> str:
    pairs = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)
    joined = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    filled = lambda units: f"list_filter(list_transform({units}, lambda t: {joined('t')}), lambda t: t <> '')"
    return f"""
WITH known AS (
    SELECT DISTINCT licence, {joined(_canonical_sql("t"))} AS canon FROM (VALUES {pairs}) AS k(licence, t)
), texts AS (
    SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS c FROM documents
), parts AS (
    SELECT doc_id, {filled("[c]")} AS whole, {filled("regexp_split_to_array(c, '\\n(?: *\\n)+')")} AS paragraphs,
           {filled("string_split(c, chr(10))")} AS lines FROM texts
), units AS (
    SELECT doc_id, 'text' AS scope, i, whole[i] AS t FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM parts)
    UNION ALL
    SELECT doc_id, 'paragraph', i, paragraphs[i] FROM (SELECT *, unnest(range(1, len(paragraphs) + 1)) AS i FROM parts WHERE len(paragraphs) > 1)
    UNION ALL
    SELECT doc_id, 'line', i, lines[i] FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM parts WHERE len(lines) > 1)
), met AS (
    SELECT doc_id, scope, i, licence FROM units JOIN known ON units.t = known.canon
), found AS (
    SELECT doc_id, min(licence) FILTER (scope = 'text') AS whole_licence,
           array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences, count(DISTINCT (scope, i)) AS n_units
    FROM met GROUP BY doc_id
)
SELECT d.doc_id, whole_licence, coalesce(licences, '') AS licences, coalesce(n_units, 0) AS n_units
FROM documents d LEFT JOIN found USING (doc_id)
"""


ORACLES["op9_licences"] = _licence_sql()


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op3_substring_dedup"] = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), own AS (
    SELECT k, min(doc_id) AS o FROM win GROUP BY k
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (k) WHERE o < doc_id
), words AS (
    SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op6_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
    FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)
), hit AS (
    SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, k)
), places AS (
    SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), vec AS (
    SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL
), vocabulary AS (
    SELECT lang, term, sum(n)::HUGEINT AS total FROM vec GROUP BY lang, term HAVING count(*) >= 3
), langs AS (
    SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN vocabulary USING (lang) GROUP BY lang
), sums AS (
    SELECT lang, source, term, sum(vec.n)::HUGEINT AS c FROM vec JOIN vocabulary USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) GROUP BY lang, source
), probs AS (
    SELECT g.lang, g.source, t.term, coalesce(s.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(s.c, 0) + 1) // (g.n + l.v) AS p,
           1 + 1000000000::HUGEINT * (t.total + 1) // (l.n + l.v) AS q
    FROM groups g JOIN langs l USING (lang) JOIN vocabulary t USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.term = t.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM probs WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), grams AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
), counts AS (
    SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, sum(a)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE k > 1 AND a >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.k, c.a, cut, l.a AS l, r.a AS r, n, 1000 * c.a * n // (l.a * r.a) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN totals t ON t.lang = c.lang
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), rest AS (
    SELECT * FROM weakest w WHERE NOT EXISTS (
        SELECT 1 FROM candidates c
        WHERE c.lang = w.lang AND c.k > w.k AND 100 * c.a >= 100 * w.a AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ')
    )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM rest QUALIFY rank <= 2000
"""


@query
def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.report(table(spark, sf_dir, "documents"))

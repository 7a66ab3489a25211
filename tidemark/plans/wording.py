"""Queries over the words of documents and over events as words with times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import wording
from tidemark.plans.registry import query
from tidemark.plans.timeline import E_SQL, SILENCE, VIEW
from tidemark.sources.tables import table

#: How a sentence says what its term is, and what hits of sensitive text look like.
DEFINES = r"^(\p{Lu}[^\s,:;|]*(?: [^\s,:;|]+){0,3}?)(?: (?:is|means|est|désigne) |: | – )([^\n]*\S+ \S+ \S+[^\n]*)$"
CARD = r"(?:^|[^0-9])([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})(?:[^0-9]|$)"
ADDRESS = r"(?:^|[^0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})(?:[^0-9]|$)"
SECRET = r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]{8,})"
#: The share of documents beyond which a word marks none.
COMMON = 0.05
#: Events that carry nothing anywhere, and those that may not.
SURE, DOUBTFUL = ["error"], ["view", "click"]

TERMS_SQL = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(line), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM l),
    e AS (SELECT doc_id, unnest(ts) AS a, unnest(list_concat(ts[2:], [NULL])) AS b FROM k),
    o AS (SELECT doc_id, a AS term FROM e WHERE a IS NOT NULL UNION ALL SELECT doc_id, a || ' ' || b FROM e WHERE b IS NOT NULL),
    c AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM o GROUP BY term),
    s AS (SELECT * FROM c WHERE NOT contains(term, ' ')),
    p AS (SELECT c.*, c.n * (SELECT CAST(sum(n) AS DOUBLE) FROM s) / (CAST(a.n AS DOUBLE) * CAST(b.n AS DOUBLE)) AS lift
          FROM c JOIN s a ON a.term = split_part(c.term, ' ', 1) JOIN s b ON b.term = split_part(c.term, ' ', 2) WHERE contains(c.term, ' ') AND c.n >= 2),
    d AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM documents)
"""


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text")


def _n_docs(docs: DataFrame) -> int:
    return docs.agg(F.count_distinct("doc_id")).first()[0]


@query("phrase_scores", f"WITH {TERMS_SQL} SELECT term, n, n_docs, round(lift, 3) AS lift FROM p WHERE lift >= 10")
def phrase_scores(spark: SparkSession, root: str) -> DataFrame:
    found = wording.term_statistics(_documents(spark, root), "doc_id", "text")
    return found.where("lift IS NOT NULL").withColumn("lift", F.round("lift", 3))


@query(
    "punch_words",
    f"""
    WITH {TERMS_SQL}, r AS (SELECT term, n_docs FROM s UNION ALL SELECT term, n_docs FROM p WHERE lift >= 10),
         f AS (SELECT doc_id, term, count(*) AS n FROM o WHERE length(term) > 1 GROUP BY ALL),
         w AS (SELECT f.*, CAST(round(1000 * f.n * ln(d.n / r.n_docs)) AS BIGINT) AS score FROM f JOIN r USING (term), d WHERE r.n_docs <= {COMMON} * d.n)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(term) DESC, term) AS INT) AS rank, term, n, score FROM w QUALIFY rank <= 3
    """,
)
def punch_words(spark: SparkSession, root: str) -> DataFrame:
    docs = _documents(spark, root)
    return wording.punch_words(docs, wording.term_statistics(docs, "doc_id", "text"), "doc_id", "text", _n_docs(docs), common=COMMON)


@query(
    "definition_cards",
    rf"""
    WITH {TERMS_SQL}, x AS (SELECT doc_id, regexp_split_to_array(text, '[.!?][ \t]+|\n') AS s FROM documents),
         y AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sentence FROM x),
         h AS (SELECT doc_id, sentence, regexp_extract(s, '{DEFINES}', 1) AS term, regexp_extract(s, '{DEFINES}', 2) AS definition FROM y WHERE regexp_matches(s, '{DEFINES}'))
    SELECT doc_id, sentence, term, definition FROM h
    WHERE EXISTS (SELECT 1 FROM s, d WHERE list_contains(regexp_split_to_array(lower(h.term), '[^\p{{L}}\p{{N}}]+'), s.term) AND s.n_docs <= {COMMON} * d.n)
    """,
)
def definition_cards(spark: SparkSession, root: str) -> DataFrame:
    docs = _documents(spark, root)
    return wording.definition_cards(docs, wording.term_statistics(docs, "doc_id", "text", phrases=False), "doc_id", "text", _n_docs(docs), DEFINES, common=COMMON)


@query(
    "context_fillers",
    f"""
    WITH {E_SQL},
         v AS (SELECT event_id, user_id, event_type AS w, t, t + {VIEW} AS u, lead(event_type) OVER o AS n1, lead(event_type, 2) OVER o AS n2, lead(event_type, 3) OVER o AS n3,
                      t - lag(t + {VIEW}) OVER o AS before, lead(t) OVER o - (t + {VIEW}) AS after FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
         q AS (SELECT *, w = n2 AND n1 = n3 AND w <> n1 AND after < {SILENCE} AND lead(after) OVER o < {SILENCE} AS pair FROM v WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
         z AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY user_id ORDER BY t, event_id), FALSE) AS second FROM q),
         f AS (SELECT event_id, user_id, CASE WHEN w IN ('error') THEN 'sure' WHEN coalesce(w = n1 AND after < {SILENCE}, FALSE) OR coalesce(pair, FALSE) OR second THEN 'repeat'
                    WHEN w IN ('view', 'click') AND coalesce(before >= {SILENCE}, TRUE) AND coalesce(after >= {SILENCE}, TRUE) THEN 'pause' END AS reason FROM z)
    SELECT * FROM f WHERE reason IS NOT NULL
    """,
)
def context_fillers(spark: SparkSession, root: str) -> DataFrame:
    """Events as words of a clip, each as long as a view; those that carry nothing where they stand."""
    t = F.timestamp_diff("SECOND", F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz"), F.col("ts"))
    words = table(spark, root, "events").select("event_id", "user_id", "event_type", t.alias("t"), (t + VIEW).alias("u"))
    found = wording.fillers_by_context(words, ["user_id"], ["t", "event_id"], "event_type", "t", "u", SURE, DOUBTFUL, SILENCE)
    return found.select("event_id", "user_id", "reason")


LUHN_SQL = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(x[i] AS INT) ELSE CAST(x[i] AS INT) * 2 - CASE WHEN CAST(x[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


@query(
    "checked_hits",
    f"""
    WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{CARD}', 1), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) AS cards,
                      list_transform(regexp_extract_all(text, '{ADDRESS}', 1), lambda m: list_transform(string_split(m, '.'), lambda y: CAST(y AS INT))) AS nets,
                      regexp_extract_all(text, '{SECRET.replace("'", "''")}', 1) AS secrets FROM documents)
    SELECT doc_id, len(list_filter(cards, lambda x: {LUHN_SQL})) AS n_card,
           len(list_filter(nets, lambda x: list_max(x) <= 255 AND NOT (x[1] IN (0, 10, 127) OR (x[1] = 192 AND x[2] = 168) OR (x[1] = 172 AND x[2] BETWEEN 16 AND 31)))) AS n_address,
           len(list_filter(secrets, lambda x: len(list_distinct(string_split(x, ''))) >= 6 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))) AS n_secret FROM h
    """,
)
def checked_hits(spark: SparkSession, root: str) -> DataFrame:
    """What makes a document sensitive, counted only where check digits, ranges or variety bear it out."""
    rules = {
        "card": (CARD, lambda m: wording.luhn_valid(F.regexp_replace(m, "[^0-9]", ""))),
        "address": (ADDRESS, wording.octets_valid),
        "secret": (SECRET, lambda m: wording.varied(m, 6)),
    }
    return wording.hits(_documents(spark, root), "text", rules).drop("text")

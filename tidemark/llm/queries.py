"""The queries of this subpackage, with production parameters, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.additive_model import fit, score_quality
from tidemark.llm.centroids import cluster
from tidemark.llm.chat import format_paths, read_loss, read_turns
from tidemark.llm.decontamination import find_items
from tidemark.llm.hard_negatives import mine_negatives
from tidemark.llm.jaccard_join import link_similar
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.lm_scoring import score_difference
from tidemark.llm.packing import pack
from tidemark.llm.pii import replace_entities
from tidemark.llm.quality import judge
from tidemark.llm.secrets_scan import scan_secrets
from tidemark.llm.token_counts import count_tokens
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, root: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, root, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_packing")
def op3_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """``docs`` packed with the public byte-level vocabulary."""
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    found = scan_secrets(table(spark, root, "documents"))

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), base, joined(F.col("spans")).alias("spans"))


#: Conversation -1 of op9: its texts hold the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


@query(
    "op9_chat_formatting",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
         e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped FROM c),
         g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                      sum(length(role) + length(escaped) + 24) AS formatted_chars FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
           CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
    """,
)
def op9_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], rows.schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.unionByName(marked).withColumn("node", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    out = format_paths(rows)
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "n_turns", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return judge(table(spark, root, "documents")).drop("__tm_text_hash")


@query(
    "op4_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
         l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM d WHERE text <> ''),
         v AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM l),
         h AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM v),
         e AS (SELECT *, i = n - 1 OR (h * 31 + coalesce(lag(h) OVER o, 0)) % 1000003 % 4 = 0 OR w >= 50 OR coalesce(lead(w) OVER o, 0) >= 50 AS stop FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
         g AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
         p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 16 AS part FROM g),
         c AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM p GROUP BY doc_id, run, part),
         s AS (SELECT doc_id, a, b FROM c UNION SELECT doc_id, a, unnest(range(a + 1, b)) FROM c UNION SELECT doc_id, unnest(range(a + 1, b)), b FROM c),
         q AS (SELECT s.* FROM s JOIN h AS x ON x.doc_id = s.doc_id AND x.i = s.a JOIN h AS y ON y.doc_id = s.doc_id AND y.i = s.b
               WHERE (s.b > s.a OR x.w >= 50) AND NOT (s.b > s.a AND x.w > 0 AND y.w > 0 AND y.upto - x.upto + x.w >= 50)),
         u AS (SELECT doc_id, i, w, upto, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h WHERE w > 0),
         y AS (SELECT x.doc_id, x.i AS a, y.i AS b FROM u AS x JOIN u AS y ON y.doc_id = x.doc_id AND y.k > x.k AND y.k < x.k + 50 AND y.upto - x.upto + x.w >= 50),
         z AS (SELECT * FROM q UNION SELECT doc_id, a, min(b) FROM y GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM y GROUP BY doc_id, b),
         q2 AS (SELECT z.doc_id, z.a, z.b, array_to_string(d.ls[z.a + 1 : z.b + 1], chr(10)) AS bytes FROM z JOIN d USING (doc_id)),
         r AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, a) AS k FROM q2),
         x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE k > 1),
         k AS (SELECT l.doc_id, count(x.i) AS gone, string_agg(CASE WHEN x.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS left_over FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(k.gone, 0) = 0 THEN d.text ELSE coalesce(k.left_over, '') END AS text, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_lines_removed
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op4_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return dedup_lines(table(spark, root, "documents").select("doc_id", "text"))


@query(
    "op10_decontamination",
    r"""
    WITH w AS (SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
               UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
         i AS (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0),
         s AS (SELECT DISTINCT kind, id, array_to_string(ws[k : k + 4], ' ') AS shingle FROM i),
         n AS (SELECT id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY id)
    SELECT d.id AS doc_id, b.id AS item_id, n.n_shingles, count(*) AS n_shared
    FROM s AS d JOIN s AS b ON d.shingle = b.shingle AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
    GROUP BY ALL HAVING 100 * count(*) >= 80 * n.n_shingles
    """,
)
def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return find_items(table(spark, root, "documents"), table(spark, root, "benchmark")).drop("__tm_row")


@query(
    "op7_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
         i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0),
         s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS shingle FROM i),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
         l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
         e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
         r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
         c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
)
def op7_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return link_similar(table(spark, root, "documents"))


#: The key of op8's surrogates; a user passes a secret of their own.
SURROGATE_KEY = "tidemark"


@query("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, root: str) -> DataFrame:
    return replace_entities(table(spark, root, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    good = table(spark, root, "labels").where("quality = 1").select("doc_id")
    return score_difference(table(spark, root, "documents"), good)


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    remainder = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3
    labels = table(spark, root, "labels").where(remainder("doc_id") != 1).select("doc_id", "quality")
    scored = score_quality(docs, fit(docs, labels))
    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op12_hard_negatives",
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
         s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
         p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
    """,
)
def op12_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(rows, F.col("vec_id") % 50 == 0)


def _round(r: int) -> str:
    """SQL of a round: vectors go to the nearest of the centroids c{r}, which then move to c{r + 1}; sums are divided towards minus infinity."""
    return f"""
         a{r} AS (SELECT vec_id, k, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} AS c USING (i) GROUP BY ALL),
         d{r} AS MATERIALIZED (SELECT * FROM a{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1),
         m{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM d{r} JOIN v USING (vec_id) GROUP BY ALL),
         c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} AS c LEFT JOIN m{r} USING (k, i)),"""


@query(
    "op13_centroid_clustering",
    f"""
    WITH v AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
                            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
         s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM v) QUALIFY k < 16),
         c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN v USING (vec_id)),{"".join(map(_round, range(4)))}
         h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY k)
    SELECT vec_id, CAST(k AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM d3 JOIN h USING (k)
    """,
)
def op13_centroid_clustering(spark: SparkSession, root: str) -> DataFrame:
    return cluster(table(spark, root, "embeddings"))

"""Prompt, response and training-data queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from obsframe.catalog.registry import query
from obsframe.operators import corpus as c
from obsframe.operators import functional as f
from obsframe.operators import training as t
from obsframe.views import Lake

WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
VOCAB = f"""
    vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word))"""


def _prompts(lake: Lake) -> DataFrame:
    """The first user message of each conversation stands for the task's prompt."""
    return lake.agent_turns.groupBy(F.col("agent_id").alias("task")).agg(F.min_by("query", "position").alias("prompt"))


def _responses(lake: Lake) -> DataFrame:
    return lake.conversations.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("task"), F.concat(F.lit("model-"), F.floor(F.col("turn") / 2).cast("string")).alias("model"),
        "turn", F.col("text").alias("body"))


PROMPTS = "prompts AS (SELECT agent_id AS task, arg_min(query, position) AS prompt FROM agent_turns GROUP BY agent_id)"
RESPONSES = """responses AS (SELECT conv_id AS task, 'model-' || (turn // 2) AS model, turn, text AS body
                              FROM conversations WHERE role = 'assistant')"""


@query("prompt_response_join", f"""
    WITH {PROMPTS}, {RESPONSES}
    SELECT r.task, r.model, r.turn, r.body, p.prompt FROM responses r JOIN prompts p ON p.task = r.task
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    return c.prompt_response_join(_prompts(lake), _responses(lake))


@query("model_side_by_side", """
    WITH best AS (SELECT workload AS task, platform AS model, max(latency_ms) AS body FROM requests GROUP BY ALL)
    SELECT b.task, b.body AS base, o.body AS other FROM best b JOIN best o ON o.task = b.task
    WHERE b.model = 'platform-0' AND o.model = 'platform-3'
""", "requests")
def _(lake: Lake) -> DataFrame:
    best = lake.requests.groupBy(F.col("workload").alias("task"), F.col("platform").alias("model")).agg(F.max("latency_ms").alias("body"))
    return c.side_by_side(best, "platform-0", "platform-3")


@query("corpus_coverage", f"""
    WITH {RESPONSES}, grid AS (SELECT task, model FROM (SELECT DISTINCT conv_id AS task FROM conversations),
                               (SELECT DISTINCT model FROM responses UNION SELECT 'model-none'))
    SELECT g.task, g.model, CASE WHEN r.task IS NULL THEN 0 ELSE 1 END AS present
    FROM grid g LEFT JOIN (SELECT DISTINCT task, model FROM responses) r ON r.task = g.task AND r.model = g.model
""")
def _(lake: Lake) -> DataFrame:
    responses = _responses(lake)
    models = sorted(r["model"] for r in responses.select("model").distinct().collect())  # one per turn number
    return c.coverage(responses, lake.conversations.select(F.col("conv_id").alias("task")), [*models, "model-none"])


@query("corpus_missing", """
    WITH cells AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IN ('en', 'de', 'fr') AND doc_id % 4 = 1)
    SELECT s.source AS task, l.lang AS model FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s, (VALUES ('en'), ('de'), ('fr'), ('it')) l(lang)
    WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.source = s.source AND c.lang = l.lang)
""")
def _(lake: Lake) -> DataFrame:
    docs = lake.documents.where("source is not null").select("doc_id", F.col("source").alias("task"), F.col("lang").alias("model"))
    answered = docs.where(F.col("doc_id") % 4 == 1)  # the corpus that was answered: languages stand for models, sources for tasks
    return c.missing_responses(answered, docs, ["en", "de", "fr", "it"])


@query("prompt_id_audit", """
    SELECT 'doc' || doc_id AS task, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE 'other' || doc_id END AS id
    FROM documents WHERE doc_id % 9 = 0 OR doc_id % 9 = 4
""")
def _(lake: Lake) -> DataFrame:
    key, number = F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("doc_id") % 9
    other = F.concat(F.lit("other"), F.col("doc_id").cast("string"))
    own = F.when(number == 0, other).when(number != 4, key)
    return c.prompt_id_audit(lake.documents.select(key.alias("task"), own.alias("id")))


@query("split_head_pct", """
    SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (ORDER BY doc_id) <= round((SELECT count(*) FROM documents) * 0.01)
""")
def _(lake: Lake) -> DataFrame:
    return t.split_head(lake.documents.select("doc_id", "lang"), 1, ["doc_id"])


@query("epoch_shuffle", """
    SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':' || 3), doc_id) AS position FROM documents
""")
def _(lake: Lake) -> DataFrame:
    return t.epoch_shuffle(lake.documents.select("doc_id"), "doc_id", 3)


@query("worker_shard", """
    WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS spot FROM documents),
    total AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7) * 7 AS BIGINT) AS padded FROM documents)
    SELECT doc_id, spot AS position, spot % 7 AS shard FROM numbered
    UNION ALL SELECT doc_id, spot + n, (spot + n) % 7 FROM numbered, total WHERE spot < padded - n
""")
def _(lake: Lake) -> DataFrame:
    return t.worker_shard(lake.documents.select("doc_id"), 7, ["doc_id"])


@query("make_batches", """
    SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch,
           CAST(ceil((SELECT count(*) FROM documents) / 32) AS BIGINT) AS steps_per_epoch FROM documents
""")
def _(lake: Lake) -> DataFrame:
    return t.make_batches(lake.documents.select("doc_id"), 32, ["doc_id"])


@query("build_vocab", f"WITH {VOCAB} SELECT word, n, id FROM vocab")
def _(lake: Lake) -> DataFrame:
    return t.build_vocab(lake.documents)


@query("encode_fixed", f"""
    WITH {VOCAB},
    kept AS (SELECT doc_id, unnest({WORDS}[1:512]) AS word, unnest(range(1, 1 + least(len({WORDS}), 512))) AS pos FROM documents),
    ids AS (SELECT doc_id, pos, id FROM kept JOIN vocab USING (word))
    SELECT d.doc_id, CAST(512 AS BIGINT) AS length, count(i.id) AS mask_sum,
           CAST(coalesce(sum(i.id * i.pos), 0) AS BIGINT) AS checksum,
           coalesce(max(i.id) FILTER (i.pos = 1), 0) AS first_id
    FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id GROUP BY d.doc_id
""")
def _(lake: Lake) -> DataFrame:
    out = t.encode_fixed(lake.documents, t.build_vocab(lake.documents))
    weighted = F.transform("input_ids", lambda x, i: x.cast("long") * (i + 1))
    add = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", F.size("input_ids").cast("long").alias("length"), add("attention_mask").alias("mask_sum"),
                      add(weighted).alias("checksum"), F.col("input_ids")[0].cast("long").alias("first_id"))


@query("resume_epoch", "SELECT coalesce(max(epoch) + 1, 0) AS next_epoch FROM training_steps", "training_steps")
def _(lake: Lake) -> DataFrame:
    return t.resume_epoch(lake.training_steps)


@query("epoch_loss", """
    SELECT epoch, count(*) AS steps, round(avg(loss), 9) AS loss FROM training_steps GROUP BY epoch
""", "training_steps")
def _(lake: Lake) -> DataFrame:
    return t.epoch_loss(lake.training_steps).withColumn("loss", F.round("loss", 9))


@query("validate_chat", """
    WITH talk AS (SELECT conv_id, turn, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS again
                  FROM conversations WHERE role <> 'system'),
    checks AS (SELECT c.conv_id, count(*) AS messages,
               count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) AS unknown_roles,
               count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_messages,
               count(*) FILTER (again) AS repeated_roles, arg_max(role, c.turn) = 'assistant' AS ends_with_assistant
        FROM conversations c LEFT JOIN talk t ON t.conv_id = c.conv_id AND t.turn = c.turn GROUP BY c.conv_id)
    SELECT *, unknown_roles = 0 AND empty_messages = 0 AND repeated_roles = 0 AND ends_with_assistant AS valid FROM checks
""")
def _(lake: Lake) -> DataFrame:
    return t.validate_chat(lake.conversations)


@query("map_rows", "SELECT doc_id, length(text) AS length, upper(lang) AS lang FROM documents")
def _(lake: Lake) -> DataFrame:
    return f.map_rows(lake.documents.select("doc_id", "text", "lang"),
                      lambda row: {"doc_id": row["doc_id"], "length": len(row["text"]), "lang": row["lang"].upper()},
                      "doc_id long, length long, lang string")


@query("map_batches", "SELECT doc_id, n_chars * 2 AS twice FROM documents")
def _(lake: Lake) -> DataFrame:
    return f.map_batches(lake.documents.select("doc_id", "n_chars"),
                         lambda batch: batch.assign(twice=batch.n_chars * 2)[["doc_id", "twice"]], "doc_id long, twice long")


def _doubling():
    return lambda values: values * 2.0


@query("predict_batches", "SELECT event_id, value * 2 AS prediction FROM events")
def _(lake: Lake) -> DataFrame:
    rows = lake.events.select("event_id", "value")
    return f.predict_batches(rows, _doubling, ["value"], "prediction", DoubleType()).drop("value")


@query("inspect_dataset")
def _(lake: Lake) -> DataFrame:
    return f.inspect(lake.documents)

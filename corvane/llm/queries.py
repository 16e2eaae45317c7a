"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import filter_audit, language, licenses, mixing, neighbours, packing, pieces, quality_model, quality_rules, repair, simhash, toolcalls, urlfilter
from corvane.llm.common import documents, fold_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query(
    r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (
               ORDER BY 3.0::DOUBLE * source_size / weight, source_size, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source_size, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM sources),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, max(own_level) OVER () * weight) AS target
  FROM levels),
per AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
by_digest AS (SELECT source, digest, sum(size) AS words FROM sized GROUP BY ALL),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY digest) - words / 2 AS middle FROM by_digest)
SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
       p.whole + CASE WHEN round(p.target - p.whole * p.source_size) > 0
                       AND r.middle <= round(p.target - p.whole * p.source_size) THEN 1 ELSE 0 END AS times,
       (s.size * (p.whole + CASE WHEN round(p.target - p.whole * p.source_size) > 0
                       AND r.middle <= round(p.target - p.whole * p.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN per p ON s.source IS NOT DISTINCT FROM p.source
JOIN running r ON s.source IS NOT DISTINCT FROM r.source AND s.digest = r.digest
"""
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words that the mix takes."""
    return mixing.mix(documents(spark, sf_dir))


@query(
    r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parsed
LEFT JOIN LATERAL (
  SELECT * FROM rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule) DESC LIMIT 1) ON true
"""
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    return urlfilter.judge(pages, rules).select("page.page_id", "host", "path", "rule", "verdict")


@query(
    r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
windows AS (
  SELECT row_id, i, words[i:i + 7] AS w
  FROM (SELECT doc_id AS row_id, words, unnest(range(1, len(words) - 6)) AS i FROM parts)),
covered AS (
  SELECT row_id, count(DISTINCT place) AS n
  FROM (SELECT row_id, unnest(range(i, i + 8)) AS place
        FROM (SELECT *, count(*) OVER (PARTITION BY row_id, w) AS times FROM windows) WHERE times > 1)
  GROUP BY row_id),
line AS (
  SELECT doc_id AS row_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(lines) AS x FROM parts)),
judged AS (
  SELECT row_id, len(w) AS n,
         len(w) > 0 AND (
           length(x) - length(translate(x, '#*$%&|<>', '')) > 0.3 * len(w)
           OR len(regexp_extract_all(x, '[|»›•·]')) > 0.3 * len(w)
           OR len(regexp_extract_all(x, '[!?]{2,}')) > 0.3 * len(w)
           OR (len(w) >= 12 AND len(list_distinct(w)) < 0.25 * len(w))
           OR (len(w) <= 4 AND NOT regexp_matches(x, '[.!?:;…。！？"''”’»)\]]\s*$'))
           OR (len(w) <= 25 AND regexp_matches(x, '(?i)STOCK PHRASES'))
         ) AS fails
  FROM line),
kept AS (SELECT row_id, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM judged GROUP BY row_id),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(lines) AS l)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, k.kept_words::BIGINT AS kept_words
  FROM parts LEFT JOIN covered c ON c.row_id = doc_id LEFT JOIN kept k ON k.row_id = doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_words >= 0.5 * n_words AS kept
FROM counted
""".replace("STOCK PHRASES", "|".join(quality_rules.BOILERPLATE))
)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document and whether line-first cleaning keeps it."""
    return quality_rules.judged(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("doc.doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "kept_words",
        "base_failed",
        "kept",
    )


@query()
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.grouped(documents(spark, sf_dir))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query(
    r"""
WITH valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
)
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(rows, F.col("vec_id") % 100 == 0)


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return licenses.licenses(documents(spark, sf_dir))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a fifth of them, by id, is never learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    models = language.fit(docs, ~held_out)
    return language.identify(docs, models, ["doc_id"]).withColumn("held_out", held_out)


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of them, by id, is never learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    voters = quality_model.fit(docs, labels, ~held_out)
    return quality_model.score(docs, voters, ["doc_id"]).withColumn("held_out", held_out)


TOOLS = {
    "answer": {
        "type": "object",
        "required": ["question", "turn"],
        "properties": {
            "question": {"type": "string", "minLength": 20},
            "turn": {"type": "integer", "minimum": 0},
        },
        "additionalProperties": False,
    }
}


@query(
    r"""
WITH RECURSIVE m AS (
  SELECT *, coalesce(text, '') AS body,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
         CASE WHEN conv_id % 3 = 2 AND conv_id % 5 = 0 THEN conv_id || ':same'
              WHEN role = 'user' THEN conv_id || ':' || turn
              WHEN role = 'assistant' THEN conv_id || ':' || (turn + CASE WHEN conv_id % 3 = 1 THEN 1 ELSE -1 END) END AS id,
         CASE WHEN role = 'user' AND conv_id % 3 = 0
              THEN list_filter([conv_id || ':' || (turn + 2), CASE WHEN conv_id % 9 = 0 THEN conv_id || ':' || (turn - 2) END],
                               lambda x: x IS NOT NULL) END AS after,
         role = 'user' AND turn % 4 = 1 AS bad
  FROM conversations),
ends AS (
  SELECT conv_id, id, min(turn) FILTER (kind = 'call') AS called, min(turn) FILTER (kind = 'result') AS answered
  FROM m WHERE kind <> 'plain' GROUP BY ALL),
waits AS (
  SELECT m.conv_id, called AS before, turn FROM m JOIN ends USING (conv_id, id) WHERE kind = 'result' AND called <> turn
  UNION
  SELECT n.conv_id, coalesce(answered, called), turn
  FROM (SELECT conv_id, turn, unnest(after) AS id FROM m WHERE kind = 'call') n JOIN ends USING (conv_id, id)),
-- Every message with all that it waits for, and by chains of what length; a chain of 40 is a cycle.
chains AS (
  SELECT DISTINCT conv_id, turn, turn AS latest, 0 AS depth FROM m
  UNION
  SELECT w.conv_id, w.turn, c.latest, c.depth + 1
  FROM chains c JOIN waits w ON c.conv_id = w.conv_id AND c.turn = w.before WHERE c.depth < 40),
places AS (
  SELECT conv_id, turn, max(depth) >= 40 AS cyclic, max({'latest': latest, 'depth': depth}) AS place
  FROM chains GROUP BY conv_id, turn),
rows AS (
  SELECT conv_id, turn, role, kind, CASE WHEN kind <> 'plain' THEN id END AS call_id, false AS extra, body, bad, after FROM m
  UNION ALL
  SELECT conv_id, turn, role, kind, NULL, true, body, bad, after FROM m WHERE bad)
SELECT r.conv_id, r.turn, r.role, r.kind, r.call_id,
       coalesce(CASE r.kind WHEN 'call' THEN answered WHEN 'result' THEN called END, -1) AS linked_turn,
       CASE WHEN cyclic THEN 'cycle' WHEN kind = 'plain' THEN 'plain'
            WHEN kind = 'call' THEN CASE WHEN r.turn > called THEN 'repeated' WHEN answered IS NULL THEN 'unanswered' ELSE 'answered' END
            WHEN called IS NULL THEN 'orphan' WHEN r.turn > answered THEN 'repeated' ELSE 'linked' END AS status,
       CASE WHEN extra THEN 'not an object'
            WHEN kind = 'call' AND length(body) < 20 THEN '$.question: wrong length' ELSE '' END AS errors,
       CASE WHEN cyclic THEN r.turn ELSE place.latest END AS order_at,
       CASE WHEN cyclic THEN 0 ELSE place.depth END AS order_depth,
       CASE kind
         WHEN 'call' THEN '{"content":null,"role":"user","tool_calls":[{'
              || CASE WHEN after IS NULL THEN '' ELSE '"after":["' || array_to_string(after, '","') || '"],' END
              || '"arguments":{"question":' || to_json(body) || ',"turn":' || r.turn || '},"id":"'
              || CASE WHEN r.conv_id % 3 = 2 AND r.conv_id % 5 = 0 THEN r.conv_id || ':same' ELSE r.conv_id || ':' || r.turn END
              || '","name":"answer"}' || CASE WHEN bad THEN ',7' ELSE '' END || ']}'
         WHEN 'result' THEN '{"content":' || to_json(body) || ',"role":"assistant","tool_call_id":"' || r.call_id || '"}'
         ELSE '{"content":' || to_json(body) || ',"role":' || to_json(r.role) || '}' END AS json
FROM rows r
LEFT JOIN ends e ON r.conv_id = e.conv_id AND r.call_id = e.id
JOIN places p ON r.conv_id = p.conv_id AND r.turn = p.turn
"""
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogues as tool traffic, linked, ordered, validated and in canonical JSON.

    A user's message calls the tool ``answer``, and the assistant's next message
    is the result of that call; both are written as JSON texts first. In a third
    of the conversations a call waits for the next one, in some of these also for
    the one before; in another third the results come before their calls, and in
    some of the rest all calls have one id. Some calls have a broken entry beside.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn, body = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    named = lambda at: F.concat_ws(":", conv, at)
    same = (conv % 3 == 2) & (conv % 5 == 0)
    own = F.when(same, named(F.lit("same"))).otherwise(named(turn))
    step = F.when(conv % 3 == 1, 1).otherwise(-1)
    asked = F.when(same, named(F.lit("same"))).otherwise(named(turn + step))
    after = F.array_compact(F.array(named(turn + 2), F.when(conv % 9 == 0, named(turn - 2))))
    call = F.struct(
        own.alias("id"),
        F.lit("answer").alias("name"),
        F.struct(body.alias("question"), "turn").alias("arguments"),
        F.when(conv % 3 == 0, after).alias("after"),
    )
    bad = F.when(turn % 4 == 1, ",7]}").otherwise("]}")
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit('{"tool_calls":['), F.to_json(call), bad))
        .when(F.col("role") == "assistant", F.to_json(F.struct(asked.alias("tool_call_id"), body.alias("content"))))
        .otherwise(F.col("text"))
    )
    found = toolcalls.linked(table.select("conv_id", "turn", "role", text.alias("text")), TOOLS)
    return found.withColumn("linked_turn", F.coalesce("linked_turn", F.lit(-1)))


@query(
    r"""
WITH body AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM body GROUP BY t),
failing AS (
  SELECT b.doc_id, part,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(b.t, '[A-Z]')) > 10 * length(b.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(b.t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN b.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM body b JOIN firsts f ON b.t = f.t),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
weights AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM failing LEFT JOIN flags USING (doc_id) GROUP BY ALL),
letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (
  SELECT *, coalesce(list_min(list_filter(range(1, 6), lambda s: contains(fails, filter_order[s]))), 6) AS at_step
  FROM weights, orders),
grid AS (
  SELECT part, filter_order, s.step::INTEGER AS step, filter_order[s.step] AS f,
         coalesce(sum(n) FILTER (at_step > s.step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (at_step = s.step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (at_step < s.step AND contains(fails, filter_order[s.step])), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = filter_order[s.step]), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (at_step = s.step), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (at_step = s.step), 0)::BIGINT AS toxic_lost
  FROM gone, range(1, 6) s(step) GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM grid
"""
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every language, in all 120 orders, step by step."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and what they decode to, as digests."""
    return pieces.encoded(documents(spark, sf_dir), public_tokenizers.path(PIECES))


@query(
    r"""
WITH RECURSIVE source AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(flatten(list_transform(string_split(name, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[],
             lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                                 ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END,
             4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault
  FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) times(n)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM damaged),
rows AS (
  SELECT *, bare = '' AS blank,
         bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
         bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) = 1
           AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1]
           NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id),
-- From the end: cost, letters and rows of the best rest after nothing, a system, a user and an assistant.
steps(conv_id, place, v0, v1, v2, v3) AS (
  SELECT conv_id, n, {'c': 0, 'a': '', 'o': []::VARCHAR[]}, {'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']},
         {'c': 5, 'a': 'I', 'o': ['assistant:']}, {'c': 0, 'a': '', 'o': []::VARCHAR[]}
  FROM counts
  UNION ALL
  SELECT conv_id, place,
         least(r0, {'c': 5 + w2.c, 'a': 'I' || w2.a, 'o': list_prepend('user:', w2.o)}),
         least(r1, {'c': 5 + w2.c, 'a': 'I' || w2.a, 'o': list_prepend('user:', w2.o)}), w2, w3
  FROM (
    SELECT *, least(r2, {'c': 5 + r3.c, 'a': 'I' || r3.a, 'o': list_prepend('assistant:', r3.o)}) AS w2,
           least(r3, {'c': 5 + r2.c, 'a': 'I' || r2.a, 'o': list_prepend('user:', r2.o)}) AS w3
    FROM (
      SELECT r.conv_id, r.place - 1 AS place,
             least({'c': 2 + v0.c, 'a': 'D' || v0.a, 'o': v0.o},
                   CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)} END,
                   CASE WHEN stays AND i = 's' THEN {'c': late + v1.c, 'a': 'K' || v1.a, 'o': list_prepend(own, v1.o)}
                        WHEN stays AND i = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a, 'o': list_prepend(own, v2.o)}
                        WHEN stays AND i = '' THEN {'c': late + v0.c, 'a': 'K' || v0.a, 'o': list_prepend(own, v0.o)} END) AS r0,
             least({'c': 2 + v1.c, 'a': 'D' || v1.a, 'o': v1.o},
                   CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)} END,
                   CASE WHEN stays AND i = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a, 'o': list_prepend(own, v2.o)}
                        WHEN stays AND i = '' THEN {'c': late + v1.c, 'a': 'K' || v1.a, 'o': list_prepend(own, v1.o)} END) AS r1,
             least({'c': 2 + v2.c, 'a': 'D' || v2.a, 'o': v2.o},
                   CASE WHEN stays THEN {'c': late + 1 + v3.c, 'a': 'R' || v3.a, 'o': list_prepend('assistant:' || text, v3.o)} END,
                   CASE WHEN stays AND i = 'a' THEN {'c': late + v3.c, 'a': 'K' || v3.a, 'o': list_prepend(own, v3.o)}
                        WHEN stays AND i = '' THEN {'c': late + v2.c, 'a': 'K' || v2.a, 'o': list_prepend(own, v2.o)} END) AS r2,
             least({'c': 2 + v3.c, 'a': 'D' || v3.a, 'o': v3.o},
                   CASE WHEN stays THEN {'c': late + 1 + v2.c, 'a': 'R' || v2.a, 'o': list_prepend('user:' || text, v2.o)} END,
                   CASE WHEN stays AND i = 'u' THEN {'c': late + v2.c, 'a': 'K' || v2.a, 'o': list_prepend(own, v2.o)}
                        WHEN stays AND i = '' THEN {'c': late + v3.c, 'a': 'K' || v3.a, 'o': list_prepend(own, v3.o)} END) AS r3
      FROM (SELECT *, NOT blank AND NOT duplicate AS stays, CASE WHEN truncated THEN 5 ELSE 0 END AS late,
                   role[1] AS i, role || ':' || text AS own FROM rows) r
      JOIN steps s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.place = r.place)))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
       sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts k ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.place = 0
"""
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.reports(repair.damaged(table))

"""The registered query of every operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.llm import (
    bpe,
    conversation_repair,
    graph_ann,
    mixing,
    quality_model,
    quality_rules,
    secret_scan,
    simhash,
    suffix_dedup,
    tool_calls,
    toxicity,
    url_filter,
    vector_codes,
)
from salesengine.llm.common import stored, table
from salesengine.llm.tool_calls import Parameter
from salesengine.llm.url_filter import Rule

URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# The domains whose pages are listed as a whole.
BLOCKED_DOMAINS = (
    "ads-track.example.com",
    "adult-x.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)


def listed_keys(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts under a blocked domain, and addresses of pages whose document is labelled as bad.

    The number in a page's path is the id of its document.
    """
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    under = F.lit(False)
    for domain in BLOCKED_DOMAINS:
        under = under | (host == domain) | host.endswith(f".{domain}")
    bad = labels.where("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("bad")).distinct()
    number = F.try_to_number(F.regexp_extract(path, "/([0-9]{1,18})", 1), F.lit("9" * 18))
    addresses = (
        pages.select(F.concat(host, path).alias("key"), number.cast("long").alias("doc"))
        .join(bad, F.col("doc") == F.col("bad"), "left_semi")
        .select("key")
    )
    return pages.select(host.alias("key")).where(under).select("key").distinct().union(addresses)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = listed_keys(pages, table(spark, sf_dir, "labels"))
    judged = url_filter.judge(pages, URL_RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


_DOMAINS = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS)
_RULES = "\n".join(
    f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    f" THEN '{r.text} {r.verdict}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.text))
)
OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), keys AS (
  SELECT host AS key FROM parts WHERE {_DOMAINS}
  UNION
  SELECT host || path FROM parts
  WHERE TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT)
    IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
), judged AS (
  SELECT page_id, host, path,
    host <> '' AND (host IN (SELECT key FROM keys) OR host || path IN (SELECT key FROM keys)) AS listed,
    CASE
{_RULES}
    END AS best
  FROM parts
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  coalesce(split_part(best, ' ', 2), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame, carry: str | None = None) -> DataFrame:
    encoded = bpe.encode(docs, tokenizer_path(), carry=carry, decoded_col="decoded")
    return encoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([] if carry is None else [carry]),
    )


CALL_SCHEMAS = {
    "reply": {
        "n_words": Parameter("integer", minimum=1, maximum=40),
        "prompt": Parameter("string"),
        "style": Parameter("string", required=False, allowed=("short", "long")),
    }
}


def conversation_events(turns: DataFrame) -> DataFrame:
    """Turns as events: a user's is a call to reply, the assistant's next to it the result.

    A call follows the answer before it. Other roles are messages.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"

    def number(back: int) -> Column:
        return F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))

    words = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(F.when(F.col("text").isNotNull(), words).alias("n_words"), F.col("text").alias("prompt")))
    return turns.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, number(0)).when(assistant, number(1)).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, number(2)).alias("follows"),
        F.when(~user | user.isNull(), F.col("text")).alias("content"),
    )


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(conversation_events(table(spark, sf_dir, "conversations")), CALL_SCHEMAS)


OP6_SQL = """
WITH RECURSIVE events AS (
  SELECT conv_id, turn, text, role,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call
  FROM conversations
), nodes AS (
  SELECT DISTINCT conv_id, kind, call FROM events WHERE call IS NOT NULL
), parents AS (
  SELECT n.conv_id, n.kind, n.call, p.kind AS p_kind, p.call AS p_call
  FROM nodes n LEFT JOIN nodes p ON p.conv_id = n.conv_id
    AND p.kind <> n.kind AND p.call = CASE n.kind WHEN 'call' THEN n.call - 2 ELSE n.call END
), placed AS (
  SELECT conv_id, kind, call, 0 AS level FROM parents WHERE p_kind IS NULL
  UNION ALL
  SELECT c.conv_id, c.kind, c.call, p.level + 1 FROM parents c JOIN placed p
    ON c.conv_id = p.conv_id AND c.p_kind = p.kind AND c.p_call = p.call
), counted AS (
  SELECT *, len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')) AS n_words FROM events
)
SELECT e.conv_id, e.turn, e.kind, 'c' || e.call AS call_id, o.call IS NOT NULL AS linked,
  CASE WHEN e.kind = 'call' THEN coalesce(n_words BETWEEN 1 AND 40, FALSE) END AS valid,
  CASE WHEN e.call IS NULL THEN 0 ELSE p.level END AS level,
  CASE e.kind
    WHEN 'call' THEN json_object('role', e.role, 'tool_call',
      json_object('arguments', json_object('n_words', n_words, 'prompt', e.text), 'id', 'c' || e.call, 'name', 'reply'))
    WHEN 'result' THEN json_object('content', e.text, 'id', 'c' || e.call, 'role', 'tool')
    ELSE json_object('content', e.text, 'role', e.role)
  END::VARCHAR AS json
FROM counted e
LEFT JOIN nodes o ON o.conv_id = e.conv_id AND o.call = e.call AND o.kind <> e.kind
LEFT JOIN placed p ON p.conv_id = e.conv_id AND p.call = e.call AND p.kind = e.kind
"""


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, *quality_model.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a null id count as held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


MIX_WEIGHTS = {"src0": 8, "src1": 4, "src2": 2}
MIX_BLOCK = 8


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS, other=1, block=MIX_BLOCK)


_WEIGHT = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in MIX_WEIGHTS.items())
OP9_SQL = f"""
WITH RECURSIVE sources AS (
  SELECT source, CASE source {_WEIGHT} ELSE 1 END AS weight, row_number() OVER (ORDER BY source NULLS FIRST) AS i
  FROM (SELECT DISTINCT source FROM documents)
), given AS (
  SELECT list(weight ORDER BY i) AS w, sum(weight)::BIGINT AS slots, count(*) AS n FROM sources
), period AS (
  SELECT -1::BIGINT AS slot, NULL::BIGINT AS i, NULL::BIGINT AS turn, list_transform(w, lambda x: 0::BIGINT) AS done FROM given
  UNION ALL
  SELECT slot, i, done[i], list_transform(range(1, n + 1), lambda j: done[j] + (j = i)::BIGINT)
  FROM (
    SELECT slot + 1 AS slot, done, n, list_min(list_filter(list_transform(range(1, n + 1),
      lambda j: CASE WHEN done[j] * slots // w[j] <= slot + 1
           THEN {{'deadline': ((done[j] + 1) * slots + w[j] - 1) // w[j], 'i': j}} END), lambda b: b IS NOT NULL)).i AS i
    FROM period, given WHERE slot + 1 < slots
  )
), numbered AS (
  SELECT doc_id, source,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS nr
  FROM documents
)
SELECT doc_id, d.source, nr // {MIX_BLOCK} // weight * slots + slot AS slot,
  (nr // {MIX_BLOCK} // weight * slots + slot) * {MIX_BLOCK} + nr % {MIX_BLOCK} AS position
FROM numbered d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
JOIN period p ON p.i = s.i AND p.turn = nr // {MIX_BLOCK} % weight, given
"""


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults: one turn in twenty each is dropped, emptied, left open, repeated or given to the user."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    times = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    judged, repaired = conversation_repair.repair(damaged(turns))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    hashes = conversation_repair.digests(repaired).withColumnRenamed("conv_id", "hashed")
    found = ids.join(judged, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(
        hashes, F.col("id").eqNullSafe(F.col("hashed")), "left"
    )
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*conversation_repair.FAULTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", none).alias("repaired_sha256"),
    )


def _turned(state: str, cost: str, edit: str, role: str, when: str) -> str:
    return (
        f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
        f"'o': {state}.o || chr(10) || {role} || ':' || text}} END"
    )


def _left(state: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'D', 'o': {state}.o}} END"


def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _asked(role: str, *states: str) -> list[str]:
    kept = [_turned(s, "open", "K", "role", f"NOT gone AND initial = '{role[0]}'") for s in states]
    return kept + [_turned(s, "open + 1", "R", f"'{role}'", "NOT gone") for s in states]


# An insertion (5) never pays: the turn that it would complete can be deleted (2). So audits of
# the same turns are equally long, and the least prefix of each state is all that is needed.
OP11_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: ascii(c)::BIGINT) AS key
  FROM conversations
), kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, key), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
  FROM given
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds
), placed AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
    NOT regexp_matches(text, '[^ \\t-\\r]') AS blank,
    NOT regexp_matches(text, '[.!?][ \\t-\\r]*\\z') AS unended
  FROM damaged
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, blank OR again AS gone,
    CASE WHEN unended AND NOT gone THEN 5 ELSE 0 END AS open,
    lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair
  FROM placed
), walk AS (
  SELECT DISTINCT conv, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0,
    NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s2,
    NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s3
  FROM given
  UNION ALL
  SELECT w.conv, j.pos,
    {_left("s0")},
    {_best(_left("s1"), _turned("s0", "open", "K", "role", "NOT gone AND initial = 's'"))},
    {_best(_left("s2"), *_asked("user", "s0", "s1", "s3"))},
    {_best(_left("s3"), *_asked("assistant", "s2"))}
  FROM walk w JOIN judged j ON j.conv = w.conv AND j.pos = w.pos + 1
), ended AS (
  SELECT conv, list_min(list_filter([s0, s3], lambda w: w IS NOT NULL)) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1
), faults AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open > 0) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(substr(best.o, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) JOIN ended USING (conv) LEFT JOIN faults USING (conv)
"""


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    sizes = F.transform("spans", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = stored(coded)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"),
    )


def _vector_codes_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""placed{i} AS MATERIALIZED (
  SELECT id, p.part, min({{'far': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
    'entry': b.entry}}) AS near
  FROM parts p JOIN book{i} b ON b.part = p.part GROUP BY id, p.part
)"""
        )
        if i < rounds:
            steps.append(
                f"""sums{i} AS (
  SELECT part, near.entry AS entry, place, sum(v[place])::BIGINT AS s, count(*) AS n
  FROM parts JOIN placed{i} USING (id, part), sized, range(1, width + 1) t(place) GROUP BY ALL
), means{i} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{i} GROUP BY ALL
), book{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN means{i} m USING (part, entry)
)"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS id,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS cells
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sized AS (
  SELECT max(len(cells)) // 4 AS width FROM kept
), parts AS MATERIALIZED (
  SELECT id, vec_id, part, cells[part * width + 1 : (part + 1) * width] AS v FROM kept, sized, range(4) t(part)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  QUALIFY entry < 256
), {", ".join(steps)},
coded AS (
  SELECT id, string_agg(lower(printf('%02x', near.entry)), '' ORDER BY part) AS code, sum(near.far)::BIGINT AS error
  FROM placed{rounds} GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""


OP13_SQL = _vector_codes_sql(vector_codes.Settings().rounds)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_bpe": op5_bpe,
    "op6_tool_calls": op6_tool_calls,
    "op7_quality_model": op7_quality_model,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_nearest": op10_nearest,
    "op11_repair": op11_repair,
    "op12_repeats": op12_repeats,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op6_tool_calls": OP6_SQL, "op9_mixing": OP9_SQL, "op11_repair": OP11_SQL, "op13_vector_codes": OP13_SQL}

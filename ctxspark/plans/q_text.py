"""Queries on tokens, regions, sequences and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.functions.tokenizer import STAND_IN
from ctxspark.operators import rows as R
from ctxspark.operators import sequences as Q
from ctxspark.plans.registry import Tables, query
from ctxspark.plans.stage import spread

# Pieces of the DuckDB counterparts.
TOK = "'" + C.TOKEN_PATTERN + "'"
WORD = "'" + C.WORD_PATTERN + "'"
REGION = "'" + C.REGION_PATTERN + "'"


MARKERS = "WHEN '<|memory_start|>' THEN 50257 WHEN '<|memory|>' THEN 50258 WHEN '<|memory_end|>' THEN 50259 WHEN '<|im_start|>' THEN 50260 WHEN '<|im_end|>' THEN 50261"


def hashed(t: str) -> str:
    return f"(('0x' || substr(md5({t}), 1, 7))::BIGINT % 50256 + 1)"


def ids(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {TOK}), lambda t: CASE t {MARKERS} ELSE {hashed('t')} END)"


def embed_ids(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {WORD}), lambda t: {hashed('t')})"


def joined(x: str) -> str:
    """A list of numbers as one digest."""
    return f"md5(array_to_string({x}, ','))"


def ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {TOK}))::BIGINT"


def nemb(x: str) -> str:
    return f"len(regexp_extract_all({x}, {WORD}))::BIGINT"


def bodies(x: str) -> str:
    return f"regexp_extract_all({x}, {REGION}, 1)"


def parts(x: str) -> str:
    return f"regexp_split_to_array({x}, {REGION})"


def total(x: str) -> str:
    return f"coalesce(list_sum({x}), 0)::BIGINT"


RENDER = "concat(coalesce(array_to_string(list_transform(prompt, lambda m: concat('<|im_start|>', coalesce(m.role, ''), chr(10), coalesce(m.content, ''), '<|im_end|>', chr(10))), ''), ''), '<|im_start|>assistant', chr(10))"
TARGET = "concat(coalesce(target, ''), '<|im_end|>', chr(10))"
RAW = "raw AS (SELECT row_id, any_value(prompt) AS prompt, any_value(target) AS target FROM raw_rows GROUP BY row_id)"
CONT = "coalesce(prompt[1].content, '')"


def lat(n: str) -> str:
    return f"greatest(1, (({n}) + 15) // 16)::BIGINT"


def ks(text: str) -> str:
    return f"list_transform({bodies(text)}, lambda b: {lat(nemb('b'))})"


def part_sum(text: str) -> str:
    return total(f"list_transform({parts(text)}, lambda p: {ntok('p')})")


def raw(t: Tables) -> DataFrame:
    """Raw rows as delivered. What is computed of each row is made distinct afterwards, so deliveries cost no shuffle of texts."""
    return spread(t.raw_rows.select("row_id", "prompt", "target"))


def docs(t: Tables) -> DataFrame:
    """Documents with a text."""
    return spread(t.documents.where("text is not null").select("doc_id", "text", "source"))


@query(f"SELECT doc_id, {ntok('text')} AS n_tok, {nemb('text')} AS n_embed FROM documents WHERE text IS NOT NULL")
def tokenize(t: Tables) -> DataFrame:
    return docs(t).select("doc_id", T.n_tokens("text").alias("n_tok"), T.n_embed_tokens("text").alias("n_embed"))


@query(f"""SELECT doc_id, i - 1 AS region_idx, md5(b[i]) AS body_md5, length(b[i])::BIGINT AS n_chars
FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, {bodies('text')} AS b FROM documents WHERE text IS NOT NULL))""")
def extract_regions(t: Tables) -> DataFrame:
    e = docs(t).select("doc_id", F.posexplode(T.regions("text")).alias("region_idx", "b"))
    return e.select("doc_id", F.col("region_idx").cast("bigint").alias("region_idx"), F.md5("b").alias("body_md5"), F.length("b").cast("bigint").alias("n_chars"))


@query(f"""SELECT doc_id, i - 1 AS region_idx, n[i] AS n_tok, {lat('n[i]')} AS n_latent, ((n[i] + 15) // 16)::BIGINT AS n_latent_zero
FROM (SELECT doc_id, n, unnest(range(1, len(n) + 1)) AS i FROM (SELECT doc_id, list_transform({bodies('text')}, lambda b: {nemb('b')}) AS n FROM documents WHERE text IS NOT NULL))""")
def latent_count(t: Tables) -> DataFrame:
    e = docs(t).select("doc_id", F.posexplode(F.transform(T.regions("text"), T.n_embed_tokens)).alias("region_idx", "n_tok"))
    return e.select("doc_id", F.col("region_idx").cast("bigint").alias("region_idx"), "n_tok", T.latent_count(F.col("n_tok")).alias("n_latent"), T.latent_count(F.col("n_tok"), min_one=False).alias("n_latent_zero"))


@query(f"""SELECT doc_id, md5(x) AS expanded_md5, {ntok('x')} AS seq_len FROM (
SELECT doc_id, concat(p[1], array_to_string(list_transform(range(1, len(k) + 1), lambda i: concat('<|memory_start|>', repeat('<|memory|>', k[i]), '<|memory_end|>', p[i + 1])), '')) AS x
FROM (SELECT doc_id, {parts('text')} AS p, {ks('text')} AS k FROM documents WHERE text IS NOT NULL))""")
def expand_placeholders(t: Tables) -> DataFrame:
    return docs(t).select("doc_id", T.expand_placeholders("text").alias("x")).select("doc_id", F.md5("x").alias("expanded_md5"), T.n_tokens("x").alias("seq_len"))


SPANS = f"""SELECT doc_id, i - 1 AS region_idx, (list_sum(o[1:i]) + coalesce(list_sum(k[1:i-1]), 0) + 2 * (i - 1) + 1)::BIGINT AS start_pos,
(list_sum(o[1:i]) + list_sum(k[1:i]) + 2 * (i - 1) + 1)::BIGINT AS end_pos FROM (SELECT doc_id, o, k, unnest(range(1, len(k) + 1)) AS i FROM (
SELECT doc_id, list_transform({parts('text')}, lambda p: {ntok('p')}) AS o, {ks('text')} AS k FROM documents WHERE text IS NOT NULL))"""


@query(SPANS)
def find_positions_wrapped(t: Tables) -> DataFrame:
    """Found in the ids of the expanded text and checked there: an end marker or a placeholder that is missing raises an error."""
    d = Q.cut_regions(docs(t), "text", C.RATIO, STAND_IN).select("doc_id", Q.woven_ids().alias("ids"), "latent_counts")
    e = d.select("doc_id", F.posexplode(Q.find_regions(F.col("ids"), F.col("latent_counts"))).alias("region_idx", "s"))
    return e.select("doc_id", F.col("region_idx").cast("bigint").alias("region_idx"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


@query(f"""SELECT doc_id, md5(array_to_string(regexp_extract_all(text, {TOK}), ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL""")
def token_strings(t: Tables) -> DataFrame:
    return docs(t).select("doc_id", F.md5(F.array_join(T.tokens("text"), " ")).alias("tokens_md5"))


@query(f"WITH {RAW} SELECT row_id, md5({RENDER}) AS prompt_md5, md5({TARGET}) AS target_md5, {ntok(RENDER)} AS prompt_tok, {ntok(TARGET)} AS target_tok FROM raw WHERE target IS NULL OR target <> 'NA_string_only'")
def chat_prompt_target(t: Tables) -> DataFrame:
    p = Q.chat_texts(raw(t))
    return p.select("row_id", F.md5("prompt_text").alias("prompt_md5"), F.md5("target_text").alias("target_md5"), T.n_tokens("prompt_text").alias("prompt_tok"), T.n_tokens("target_text").alias("target_tok")).distinct()


@query(f"WITH {RAW} SELECT row_id, md5({RENDER}) AS rendered_md5, len(prompt)::BIGINT AS n_turns FROM raw")
def render_chat(t: Tables) -> DataFrame:
    return raw(t).select("row_id", F.md5(T.render_chat("prompt")).alias("rendered_md5"), F.when(F.col("prompt").isNotNull(), F.size("prompt").cast("bigint")).alias("n_turns")).distinct()


def many(n: str, x: str) -> str:
    return f"list_transform(range({n}), lambda j: {x}::BIGINT)"


def woven(text: str, source: str, name: str) -> str:
    """A CTE with the ids, labels, spans, counts and encoder ids of the column ``text`` of ``source``; regions are ignored in the labels."""
    return f"""{name}0 AS MATERIALIZED (SELECT *, list_transform({parts(text)}, lambda p: {ids('p')}) AS pid, list_transform({bodies(text)}, lambda b: {embed_ids('b')}) AS mids FROM {source}),
{name}1 AS MATERIALIZED (SELECT *, list_transform(mids, lambda m: {lat('len(m)')}) AS k FROM {name}0),
{name} AS MATERIALIZED (SELECT *, flatten(list_transform(pid, lambda p, i: CASE WHEN i > len(k) THEN p ELSE list_concat(p, [50257::BIGINT], {many('k[i]', '50258')}, [50259::BIGINT]) END)) AS w_ids,
flatten(list_transform(pid, lambda p, i: CASE WHEN i > len(k) THEN p ELSE list_concat(p, {many('k[i] + 2', '-100')}) END)) AS w_labels,
array_to_string(list_transform(k, lambda c, i: (list_sum(list_transform(pid[1:i], lambda p: len(p))) + coalesce(list_sum(k[1:i-1]), 0) + 2 * i - 1)::BIGINT || '-' || (list_sum(list_transform(pid[1:i], lambda p: len(p))) + list_sum(k[1:i]) + 2 * i - 1)::BIGINT), ',') AS spans FROM {name}1)"""


CHAT = f"chat AS (SELECT row_id, {RENDER} AS pt, {ids(TARGET)} AS tid FROM raw WHERE target IS NULL OR target <> 'NA_string_only'), {woven('pt', 'chat', 'cw')}"
CONTINUED = f"cont AS (SELECT row_id, {CONT} AS ct FROM raw WHERE target = 'NA_string_only'), {woven('ct', 'cont', 'tw')}"
SEQ_TAIL = f"spans, array_to_string(k, ',') AS counts, {joined('flatten(mids)')} AS memory_md5"
SFT = f"SELECT row_id, {joined('list_concat(w_ids, tid)')} AS ids_md5, {joined('list_concat(' + many('len(w_ids)', '-100') + ', tid)')} AS labels_md5, len(w_ids) + len(tid) AS seq_len, {SEQ_TAIL} FROM cw"
CONTINUAL = f"SELECT row_id, {joined('w_ids')} AS ids_md5, {joined('w_labels')} AS labels_md5, len(w_ids) AS seq_len, {SEQ_TAIL} FROM tw"


def digest(values) -> Column:
    """An array of numbers as one digest."""
    return F.md5(F.array_join(F.transform(values, lambda x: x.cast("string")), ","))


def span_list(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def described(sequences: DataFrame, *keys: str) -> DataFrame:
    """Sequences with their arrays as digests, so that results stay small whatever their length."""
    return sequences.select(
        *keys, digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"), F.size("input_ids").cast("bigint").alias("seq_len"),
        span_list("spans").alias("spans"), F.array_join(F.transform("latent_counts", lambda k: k.cast("string")), ",").alias("counts"), digest(F.flatten("memory_ids")).alias("memory_md5"),
    )


@query(f"WITH {RAW}, {CHAT} {SFT}")
def sft_sequence(t: Tables) -> DataFrame:
    return described(Q.sft(raw(t)), "row_id").distinct()


@query(f"WITH {RAW}, {CONTINUED} {CONTINUAL}")
def continual_sequence(t: Tables) -> DataFrame:
    return described(Q.continual(raw(t)), "row_id").distinct()


@query(f"WITH {RAW}, t AS (SELECT row_id, {ids(RENDER)} AS p, {ids(TARGET)} AS t FROM raw WHERE target IS NULL OR target <> 'NA_string_only') SELECT row_id, {joined('list_concat(p, t)')} AS ids_md5, {joined('list_concat(' + many('len(p)', '-100') + ', t)')} AS labels_md5, len(p) + len(t) AS seq_len FROM t")
def teacher_sequence(t: Tables) -> DataFrame:
    return Q.teacher(raw(t)).select("row_id", digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"), F.size("input_ids").cast("bigint").alias("seq_len")).distinct()


LENGTHS = f"""{RAW}, pre AS (SELECT row_id, 'chat' AS format, ({part_sum(RENDER)} + {total(ks(RENDER))} + 2 * len({bodies(RENDER)}))::BIGINT AS n_masked, {ntok(TARGET)} AS n_trainable FROM raw WHERE target IS NULL OR target <> 'NA_string_only'
UNION ALL SELECT row_id, 'continual_pretraining', ({total(ks(CONT))} + 2 * len({bodies(CONT)}))::BIGINT, {part_sum(CONT)} FROM raw WHERE target = 'NA_string_only')"""


@query(f"WITH {RAW}, {CHAT}, {CONTINUED} SELECT *, 'chat' AS format FROM ({SFT}) UNION ALL SELECT *, 'continual_pretraining' FROM ({CONTINUAL})")
def preprocess_example(t: Tables) -> DataFrame:
    return described(Q.preprocess(raw(t)), "row_id", "format").distinct()


@query(f"WITH {LENGTHS} SELECT row_id, format, n_masked, n_trainable, n_masked + n_trainable AS seq_len FROM pre")
def sequence_lengths(t: Tables) -> DataFrame:
    """Lengths alone, as packing needs them, without making ids."""
    return R.lengths(raw(t)).distinct()


@query(f"""WITH {LENGTHS} SELECT format, count(*) AS n, sum(n_masked + n_trainable)::BIGINT AS total_len FROM pre GROUP BY format""")
def union_formats(t: Tables) -> DataFrame:
    return R.lengths(raw(t)).distinct().groupBy("format").agg(F.count("*").alias("n"), F.sum("seq_len").alias("total_len"))


BODY_SUM = total(f"list_transform({bodies(CONT)}, lambda b: {ntok('b')})")


@query(f"""WITH {RAW}, s AS (SELECT row_id, CASE WHEN target = 'NA_string_only' THEN 'continual_pretraining' ELSE 'chat' END AS format,
CASE WHEN target = 'NA_string_only' THEN {part_sum(CONT)} ELSE {ntok(TARGET)} END AS trainable,
CASE WHEN target = 'NA_string_only' THEN {BODY_SUM} ELSE {ntok(RENDER)} END AS non_trainable FROM raw) SELECT *, trainable + non_trainable AS total FROM s""")
def stats_pre(t: Tables) -> DataFrame:
    return R.stats_pre(raw(t)).distinct()


@query("SELECT example_id, len(list_filter(any_value(base_labels), lambda x: x <> -100))::BIGINT AS trainable, len(list_filter(any_value(base_labels), lambda x: x = -100))::BIGINT AS non_trainable FROM base_examples GROUP BY example_id")
def stats_post(t: Tables) -> DataFrame:
    e = t.base_examples
    n = lambda c: F.when(F.col("base_labels").isNotNull(), F.size(F.filter("base_labels", c)).cast("bigint"))
    return e.select("example_id", n(lambda x: x != C.IGNORE).alias("trainable"), n(lambda x: x == C.IGNORE).alias("non_trainable")).distinct()


@query(f"""WITH s AS (SELECT source, {part_sum('text')} AS r, {total(ks('text'))} AS k, {total('list_transform(' + bodies('text') + ', lambda b: ' + nemb('b') + ')')} AS e, 2 * len({bodies('text')}) AS m FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, count(*) AS n_docs, sum(r + k + m)::BIGINT AS compressed, sum(r + e + m)::BIGINT AS equivalent FROM s GROUP BY source)
SELECT *, CASE WHEN equivalent = 0 THEN 0.0::DOUBLE ELSE round((1 - compressed::DOUBLE / equivalent) * 100, 1)::DOUBLE END AS savings_pct FROM g""")
def compression_stats(t: Tables) -> DataFrame:
    return R.compression_stats(docs(t), "source")


@query(f"WITH {RAW} SELECT CASE WHEN target = 'NA_string_only' THEN 'continual_pretraining' ELSE 'chat' END AS format, count(*) AS n FROM raw GROUP BY 1")
def format_detect(t: Tables) -> DataFrame:
    return t.raw_rows.select("row_id", T.row_format("target").alias("format")).distinct().groupBy("format").agg(F.count("*").alias("n"))


@query(f"WITH {RAW} SELECT row_id, md5({CONT}) AS text_md5 FROM raw WHERE target = 'NA_string_only'")
def continual_text(t: Tables) -> DataFrame:
    return raw(t).where(F.col("target") == C.CONTINUAL_TARGET).select("row_id", F.md5(T.continual_text("prompt")).alias("text_md5")).distinct()


@query(f"""WITH {RAW} SELECT row_id, prompt IS NULL AS no_prompt, target IS NULL AS no_target, coalesce(len(list_filter(prompt, lambda m: m.role IS NULL OR m.content IS NULL)), 0)::BIGINT AS n_null_parts
FROM raw WHERE prompt IS NULL OR target IS NULL OR len(list_filter(prompt, lambda m: m.role IS NULL OR m.content IS NULL)) > 0""")
def typecheck(t: Tables) -> DataFrame:
    bad = F.coalesce(F.size(F.filter("prompt", lambda m: m["role"].isNull() | m["content"].isNull())), F.lit(0)).cast("bigint")
    bad = F.when(F.col("prompt").isNull(), F.lit(0).cast("bigint")).otherwise(bad)
    rows = raw(t).select("row_id", F.col("prompt").isNull().alias("no_prompt"), F.col("target").isNull().alias("no_target"), bad.alias("n_null_parts"))
    return rows.where("no_prompt or no_target or n_null_parts > 0").distinct()


@query(f"WITH sp AS ({SPANS}), n AS (SELECT doc_id, (sum(end_pos - start_pos) + 2 * count(*))::BIGINT AS n_in FROM sp GROUP BY doc_id), x AS (SELECT doc_id, {part_sum('text')} AS n_out FROM documents WHERE text IS NOT NULL) SELECT x.doc_id, coalesce(n_in, 0) AS n_in, n_out FROM x LEFT JOIN n USING (doc_id)")
def join_range_label(t: Tables) -> DataFrame:
    """Tokens of the expanded text that lie in a region with its markers, and those outside: what spans cover, by lengths alone."""
    zero = F.lit(0).cast("bigint")
    n_in = F.aggregate(T.region_spans("text"), zero, lambda a, s: a + s["end"] - s["start"] + 2)
    n_out = F.aggregate(F.transform(T.outside_parts("text"), T.n_tokens), zero, lambda a, x: a + x)
    return docs(t).select("doc_id", n_in.alias("n_in"), n_out.alias("n_out"))


FLAT = f"(SELECT doc_id, unnest({bodies('text')}) AS b, generate_subscripts({bodies('text')}, 1) AS i FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, count(*) AS n_regions, md5(string_agg(e, '|' ORDER BY i)) AS regions_md5 FROM (SELECT doc_id, i, array_to_string({embed_ids('b')}, ',') AS e FROM {FLAT}) GROUP BY doc_id")
def flatten_regions_batch(t: Tables) -> DataFrame:
    """Regions of all texts as one batch for the encoder, each with its owner; what the encoder gives (here its ids) goes back to the owner in order."""
    flat = docs(t).select("doc_id", F.posexplode(T.regions("text")).alias("at", "body"))
    encoded = flat.select("doc_id", "at", F.array_join(F.transform(STAND_IN.embed_ids(F.col("body")), lambda x: x.cast("string")), ",").alias("e"))
    back = encoded.groupBy("doc_id").agg(F.count("*").alias("n_regions"), F.array_sort(F.collect_list(F.struct("at", "e"))).alias("r"))
    return back.select("doc_id", "n_regions", F.md5(F.array_join(F.transform("r", lambda x: x["e"]), "|")).alias("regions_md5"))

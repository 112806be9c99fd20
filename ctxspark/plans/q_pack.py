"""Queries on packing, masks, base examples, windows and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.functions.tokenizer import STAND_IN
from ctxspark.operators import examples as E
from ctxspark.operators import packing as P
from ctxspark.operators import sequences as Q
from ctxspark.operators import windows as W
from ctxspark.plans.q_scan import PLAN, plan
from ctxspark.plans.q_text import CHAT, CONTINUED, RAW, digest, docs, embed_ids, joined, lat, many, nemb, ntok, raw, span_list
from ctxspark.plans.registry import Tables, query
from ctxspark.plans.stage import spread, written

NEXT_FIT = f"""i AS MATERIALIZED (SELECT source AS shard, md5('42-' || doc_id) AS ord, doc_id AS id, {ntok('text')} AS n FROM documents WHERE text IS NOT NULL),
o AS MATERIALIZED (SELECT shard, id, n, row_number() OVER (PARTITION BY shard ORDER BY ord, id) AS rn FROM i WHERE n <= 4096),
p AS (SELECT shard, id, n, rn, 0::BIGINT AS pack_id, 0::BIGINT AS pack_offset FROM o WHERE rn = 1
UNION ALL SELECT o.shard, o.id, o.n, o.rn, CASE WHEN pack_offset + p.n + o.n > 4096 THEN pack_id + 1 ELSE pack_id END, CASE WHEN pack_offset + p.n + o.n > 4096 THEN 0 ELSE pack_offset + p.n END
FROM p JOIN o ON o.rn = p.rn + 1 AND o.shard IS NOT DISTINCT FROM p.shard)"""
PACKED = f"WITH RECURSIVE {NEXT_FIT}"


def items(t: Tables) -> DataFrame:
    return docs(t).select(F.col("source").alias("shard"), F.md5(F.concat_ws("-", F.lit(str(C.SEED)), F.col("doc_id").cast("string"))).alias("ord"), F.col("doc_id").alias("id"), T.n_tokens("text").alias("n"))


def packed(t: Tables) -> DataFrame:
    return P.pack_next_fit(items(t))


@query(f"{PACKED} SELECT shard, id, n, pack_id, pack_offset FROM p")
def pack_next_fit(t: Tables) -> DataFrame:
    return packed(t)


@query(f"""{PACKED}, k AS (SELECT shard, pack_id, count(*) AS c, sum(n)::BIGINT AS length FROM p GROUP BY ALL),
f AS (SELECT shard, count(*) AS n_packs, sum(c)::BIGINT AS n_packed, min(length) AS min_tokens, max(length) AS max_tokens, round(avg(length * 100.0::DOUBLE / 4096), 4) AS fill_pct FROM k GROUP BY shard),
s AS (SELECT shard, (count(*) FILTER (n > 4096))::BIGINT AS n_skipped FROM i GROUP BY shard)
SELECT s.shard, n_packs, n_packed, n_skipped, min_tokens, max_tokens, fill_pct FROM s LEFT JOIN f ON s.shard IS NOT DISTINCT FROM f.shard""")
def pack_report(t: Tables) -> DataFrame:
    i = written(items(t), "pack-sizes")  # sizes are used by the packing and by the report
    return P.pack_report(i, P.pack_next_fit(i))


@query(f"{PACKED} SELECT shard, pack_id, count(*) AS n_items, sum(n)::BIGINT AS length, string_agg(n, ',' ORDER BY pack_offset, id) AS sample_lens FROM p GROUP BY ALL")
def pack_lengths(t: Tables) -> DataFrame:
    return P.pack_lengths(packed(t)).select("shard", "pack_id", "n_items", "length", F.array_join(F.transform("lens", lambda x: x.cast("string")), ",").alias("sample_lens"))


@query(f"{PACKED} SELECT shard, pack_id, row_number() OVER (PARTITION BY shard, pack_id ORDER BY pack_offset, id) - 1 AS ord, pack_offset AS cu_start, pack_offset + n AS cu_end, max(n) OVER (PARTITION BY shard, pack_id) AS max_len FROM p")
def cu_seqlens(t: Tables) -> DataFrame:
    return P.cu_seqlens(packed(t))


@query(f"{PACKED} SELECT shard, pack_id, sum(n * (n + 1) // 2)::BIGINT AS allowed, 16777216::BIGINT AS dense, round(sum(n * (n + 1) // 2)::BIGINT / 16777216.0::DOUBLE, 6) AS density FROM p GROUP BY ALL")
def doc_mask(t: Tables) -> DataFrame:
    return P.mask_pairs(packed(t))


@query(f"{PACKED} SELECT a.shard, a.pack_id, a.id AS id_q, count(*) FILTER (b.id <> a.id) AS n_other, count(*) AS n_pack FROM p a JOIN p b ON a.shard IS NOT DISTINCT FROM b.shard AND a.pack_id = b.pack_id GROUP BY ALL")
def join_doc_self(t: Tables) -> DataFrame:
    """Items each item shares its pack with: the self-join of a pack, by a count instead of pairs."""
    p = packed(t)
    n = p.groupBy("shard", "pack_id").agg(F.count("*").alias("n_pack")).withColumnRenamed("shard", "s").withColumnRenamed("pack_id", "k")
    return p.join(n, p["shard"].eqNullSafe(F.col("s")) & (p["pack_id"] == F.col("k"))).select("shard", "pack_id", F.col("id").alias("id_q"), (F.col("n_pack") - 1).alias("n_other"), "n_pack")


@query(f"""{PACKED}, b AS (SELECT shard, pack_id, pack_offset // 128 AS f, (pack_offset + n - 1) // 128 AS l FROM p WHERE n > 0), q AS (SELECT shard, pack_id, f, unnest(range(f, l + 1)) AS q FROM b),
c AS (SELECT DISTINCT shard, pack_id, q, unnest(range(f, q + 1)) AS k FROM q) SELECT shard, pack_id, count(*) AS active_blocks, 1024::BIGINT AS total_blocks, string_agg(q || ':' || k, ',' ORDER BY q, k) AS blocks FROM c GROUP BY ALL""")
def block_mask(t: Tables) -> DataFrame:
    blocks = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["q"].cast("string"), b["k"].cast("string"))), ",")
    return P.block_mask(packed(t)).withColumn("blocks", blocks)


@query(f"""{PACKED}, l AS (SELECT shard, pack_id, list(n ORDER BY pack_offset, id) AS lens FROM p GROUP BY ALL)
SELECT shard, pack_id, md5(array_to_string(list_concat(flatten(list_transform(lens, lambda n, i: list_transform(range(n), lambda j: i - 1))), list_transform(range(4096 - list_sum(lens)::BIGINT), lambda j: -1)), ',')) AS ids_md5 FROM l""")
def doc_ids(t: Tables) -> DataFrame:
    ids = P.doc_ids("lens", C.PACK)
    return P.pack_lengths(packed(t)).select("shard", "pack_id", F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query(f"SELECT source AS shard, count(*) FILTER (n > 4096) AS n_skipped, count(*) FILTER (n <= 4096) AS n_kept FROM (SELECT source, {ntok('text')} AS n FROM documents WHERE text IS NOT NULL) GROUP BY source")
def oversize_filter(t: Tables) -> DataFrame:
    over = F.col("n") > C.PACK
    return items(t).groupBy("shard").agg(F.count_if(over).alias("n_skipped"), F.count_if(~over).alias("n_kept"))


def next_fit_sql(source: str) -> str:
    """The CTEs of next-fit over other items (shard, ord, id, n)."""
    return NEXT_FIT[NEXT_FIT.index("o AS MATERIALIZED") :].replace(" FROM i ", f" FROM {source} ")


ONCE = "e AS (SELECT example_id, any_value(pack_id) AS pack_id, any_value(shard) AS shard, any_value(base_input_ids) AS base_input_ids, any_value(base_labels) AS base_labels, any_value(memory_strings) AS memory_strings, any_value(memory_positions) AS memory_positions FROM base_examples GROUP BY example_id)"
IS_REGION = "coalesce(base_input_ids[p + 1] = 50257 AND base_input_ids[p + 2] = 50258 AND base_input_ids[p + 3] = 50259 AND p >= 0, false)"
VERIFY = f"v AS (SELECT *, coalesce(len(memory_strings), 0)::BIGINT AS n_strings, coalesce(len(memory_positions), 0)::BIGINT AS n_positions, coalesce(len(list_filter(memory_positions, lambda p: NOT {IS_REGION})), 0)::BIGINT AS n_bad FROM e)"
VALID = f"{ONCE}, {VERIFY}, ok AS (SELECT *, list_transform(coalesce(memory_strings, []), lambda s: {lat(nemb("coalesce(s, '')"))}) AS k, coalesce(memory_positions, []) AS pos FROM v WHERE n_strings = n_positions AND n_bad = 0 AND base_input_ids IS NOT NULL)"


def examples(t: Tables) -> DataFrame:
    """Examples as packed; results of each are made distinct, so an example packed twice counts once without a shuffle of its arrays."""
    return spread(t.base_examples.select("example_id", *E.COLUMNS))


@query(f"WITH {ONCE}, {VERIFY} SELECT example_id, n_strings, n_positions, n_bad, n_strings = n_positions AND n_bad = 0 AS is_valid FROM v")
def verify_positions(t: Tables) -> DataFrame:
    return E.verify(examples(t)).distinct()


@query(f"WITH {VALID} SELECT shard, count(*) AS n_valid FROM ok GROUP BY shard")
def invalid_region_filter(t: Tables) -> DataFrame:
    return E.valid(examples(t)).select("example_id", "shard").distinct().groupBy("shard").agg(F.count("*").alias("n_valid"))


@query(f"WITH {VALID} SELECT pack_id, count(*) AS n_examples FROM ok GROUP BY pack_id")
def empty_pack_filter(t: Tables) -> DataFrame:
    """Packs with at least one example left."""
    return E.valid(examples(t)).select("example_id", "pack_id").distinct().groupBy("pack_id").agg(F.count("*").alias("n_examples"))


EXPAND = f"""{VALID}, x AS (SELECT example_id, pack_id, pos, k,
flatten(list_transform(base_input_ids, lambda a, i: CASE WHEN list_contains(pos, (i - 2)::INT) THEN list_transform(range(k[list_position(pos, (i - 2)::INT)]), lambda j: a) ELSE [a] END)) AS ids,
flatten(list_transform(base_input_ids, lambda a, i: CASE WHEN list_contains(pos, (i - 2)::INT) THEN list_transform(range(k[list_position(pos, (i - 2)::INT)]), lambda j: -100::BIGINT) WHEN list_contains(pos, (i - 1)::INT) OR list_contains(pos, (i - 3)::INT) OR base_labels IS NULL THEN [-100::BIGINT] ELSE [base_labels[i]] END)) AS labels FROM ok)"""


@query(f"WITH {EXPAND} SELECT example_id, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(list_transform(labels, lambda z: coalesce(z::VARCHAR, '')), ',')) AS labels_md5, len(ids)::BIGINT AS seq_len, len(pos)::BIGINT AS n_regions FROM x")
def expand_base_example(t: Tables) -> DataFrame:
    join = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ","))
    return E.expand(examples(t)).select("example_id", join("input_ids").alias("ids_md5"), join("labels").alias("labels_md5"), "seq_len", F.size("spans").cast("bigint").alias("n_regions")).distinct()


@query(f"""WITH {EXPAND}, s AS (SELECT example_id, unnest(pos) AS p, unnest(k) AS kk, pos, k FROM x) SELECT example_id, p + 1 + coalesce(list_sum(list_transform(list_filter(list_zip(pos, k), lambda z: z[1] < p), lambda z: z[2] - 1)), 0)::BIGINT AS span_start,
p + 1 + coalesce(list_sum(list_transform(list_filter(list_zip(pos, k), lambda z: z[1] < p), lambda z: z[2] - 1)), 0)::BIGINT + kk AS span_end FROM s""")
def example_spans(t: Tables) -> DataFrame:
    s = E.expand(examples(t)).select("example_id", F.explode("spans").alias("s"))
    return s.select("example_id", F.col("s.start").cast("bigint").alias("span_start"), F.col("s.end").cast("bigint").alias("span_end")).distinct()


RUNS = f"{ONCE}, m AS (SELECT example_id, unnest(list_filter(range(1, len(base_input_ids) + 1), lambda i: base_input_ids[i] = 50258)) AS i FROM e), g AS (SELECT example_id, i, i - row_number() OVER (PARTITION BY example_id ORDER BY i) AS grp FROM m)"


@query(f"WITH {RUNS} SELECT example_id, min(i) - 1 AS run_start, max(i) AS run_end FROM g GROUP BY example_id, grp")
def placeholder_runs(t: Tables) -> DataFrame:
    return E.placeholder_runs(examples(t)).distinct()


@query(f"WITH {RUNS}, u AS (SELECT example_id, grp, min(i) - 1 AS s, max(i) AS e FROM g GROUP BY example_id, grp) SELECT example_id, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM u GROUP BY example_id")
def find_positions_unwrapped(t: Tables) -> DataFrame:
    """Spans of the expected lengths (here of the runs themselves) cut from the placeholders; a shorter run raises an error."""
    ids = F.col("base_input_ids")
    e = examples(t).where("base_input_ids is not null").select("example_id", "base_input_ids", F.transform(Q.runs_of(ids, C.MEMORY_ID), lambda r: r["end"] - r["start"]).alias("counts"))
    return e.where(F.size("counts") > 0).select("example_id", span_list(Q.find_unwrapped(ids, F.col("counts"))).alias("spans")).distinct()


COLLATED = f"""{EXPAND}, y AS (SELECT x.*, CASE WHEN e.base_labels IS NULL THEN NULL ELSE x.labels END AS own, list_transform(coalesce(e.memory_strings, []), lambda s: {embed_ids("coalesce(s, '')")}) AS mids,
list_transform(pos, lambda p, i: p + 1 + coalesce(list_sum(list_transform(list_filter(list_zip(pos, k), lambda z: z[1] < p), lambda z: z[2] - 1)), 0)::BIGINT) AS starts FROM x JOIN e USING (example_id)),
o AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY pack_id ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM y),
c AS (SELECT pack_id, flatten(list(ids ORDER BY example_id)) AS ids, CASE WHEN bool_or(own IS NOT NULL) THEN flatten(list(coalesce(own, list_transform(ids, lambda z: -100::BIGINT)) ORDER BY example_id)) END AS labels,
array_to_string(flatten(list(list_transform(starts, lambda s, i: (s + before) || '-' || (s + before + k[i])) ORDER BY example_id)), ',') AS spans, array_to_string(flatten(list(k ORDER BY example_id)), ',') AS counts,
array_to_string(flatten(flatten(list(mids ORDER BY example_id))), ',') AS mem, string_agg(len(ids), ',' ORDER BY example_id) AS sample_lens FROM o GROUP BY pack_id)"""
NULL_AS = "list_transform({0}, lambda z: coalesce(z::VARCHAR, ''))"


def packs(t: Tables) -> DataFrame:
    """The packs as they are given, their examples expanded and put together in the order of their ids; packs without an example left have no row."""
    e = E.expand(examples(t)).withColumn("labels", F.when(F.col("base_labels").isNotNull(), F.col("labels")))
    # an example packed twice counts once
    return Q.collate(e.dropDuplicates(["example_id"]), ["pack_id"], ["example_id"])


def texts_of(values: str) -> Column:
    return F.md5(F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ","))


@query(f"WITH {COLLATED} SELECT pack_id, {joined('ids')} AS ids_md5, len(ids) AS length, spans, counts, md5(mem) AS memory_md5, sample_lens FROM c")
def pack_offsets(t: Tables) -> DataFrame:
    c = packs(t)
    return c.select(
        "pack_id", digest("input_ids").alias("ids_md5"), F.size("input_ids").cast("bigint").alias("length"), span_list("spans").alias("spans"), F.array_join(F.transform("latent_counts", lambda k: k.cast("string")), ",").alias("counts"),
        digest(F.flatten("memory_ids")).alias("memory_md5"), F.array_join(F.transform("sample_lens", lambda n: n.cast("string")), ",").alias("sample_lens"),
    )


@query(f"WITH {COLLATED} SELECT pack_id, {joined(NULL_AS.format('labels'))} AS labels_md5, len(labels) AS n_labels FROM c")
def pack_fill_labels(t: Tables) -> DataFrame:
    """Labels of packs: an example without labels is ignored if another has some; a pack without any has null."""
    return packs(t).select("pack_id", texts_of("labels").alias("labels_md5"), F.when(F.col("labels").isNotNull(), F.size("labels")).cast("bigint").alias("n_labels"))


PAD_BY = "list_transform(range(greatest(0, {0} - len({1}))), lambda j: {2}::BIGINT)"


@query(f"WITH {COLLATED} SELECT pack_id, {joined('list_concat(ids, ' + PAD_BY.format(2048, 'ids', 0) + ')')} AS ids_md5, CASE WHEN labels IS NOT NULL THEN {joined(NULL_AS.format('list_concat(labels, ' + PAD_BY.format(2048, 'labels', -100) + ')'))} END AS labels_md5, greatest(len(ids), 2048) AS length FROM c")
def pad_target(t: Tables) -> DataFrame:
    p = Q.pad_to(packs(t), 2048)
    return p.select("pack_id", digest("input_ids").alias("ids_md5"), texts_of("labels").alias("labels_md5"), F.size("input_ids").cast("bigint").alias("length"))


@query(f"""WITH {COLLATED}, b AS (SELECT *, pack_id // 4 AS batch, greatest(1024, max(len(ids)) OVER (PARTITION BY pack_id // 4)) AS m FROM c) SELECT pack_id, batch, m AS length,
{joined('list_concat(ids, ' + PAD_BY.format('m', 'ids', 0) + ')')} AS ids_md5, CASE WHEN labels IS NOT NULL THEN {joined(NULL_AS.format('list_concat(labels, ' + PAD_BY.format('m', 'labels', -100) + ')'))} END AS labels_md5, sample_lens FROM b""")
def collate_packs(t: Tables) -> DataFrame:
    """Batches of four packs, filled up to 1,024 ids or their longest."""
    b = Q.collate_batches(packs(t), [], "pack_id", 4, 1024)
    lens = F.array_join(F.transform("sample_lens", lambda n: n.cast("string")), ",")
    return b.select("pack_id", "batch", F.size("input_ids").cast("bigint").alias("length"), digest("input_ids").alias("ids_md5"), texts_of("labels").alias("labels_md5"), lens.alias("sample_lens"))


SEQ = f"s AS (SELECT doc_id AS id, {nemb('text')} AS n FROM documents WHERE text IS NOT NULL)"
TILE = f"{SEQ}, w0 AS (SELECT id, n, unnest(range(0, n, 1024)) AS start_pos FROM s WHERE n > 0), w AS (SELECT id, start_pos // 1024 AS win, start_pos, least(1024, n - start_pos) AS pool_len, {lat('least(1024, n - start_pos)')} AS n_latent, least(256, start_pos) AS \"left\", least(n, start_pos + least(1024, n - start_pos) + 256) - (start_pos + least(1024, n - start_pos)) AS \"right\" FROM w0)"


def sequences(t: Tables) -> DataFrame:
    return docs(t).select(F.col("doc_id").alias("id"), T.n_embed_tokens("text").alias("n"))


@query(f"WITH {TILE} SELECT * FROM w")
def window_tiling(t: Tables) -> DataFrame:
    return W.tile(sequences(t))


@query(f"WITH {TILE} SELECT id, win, \"left\", 0::BIGINT AS \"right\" FROM w")
def boundary_overlap(t: Tables) -> DataFrame:
    """Context of causal windows: none after a tile."""
    return W.tile(sequences(t), bidirectional=False).select("id", "win", "left", "right")


WINDOWS = f"""{TILE}, dd AS (SELECT doc_id AS id, {embed_ids('text')} AS ids FROM documents WHERE text IS NOT NULL), wi AS (SELECT w.*, ids[start_pos - "left" + 1:start_pos + pool_len + "right"] AS body FROM w JOIN dd USING (id))"""


def id_sequences(t: Tables) -> DataFrame:
    return docs(t).select(F.col("doc_id").alias("id"), STAND_IN.embed_ids(F.col("text")).alias("ids"))


@query(f"WITH {WINDOWS} SELECT id, win, {joined('list_concat(body, ' + many('n_latent', '0') + ')')} AS ids_md5, array_to_string(range(len(body), len(body) + n_latent), ',') AS markers FROM wi")
def eos_markers(t: Tables) -> DataFrame:
    w = W.window_ids(id_sequences(t), eos=True)
    return w.select("id", "win", digest("window_ids").alias("ids_md5"), F.array_join(F.transform("markers", lambda m: m.cast("string")), ",").alias("markers"))


@query(f"""WITH {WINDOWS}, nb AS (SELECT *, (row_number() OVER (ORDER BY id, win) - 1) // 128 AS batch FROM wi), mb AS (SELECT *, max(len(body)) OVER (PARTITION BY batch) - len(body) AS gap FROM nb)
SELECT id, win, batch, {joined('list_concat(' + many('gap', '0') + ', body)')} AS ids_md5, gap + len(body) AS length, gap AS n_masked, {joined('list_concat(' + many('gap', '0') + ', range(len(body)))')} AS positions_md5 FROM mb""")
def left_pad_batch(t: Tables) -> DataFrame:
    """Batches of 128 windows across sequences, filled up on the left, with mask and positions that begin anew."""
    w = W.left_pad(W.window_ids(id_sequences(t)))
    masked = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + 1 - x)
    return w.select("id", "win", "batch", digest("input_ids").alias("ids_md5"), F.size("input_ids").cast("bigint").alias("length"), masked.alias("n_masked"), digest("position_ids").alias("positions_md5"))


@query(f"WITH {TILE}, r AS (SELECT id % 6 AS rank, count(*) AS n_windows FROM w GROUP BY 1), b AS (SELECT *, greatest(1, (n_windows + 15) // 16) AS n_batches FROM r) SELECT *, max(n_batches) OVER () - n_batches AS n_dummies FROM b")
def minibatch_sync(t: Tables) -> DataFrame:
    """Windows of six ranks in batches of 16, and the empty batches that keep the ranks together."""
    return W.minibatches(W.tile(sequences(t)).select((F.col("id") % 6).alias("rank")), 16)


@query(f"WITH {ONCE} SELECT example_id, len(base_input_ids)::BIGINT AS n, {joined('base_input_ids')} AS ids_md5 FROM e")
def ragged_normalise(t: Tables) -> DataFrame:
    """Ids that come as one row of a batch, as a plain array."""
    one = Q.one_dimensional(examples(t).select("example_id", F.array("base_input_ids").alias("ids")), "ids")
    return one.select("example_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint").alias("n"), digest("ids").alias("ids_md5")).distinct()


ENCODED = f"""{WINDOWS}, e AS (SELECT id, start_pos + o AS pos, win, o // 16 AS grp, unnest([97, 89, 83, 79]) AS m, unnest([1, 2, 3, 4]) AS d, ids[start_pos + o + 1] AS x FROM (SELECT w.*, ids, unnest(range(pool_len)) AS o FROM w JOIN dd USING (id))),
l AS (SELECT id, win, grp, d, round(avg(x % m) * 100000)::BIGINT AS v FROM e GROUP BY ALL)"""


@query(f"WITH {ENCODED} SELECT s.id, coalesce(count(v) // 4, 0) + (count(v) = 0)::INT AS n_latents, md5(coalesce(string_agg(v, ',' ORDER BY win, grp, d), '0,0,0,0')) AS latents_md5 FROM s LEFT JOIN l USING (id) GROUP BY s.id")
def encode_regions(t: Tables) -> DataFrame:
    """Every document through windows, encoder, pooling and regrouping."""
    latents = W.encode(id_sequences(t))
    return latents.select("id", "n_latents", F.md5(round_vec(F.flatten("latents"))).alias("latents_md5"))


@query(f"WITH {TILE}, j AS (SELECT s.id, w.win FROM s JOIN w USING (id)) SELECT id, count(*) AS n FROM j GROUP BY id")
def join_owner(t: Tables) -> DataFrame:
    """Windows joined to the sequences that own them."""
    s = sequences(t)
    return s.join(W.tile(s).select("id", "win"), "id").groupBy("id").agg(F.count("*").alias("n"))


def hidden(t: Tables) -> DataFrame:
    """Vectors as hidden states: ten in a row are a sequence."""
    return t.embeddings.select(F.expr("vec_id div 10").alias("id"), (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("vec"))


HIDDEN = "h AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"
MEANS = f"{HIDDEN}, u AS (SELECT id, pos // 4 AS grp, pos, unnest(vec) AS x, unnest(range(len(vec))) AS d FROM h), a AS (SELECT id, grp, d, avg(x) AS x FROM u GROUP BY ALL), pm AS (SELECT id, grp, list(x ORDER BY d) AS vec FROM a GROUP BY id, grp)"


def rounded(v: str) -> str:
    """A vector as a text of its values in units of 1e-5."""
    return f"array_to_string(list_transform({v}, lambda x: round(x * 100000)::BIGINT), ',')"


def round_vec(v) -> Column:
    return F.array_join(F.transform(v, lambda x: F.round(x * 100000).cast("bigint").cast("string")), ",")


@query(f"WITH {MEANS} SELECT id, grp, {rounded('vec')} AS vec FROM pm")
def pool_mean(t: Tables) -> DataFrame:
    return W.pool_mean(hidden(t), ["id"], 4).withColumn("vec", round_vec("vec"))


@query(f"WITH {HIDDEN}, g AS (SELECT id, pos // 4 AS grp, flatten(list(vec ORDER BY pos)) AS v FROM h GROUP BY ALL) SELECT id, grp, {rounded('list_concat(v, list_transform(range(256 - len(v)), lambda j: 0.0::DOUBLE))')} AS vec FROM g")
def pool_concat(t: Tables) -> DataFrame:
    return W.pool_concat(hidden(t), ["id"], 4).withColumn("vec", round_vec("vec"))


@query(f"WITH {HIDDEN}, z AS (SELECT id, max(pos) + 1 AS n FROM h GROUP BY id) SELECT id, pos - (n - (n + 3) // 4) AS grp, {rounded('vec')} AS vec FROM h JOIN z USING (id) WHERE pos >= n - (n + 3) // 4")
def pool_eos(t: Tables) -> DataFrame:
    """The vectors at the markers: the last of each sequence, one for every four places."""
    h = hidden(t)
    k = F.expr("(n + 3) div 4")
    windows = h.groupBy("id").agg((F.max("pos") + 1).alias("n")).select("id", F.sequence(F.col("n") - k, F.col("n") - 1).alias("markers"))
    return W.pool_eos(h, windows, ["id"]).withColumn("vec", round_vec("vec"))


@query(f"WITH {MEANS}, s AS (SELECT DISTINCT id FROM h UNION ALL SELECT -1), l AS (SELECT id, flatten(list(vec ORDER BY grp)) AS v, count(*) AS n FROM pm GROUP BY id) SELECT s.id, coalesce(n, 1) AS n_latents, {rounded('coalesce(v, list_transform(range(64), lambda j: 0.0::DOUBLE))')} AS vec FROM s LEFT JOIN l USING (id)")
def regroup_by_sample(t: Tables) -> DataFrame:
    """Latents of each sample's windows in order; the sample -1 has none and gets a zero vector."""
    h = hidden(t)
    pooled = W.pool_mean(h, ["id"], 4).withColumn("win", F.lit(0))
    samples = h.select("id").distinct().unionByName(t.spark.range(1).select(F.lit(-1).cast("bigint").alias("id")))
    return W.regroup(samples, pooled, 64).select("id", "n_latents", round_vec(F.flatten("latents")).alias("vec"))


@query(f"""WITH {MEANS}, e AS (SELECT id, label FROM (SELECT vec_id // 10 AS id, label, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1), c AS (SELECT label, id, count(*) AS k FROM pm JOIN e USING (id) GROUP BY ALL),
p AS (SELECT label, id, unnest(range(max(k) OVER (PARTITION BY label))) AS slot FROM c) SELECT p.label, p.id, slot, {rounded('coalesce(vec, list_transform(range(64), lambda j: 0.0::DOUBLE))')} AS vec, (vec IS NOT NULL)::BIGINT AS mask FROM p LEFT JOIN pm ON pm.id = p.id AND pm.grp = slot""")
def segment_batch_pad(t: Tables) -> DataFrame:
    """Segments of a batch (here, of a label) with as many latents as the longest, and a mask."""
    label = t.embeddings.groupBy(F.expr("vec_id div 10").alias("id")).agg(F.min_by("label", "vec_id").alias("label"))
    segments = W.regroup(label.select("id"), W.pool_mean(hidden(t), ["id"], 4).withColumn("win", F.lit(0)), 64).join(label, "id")
    return W.segment_pad(segments, "label", 64).select("label", "id", "slot", round_vec("vec").alias("vec"), "mask")


@query(f"WITH {MEANS} SELECT h.id, h.pos, {rounded('CASE WHEN h.pos BETWEEN 2 AND 4 AND pm.vec IS NOT NULL THEN pm.vec ELSE h.vec END')} AS vec FROM h LEFT JOIN pm ON pm.id = h.id AND pm.grp = h.pos - 2")
def splice_latents(t: Tables) -> DataFrame:
    """Each sequence's latents put in the place of its vectors from position 2 on."""
    h = hidden(t)
    latents = W.pool_mean(h, ["id"], 4).select("id", F.lit(0).cast("bigint").alias("region"), F.col("grp").alias("slot"), "vec")
    spans = latents.groupBy("id", "region").agg(F.count("*").alias("k")).select("id", "region", F.lit(2).cast("bigint").alias("start"), (F.col("k") + 2).alias("end"))
    return W.splice(h, spans, latents).withColumn("vec", round_vec("vec"))


@query(f"WITH {MEANS} SELECT h.id, h.pos, {rounded('CASE WHEN h.pos BETWEEN 2 AND 3 AND pm.vec IS NOT NULL THEN pm.vec ELSE h.vec END')} AS vec FROM h LEFT JOIN pm ON pm.id = h.id AND pm.grp = h.pos - 2")
def splice_serving(t: Tables) -> DataFrame:
    """The same for spans of two positions: latents too many are left out, as in serving."""
    h = hidden(t)
    latents = W.pool_mean(h, ["id"], 4).select("id", F.lit(0).cast("bigint").alias("region"), F.col("grp").alias("slot"), "vec")
    spans = h.select("id").distinct().select("id", F.lit(0).cast("bigint").alias("region"), F.lit(2).cast("bigint").alias("start"), F.lit(4).cast("bigint").alias("end"))
    return W.splice(h, spans, latents, strict=False).withColumn("vec", round_vec("vec"))


@query("SELECT example_id, i - 1 AS ord, memory_positions[i] AS pos, length(memory_strings[i])::BIGINT AS n_chars FROM (SELECT *, unnest(range(1, least(coalesce(len(memory_strings), 0), coalesce(len(memory_positions), 0)) + 1)) AS i FROM (SELECT example_id, any_value(memory_strings) AS memory_strings, any_value(memory_positions) AS memory_positions FROM base_examples GROUP BY example_id))")
def join_positional(t: Tables) -> DataFrame:
    """Strings and positions of an example side by side by place; what has no partner is left out."""
    z = examples(t).select("example_id", F.posexplode(F.arrays_zip("memory_strings", "memory_positions")).alias("ord", "z"), F.least(F.size("memory_strings"), F.size("memory_positions")).alias("n"))
    return z.where("ord < n").select("example_id", F.col("ord").cast("bigint").alias("ord"), F.col("z.memory_positions").alias("pos"), F.length("z.memory_strings").cast("bigint").alias("n_chars")).distinct()


MIXED = f"""{RAW}, {CHAT}, {CONTINUED}, {PLAN}, both_ AS (SELECT row_id, list_concat(w_ids, tid) AS ids, list_concat({many('len(w_ids)', '-100')}, tid) AS labels FROM cw UNION ALL SELECT row_id, w_ids, w_labels FROM tw),
b AS (SELECT *, row_ord // 8 AS batch, max(len(ids)) OVER (PARTITION BY file_ord, row_ord // 8) AS m FROM both_ JOIN plan USING (row_id))"""


@query(f"WITH {MIXED} SELECT row_id, file_ord, row_ord, batch, m AS length, {joined('list_concat(ids, ' + PAD_BY.format('m', 'ids', 0) + ')')} AS ids_md5, {joined('list_concat(labels, ' + PAD_BY.format('m', 'labels', -100) + ')')} AS labels_md5, len(ids) AS n_attended FROM b")
def collate_mixed(t: Tables) -> DataFrame:
    """Chat and continual rows side by side in batches of eight in read order, filled up on the right to the longest."""
    # a row delivered twice counts once
    b = Q.preprocess(raw(t)).join(plan(t), "row_id").dropDuplicates(["row_id"]).withColumn("batch", F.floor(F.col("row_ord") / 8).cast("bigint"))
    p = Q.pad_batches(b.select("row_id", "file_ord", "row_ord", "batch", "input_ids", "labels"), ["file_ord", "batch"])
    attended = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("row_id", "file_ord", "row_ord", "batch", F.size("input_ids").cast("bigint").alias("length"), digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"), attended.alias("n_attended"))


@query(f"WITH RECURSIVE {EXPAND}, b AS MATERIALIZED (SELECT e.shard::VARCHAR AS shard, md5('42-' || example_id) AS ord, example_id AS id, len(ids)::BIGINT AS n FROM x JOIN e USING (example_id)), {next_fit_sql('b')} SELECT shard, id, n, pack_id, pack_offset FROM p")
def pack_examples(t: Tables) -> DataFrame:
    """Expanded examples packed anew within their shards, of which one is much larger than the rest."""
    e = E.expand(examples(t)).select("example_id", "shard", "seq_len").distinct()
    key = F.md5(F.concat_ws("-", F.lit(str(C.SEED)), F.col("example_id").cast("string")))
    return P.pack_next_fit(e.select(F.col("shard").cast("string").alias("shard"), key.alias("ord"), F.col("example_id").alias("id"), F.col("seq_len").alias("n")))

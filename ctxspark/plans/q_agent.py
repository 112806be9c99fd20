"""Queries on passages, prompts, responses and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import parsing as P
from ctxspark.operators import agent as A
from ctxspark.operators import passages as G
from ctxspark.operators import scoring as S
from ctxspark.plans.q_text import bodies, docs, ks, nemb, ntok, part_sum, total
from ctxspark.plans.registry import Tables, query

WS = "[" + C.SPACE + "]"
WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


SENTS = f"string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(57344), 'g'), chr(57344))"


def texts(t: Tables) -> DataFrame:
    return docs(t).select(F.col("doc_id").alias("id"), "text")


@query(f"SELECT doc_id AS id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {SENTS} AS s FROM documents WHERE text IS NOT NULL)")
def split_sentences(t: Tables) -> DataFrame:
    s = texts(t).select("id", G.sentences("text").alias("s"))
    return s.select("id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def chunks_of(source: str) -> str:
    """CTEs with the passages k (id, passage_no, passage) of ``source`` (id, text) along sentences."""
    return f"""d AS MATERIALIZED (SELECT id, text, {ntok('text')} AS n, {SENTS} AS s FROM ({source}) WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT id, i, s[i] AS x, {ntok('s[i]')} AS n FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM d WHERE n > 450)),
f AS (SELECT id, i, x, n, 0 AS p, n AS total FROM s WHERE i = 1 UNION ALL
SELECT s.id, s.i, s.x, s.n, CASE WHEN f.total + s.n > 450 THEN f.p + 1 ELSE f.p END, CASE WHEN f.total + s.n > 450 THEN s.n ELSE f.total + s.n END FROM f JOIN s ON s.id = f.id AND s.i = f.i + 1),
c AS (SELECT id, p, string_agg(x, ' ' ORDER BY i) AS passage FROM f GROUP BY id, p UNION ALL SELECT id, 0, text FROM d WHERE n <= 450),
k AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS passage_no, passage FROM c WHERE {strip('passage')} <> '')"""


CHUNKS = f"WITH RECURSIVE {chunks_of('SELECT doc_id AS id, text FROM documents')}"


@query(f"{CHUNKS} SELECT id, passage_no, {ntok('passage')} AS n_tokens, md5(passage) AS passage_md5 FROM k")
def chunk_sentences(t: Tables) -> DataFrame:
    from ctxspark.functions.text import n_tokens

    c = G.chunk_sentences(texts(t))
    return c.select("id", "passage_no", n_tokens("passage").alias("n_tokens"), F.md5("passage").alias("passage_md5"))


# paragraphs that fit are one group while they follow each other, one that doesn't fit is a group of sentences: folds begin anew with each group
PARA_SENTS = SENTS.replace("text", "y")
PARAGRAPHS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS id, text, {ntok('text')} AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT id, i, y, {ntok('y')} AS n FROM (SELECT id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS y FROM (SELECT id, list_filter(regexp_split_to_array(text, '\n{WS}*\n'), lambda x: {strip('x')} <> '') AS ps FROM d WHERE n > 450))),
g AS (SELECT *, sum(CASE WHEN n > 450 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) * 2 - CASE WHEN n > 450 THEN 1 ELSE 0 END AS grp FROM p),
u AS (SELECT id, i, 1 AS j, y AS x, n, grp FROM g WHERE n <= 450 UNION ALL SELECT id, i, j, s[j], {ntok('s[j]')}, grp FROM (SELECT id, i, grp, s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT id, i, grp, {PARA_SENTS} AS s FROM g WHERE n > 450))),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, j) AS rn FROM u),
f AS (SELECT id, rn, x, n, grp, 0 AS q, n AS total FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.rn, o.x, o.n, o.grp, CASE WHEN o.grp <> f.grp OR f.total + o.n > 450 THEN f.q + 1 ELSE f.q END, CASE WHEN o.grp <> f.grp OR f.total + o.n > 450 THEN o.n ELSE f.total + o.n END FROM f JOIN o ON o.id = f.id AND o.rn = f.rn + 1),
c AS (SELECT id, q, CASE WHEN any_value(grp) % 2 = 1 THEN string_agg(x, ' ' ORDER BY rn) ELSE string_agg(x, chr(10) || chr(10) ORDER BY rn) END AS passage FROM f GROUP BY id, q UNION ALL SELECT id, 0, text FROM d WHERE n <= 450)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY q) - 1 AS passage_no, md5(passage) AS passage_md5 FROM c WHERE {strip('passage')} <> ''"""


@query(PARAGRAPHS)
def chunk_paragraphs(t: Tables) -> DataFrame:
    return G.chunk_paragraphs(texts(t)).select("id", "passage_no", F.md5("passage").alias("passage_md5"))


LINES = "string_split(input, chr(10))"
SAMPLE = f"""smp AS (SELECT item_id, prompt AS input FROM benchmark_rows WHERE prompt IS NOT NULL), l AS (SELECT item_id, {LINES} AS x FROM smp),
ps AS (SELECT item_id, CASE WHEN len(x) >= 3 THEN x[1] ELSE '' END AS prefix, CASE WHEN len(x) >= 3 THEN array_to_string(x[2:len(x) - 1], chr(10)) ELSE x[1] END AS body, CASE WHEN len(x) >= 2 THEN x[len(x)] ELSE '' END AS question FROM l)"""


def samples(t: Tables) -> DataFrame:
    return t.benchmark_rows.where("prompt is not null").select("item_id", P.sample_lines("prompt").alias("l")).select("item_id", "l.*")


@query(f"WITH {SAMPLE} SELECT item_id, md5(prefix) AS prefix_md5, md5(body) AS body_md5, md5(question) AS question_md5 FROM ps")
def parse_sample_lines(t: Tables) -> DataFrame:
    return samples(t).select("item_id", *(F.md5(c).alias(f"{c}_md5") for c in ("prefix", "body", "question")))


HEAD = "CASE WHEN rtrim(prefix) <> '' THEN rtrim(prefix) || {0} ELSE '' END"


@query(f"WITH {SAMPLE} SELECT item_id, md5({HEAD.format('chr(10)')} || '<|memory_start|>' || chr(10) || body || chr(10) || '<|memory_end|>' || chr(10) || chr(10) || {strip('question')}) AS prompt_md5 FROM ps")
def prompt_single_block(t: Tables) -> DataFrame:
    return samples(t).select("item_id", F.md5(G.prompt_single_block(F.col("prefix"), F.col("body"), F.col("question"))).alias("prompt_md5"))


def with_passages(t: Tables) -> DataFrame:
    """Documents as samples: their passages, a question, and the selection that a response on the id and the number of passages names."""
    p = G.passages_of(G.chunk_sentences(texts(t)))
    said = F.concat(F.lit("SELECTED: "), F.col("id") % F.size("passages") + 1, F.lit(", "), (F.col("id") + 2) % F.size("passages") + 1)
    return p.select("id", F.concat(F.lit("Text "), F.col("id").cast("string")).alias("prefix"), "passages", F.lit(" What is said? ").alias("question"), P.parse_selection(said, F.size("passages").cast("bigint")).alias("chosen"))


LISTED = f"{CHUNKS}, a0 AS (SELECT id, list(passage ORDER BY passage_no) AS p FROM k GROUP BY id), a AS (SELECT *, list_sort(list_distinct([id % len(p) + 1, (id + 2) % len(p) + 1])) AS sel FROM a0)"
OPENED = "array_to_string(list_transform(sel, lambda i: " + strip("p[i]") + "), chr(10) || chr(10))"
COMPRESSED = "'Passage ' || i || {0} || '<|memory_start|>' || x || '<|memory_end|>'"
HEAD2 = "'Text ' || id || chr(10) || chr(10)"


@query(f"{LISTED} SELECT id, md5({HEAD2} || array_to_string(list_transform(p, lambda x, i: {COMPRESSED.format(chr(39) + ' [compressed]: ' + chr(39))}), chr(10)) || chr(10) || chr(10) || 'What is said?') AS prompt_md5 FROM a")
def prompt_compressed_only(t: Tables) -> DataFrame:
    return with_passages(t).select("id", F.md5(G.prompt_compressed_only(F.col("prefix"), F.col("passages"), F.col("question"))).alias("prompt_md5"))


@query(f"{LISTED} SELECT id, md5({HEAD2} || array_to_string(list_transform(p, lambda x, i: CASE WHEN list_contains(sel, i) THEN 'Passage ' || i || ' [open]:' || chr(10) || x ELSE {COMPRESSED.format(chr(39) + ' [compressed]: ' + chr(39))} END), chr(10)) || chr(10) || chr(10) || 'What is said?') AS prompt_md5 FROM a")
def prompt_answer(t: Tables) -> DataFrame:
    return with_passages(t).select("id", F.md5(G.prompt_answer(F.col("prefix"), F.col("passages"), F.col("chosen"), F.col("question"))).alias("prompt_md5"))


@query(f"{LISTED} SELECT id, md5({HEAD2} || array_to_string(list_transform(p, lambda x, i: {COMPRESSED.format(chr(39) + ': ' + chr(39))}), chr(10)) || chr(10) || chr(10) || 'What is said?' || chr(10) || chr(10) || 'Which passages may hold what the question needs? When in doubt include a passage; name 3 or more unless fewer are surely enough. End with a line `SELECTED: <numbers>`.') AS prompt_md5 FROM a")
def prompt_triage(t: Tables) -> DataFrame:
    return with_passages(t).select("id", F.md5(G.prompt_triage(F.col("prefix"), F.col("passages"), F.col("question"), 3)).alias("prompt_md5"))


@query(f"{LISTED} SELECT id, md5('[Opened]' || chr(10) || array_to_string(list_transform(sel, lambda i: 'Passage ' || i || ':' || chr(10) || {strip('p[i]')}), chr(10) || chr(10)) || CASE WHEN id % 3 > 0 THEN chr(10) || chr(10) || 'Rounds left: ' || id % 3 ELSE '' END) AS result_md5 FROM a")
def tool_result(t: Tables) -> DataFrame:
    return with_passages(t).select("id", F.md5(G.tool_result(F.col("passages"), F.col("chosen"), F.col("id") % 3)).alias("result_md5"))


@query(f"{LISTED} SELECT id, md5({HEAD2} || '[Passages, compressed]' || chr(10) || array_to_string(list_transform(p, lambda x, i: {COMPRESSED.format(chr(39) + ': ' + chr(39))}), chr(10)) || chr(10) || chr(10) || '[Open passages]' || chr(10) || {OPENED} || chr(10) || chr(10) || 'Question: What is said?' || chr(10) || chr(10) || 'Rounds left after this one: ' || id % 5 || '.' || chr(10) || 'Ask for more with `EXPAND: <numbers>`, or finish with `ANSWER: <answer>`.') AS prompt_md5 FROM a")
def prompt_round(t: Tables) -> DataFrame:
    return with_passages(t).select("id", F.md5(G.prompt_round(F.col("prefix"), F.col("passages"), F.col("chosen"), F.col("question"), F.col("id") % 5)).alias("prompt_md5"))


@query(f"{LISTED} SELECT id, 2::BIGINT AS n_messages, md5({HEAD2} || '[Passages, compressed]' || chr(10) || array_to_string(list_transform(p, lambda x, i: {COMPRESSED.format(chr(39) + ': ' + chr(39))}), chr(10)) || chr(10) || chr(10) || 'Question: What is said?') AS user_md5 FROM a")
def chat_init(t: Tables) -> DataFrame:
    m = with_passages(t).select("id", G.chat_init(F.col("prefix"), F.col("passages"), F.col("question")).alias("m"))
    return m.select("id", F.size("m").cast("bigint").alias("n_messages"), F.md5(F.element_at("m", -1)["content"]).alias("user_md5"))


@query(f"{CHUNKS} SELECT id, count(*) AS n_kept, max(passage_no) + 1 AS n_numbered FROM k GROUP BY id")
def blank_passage_filter(t: Tables) -> DataFrame:
    return G.chunk_sentences(texts(t)).groupBy("id").agg(F.count("*").alias("n_kept"), (F.max("passage_no") + 1).alias("n_numbered"))


@query(f"{LISTED} SELECT id, len(p)::BIGINT AS n_passages, len(sel)::BIGINT AS n_open FROM a")
def join_semi_anti(t: Tables) -> DataFrame:
    """Passages that are open and those that stay compressed: each passage meets the selection once, and one aggregation counts both sides."""
    c = with_passages(t).select("id", F.posexplode("passages").alias("no", "p"), "chosen")
    return c.groupBy("id").agg(F.count("*").alias("n_passages"), F.count_if(F.array_contains("chosen", F.col("no").cast("bigint"))).alias("n_open"))


# responses
DONE = "c AS (SELECT DISTINCT completion_id, item_id, run_name, answers, response, finished_at FROM completions)"
CLEAN = strip("split_part(response, '<|im_end|>', 1)")


def completions(t: Tables) -> DataFrame:
    return t.completions.distinct()


@query(f"WITH {DONE} SELECT completion_id, {CLEAN} AS answer FROM c")
def clean_response(t: Tables) -> DataFrame:
    return completions(t).select("completion_id", P.clean_response("response").alias("answer"))


def idx(x: str, n: int) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[0-9]+'), lambda v: try_cast(v AS BIGINT) - 1), lambda v: v IS NOT NULL AND v >= 0 AND v < {n})))"


EX, AN = f"'{P.EXPAND}'", f"'{P.ANSWER}'"
PARSED = f"""t AS (SELECT completion_id, {strip('response')} AS t FROM c), e AS (SELECT *, regexp_matches(t, {EX}) AND (NOT regexp_matches(t, {AN}) OR length(regexp_extract(t, {EX}, 1)) > length(regexp_extract(t, {AN}, 1))) AS ex FROM t)"""


@query(f"""WITH {DONE}, {PARSED} SELECT completion_id, CASE WHEN ex THEN 'expand' WHEN t IS NOT NULL THEN 'answer' END AS action, CASE WHEN ex THEN array_to_string({idx(f'regexp_extract(t, {EX}, 2)', 12)}, ',') END AS indices,
CASE WHEN NOT ex THEN CASE WHEN regexp_matches(t, {AN}) THEN {strip(f"split_part(regexp_extract(t, {AN}, 2), '<|im_end|>', 1)")} ELSE t END END AS answer FROM e""")
def parse_round(t: Tables) -> DataFrame:
    r = completions(t).select("completion_id", P.parse_round("response", 12).alias("p"))
    return r.select("completion_id", "p.action", F.array_join(F.transform("p.indices", lambda i: i.cast("string")), ",").alias("indices"), "p.answer")


SEL = f"'{P.SELECTED}'"
LAST = f"coalesce(list_filter(string_split(response, chr(10)), lambda x: {strip('x')} <> '')[-1], '')"


@query(f"""WITH {DONE}, s AS (SELECT completion_id, response, CASE WHEN len(regexp_extract_all(regexp_extract(response, {SEL}, 1), '[0-9]+')) > 0 THEN regexp_extract(response, {SEL}, 1) ELSE {LAST} END AS src FROM c)
SELECT completion_id, CASE WHEN response IS NOT NULL THEN coalesce(nullif(array_to_string({idx('src', 90000)}, ','), ''), '0') END AS chosen FROM s""")
def parse_selection(t: Tables) -> DataFrame:
    return completions(t).select("completion_id", F.array_join(F.transform(P.parse_selection("response", 90000), lambda i: i.cast("string")), ",").alias("chosen"))


SHORT = "list_filter(regexp_extract_all(response, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[0-9]{1,3}$'))"


@query(f"""WITH {DONE} SELECT completion_id, CASE WHEN response IS NOT NULL THEN coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform({SHORT}, lambda v: v::BIGINT - 1), lambda v: v >= 0 AND v < 700)))[1:5], ','), ''), '0') ELSE '0' END AS opened FROM c""")
def forced_expand(t: Tables) -> DataFrame:
    return completions(t).select("completion_id", F.array_join(F.transform(P.forced_expand("response", 700), lambda i: i.cast("string")), ",").alias("opened"))


@query(f"""{LISTED}, e AS (SELECT id, len(p) AS n, list_transform(sel, lambda i: i - 1) AS sel, list_filter(range(len(p)), lambda i: NOT list_contains(sel, i + 1)) AS rest, (least(4, len(p)) - len(sel))::BIGINT AS need FROM a)
SELECT id, n, array_to_string(list_sort(CASE WHEN need <= 0 THEN sel WHEN need >= len(rest) THEN list_concat(sel, rest) ELSE list_concat(sel, list_transform(range(need), lambda k: rest[(k * len(rest)) // need + 1])) END), ',') AS picked FROM e""")
def even_stride_pick(t: Tables) -> DataFrame:
    """Selections filled up to four passages of each document."""
    p = with_passages(t).withColumn("n", F.size("passages").cast("bigint"))
    return p.select("id", "n", F.array_join(F.transform(P.even_stride_pick(F.col("chosen"), F.col("n"), 4), lambda i: i.cast("string")), ",").alias("picked"))


REAL = "list_filter(answers, lambda a: a IS NOT NULL)"
SCORE = f"CASE WHEN len({REAL}) > 0 THEN 100.0::DOUBLE * len(list_filter({REAL}, lambda a: contains(lower(coalesce(response, '')), lower(a)))) / len({REAL}) ELSE 0.0::DOUBLE END"
SCORED = f"{DONE}, s AS (SELECT *, {SCORE} AS score FROM c)"
TASKS = f"{SCORED}, t AS (SELECT coalesce(category, '') AS task, score FROM s LEFT JOIN benchmark_rows USING (item_id)), m AS (SELECT task, count(*) AS n, avg(score) AS mean FROM t GROUP BY task)"


def tasks(t: Tables) -> DataFrame:
    j = S.scored(t.completions).join(t.benchmark_rows.select("item_id", "category"), "item_id", "left")
    return j.select(F.coalesce("category", F.lit("")).alias("task"), "score")


@query(f"WITH {SCORED} SELECT completion_id, run_name, round(score, 4) AS score FROM s")
def score_match_all(t: Tables) -> DataFrame:
    return S.scored(t.completions).select("completion_id", "run_name", F.round("score", 4).alias("score"))


@query(f"WITH {TASKS} SELECT task, n, round(mean, 4) AS mean FROM m")
def task_mean(t: Tables) -> DataFrame:
    return S.task_means(tasks(t)).withColumn("mean", F.round("mean", 4))


@query(f"WITH {TASKS} SELECT count(*) AS n_tasks, round(avg(mean), 4) AS macro FROM m")
def overall_macro(t: Tables) -> DataFrame:
    return S.macro_mean(S.task_means(tasks(t))).withColumn("macro", F.round("macro", 4))


@query(f"WITH {SCORED}, e AS (SELECT run_name, 'score' AS metric, score AS value FROM s UNION ALL SELECT run_name, 'chars', length(response)::DOUBLE FROM s WHERE response IS NOT NULL) SELECT run_name, metric, count(*) AS n_with, round(avg(value), 4) AS mean FROM e GROUP BY ALL UNION ALL SELECT run_name, '__n__', count(*), count(*)::DOUBLE FROM s GROUP BY run_name")
def metric_aggregate(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("score"), F.col("score"), F.lit("chars"), F.length("response").cast("double"))
    return S.metric_aggregate(S.scored(t.completions).select("run_name", m.alias("metrics")), ["run_name"]).withColumn("mean", F.round("mean", 4))


@query(f"WITH {SCORED} SELECT completion_id, run_name, round(avg(score) OVER (PARTITION BY run_name ORDER BY completion_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM s")
def running_score(t: Tables) -> DataFrame:
    return S.running_score(S.scored(t.completions), "run_name", ["completion_id"]).select("completion_id", "run_name", F.round("running", 4).alias("running"))


@query("SELECT DISTINCT doc_id AS id, item_id AS needle_id FROM documents, (SELECT item_id, unnest(extra_info.ground_truth.answers) AS needle FROM benchmark_rows) WHERE needle <> '' AND contains(lower(text), lower(needle))")
def join_contains(t: Tables) -> DataFrame:
    needles = t.benchmark_rows.select(F.col("item_id").alias("needle_id"), F.explode("extra_info.ground_truth.answers").alias("needle"))
    return S.contained_needles(texts(t), needles).distinct()


@query(f"WITH {DONE}, w AS (SELECT item_id, list_sort(list_distinct(flatten(list(coalesce(answers, []))))) AS a FROM c GROUP BY item_id), b AS (SELECT item_id, list_distinct(coalesce(extra_info.ground_truth.answers, [])) AS b FROM benchmark_rows) SELECT item_id, len(list_filter(a, lambda x: x IS NOT NULL))::BIGINT AS n_distinct, len(list_filter(a, lambda x: x IS NOT NULL AND NOT list_contains(b, x)))::BIGINT AS n_except FROM w JOIN b USING (item_id)")
def set_distinct(t: Tables) -> DataFrame:
    """Distinct answers of an item's runs, and those that aren't among its true ones."""
    e = completions(t).select("item_id", F.explode("answers").alias("a")).where("a is not null").distinct()
    true = t.benchmark_rows.select("item_id", F.explode("extra_info.ground_truth.answers").alias("a"))
    n = lambda d, name: d.groupBy("item_id").agg(F.count("*").alias(name))
    every = t.benchmark_rows.select("item_id").join(completions(t).select("item_id").distinct(), "item_id")
    j = every.join(n(e, "n_distinct"), "item_id", "left").join(n(e.join(true, ["item_id", "a"], "left_anti"), "n_except"), "item_id", "left")
    return j.select("item_id", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("n_except", F.lit(0)).alias("n_except"))


SETS = f"{DONE}, w AS (SELECT item_id, list_distinct(flatten(list(coalesce(answers, [])))) AS a FROM c WHERE item_id IS NOT NULL GROUP BY item_id), j AS (SELECT item_id, list_filter(a, lambda x: x IS NOT NULL) AS a, list_filter(list_distinct(coalesce(extra_info.ground_truth.answers, [])), lambda x: x IS NOT NULL) AS b FROM w JOIN benchmark_rows USING (item_id))"


def answer_sets(t: Tables) -> DataFrame:
    """(item_id, a, b): the answers of an item's runs and its true ones, without nulls and repeats."""
    real = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    runs = completions(t).where("item_id is not null").select("item_id", F.explode_outer("answers").alias("x")).distinct().groupBy("item_id").agg(F.collect_set("x").alias("a"))
    return runs.join(t.benchmark_rows.select("item_id", real(F.col("extra_info.ground_truth.answers")).alias("b")), "item_id")


@query(f"WITH {SETS} SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS answers FROM j")
def set_union(t: Tables) -> DataFrame:
    return answer_sets(t).select("item_id", F.array_join(F.array_sort(F.array_union("a", "b")), "|").alias("answers"))


@query(f"WITH {SETS} SELECT item_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS extra FROM j")
def set_except(t: Tables) -> DataFrame:
    return answer_sets(t).select("item_id", F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("extra"))


@query("WITH k AS (SELECT category, count(*) AS n FROM benchmark_rows WHERE extra_info.ground_truth.answers IS NOT NULL GROUP BY category HAVING count(*) >= 2) SELECT category, count(*) AS n FROM benchmark_rows JOIN k USING (category) GROUP BY category")
def subtask_filter(t: Tables) -> DataFrame:
    """Items of subtasks that have at least two items with answers; names that don't occur are skipped."""
    asked = t.benchmark_rows.where("extra_info.ground_truth.answers is not null").groupBy("category").agg(F.count("*").alias("c")).where("c >= 2").select("category")
    asked = asked.unionByName(t.spark.range(1).select(F.lit("memwrap/ruler/none_1").alias("category")))
    return t.benchmark_rows.join(asked, "category", "left_semi").groupBy("category").agg(F.count("*").alias("n"))


def flat_steps(df: DataFrame) -> DataFrame:
    """Results with their steps as one text."""
    step = lambda x: F.concat_ws("/", x["round"].cast("string"), x["action"], F.array_join(F.transform(x["indices"], lambda i: i.cast("string")), "+"), x["n_opened"].cast("string"), x["stats"]["compressed"].cast("string"), x["stats"]["uncompressed"].cast("string"))
    opened = F.array_join(F.transform("opened", lambda i: i.cast("string")), ",")
    return df.withColumns({"steps": F.array_join(F.transform("steps", step), "|"), "opened": opened, "savings_pct": F.col("answer_stats.savings_pct")}).drop("answer_stats")


# The echo responder opens two passages that the first prompt's length picks and answers with what the first of them begins with: two rounds.
def stats_sql(x: str) -> tuple[str, str]:
    real = f"({part_sum(x)} + 2 * len({bodies(x)}))"
    return f"({real} + {total(ks(x))})::BIGINT", f"({real} + {total('list_transform(' + bodies(x) + ', lambda b: ' + nemb('b') + ')')})::BIGINT"


def saved(c: str, u: str) -> str:
    return f"CASE WHEN {u} > 0 THEN round((1 - {c}::DOUBLE / {u}) * 100, 1) ELSE 0.0::DOUBLE END"


NL = "chr(10)"
COMPRESSED_LIST = f"array_to_string(list_transform(p, lambda x, i: {COMPRESSED.format(chr(39) + ': ' + chr(39))}), {NL})"
ANSWER_OF = strip(f"split_part(regexp_extract(raw2, {AN}, 2), '<|im_end|>', 1)")


def two_rounds(start: str, first: str, second: str) -> str:
    """CTEs over a0 (id, p, head, question): the prompts ``first`` and ``second`` and what comes of them."""
    (c1, u1), (c2, u2) = stats_sql("pr1"), stats_sql("pr2")
    return f"""{start}, r1 AS MATERIALIZED (SELECT *, {first} AS pr1 FROM b0), s1 AS MATERIALIZED (SELECT *, length(pr1) % len(p) AS pick FROM r1), t1 AS MATERIALIZED (SELECT *, list_sort(list_distinct([pick + 1, (pick + 1) % len(p) + 1])) AS sel, 'EXPAND: ' || (pick + 1) || ', ' || ((pick + 1) % len(p) + 1) AS raw1 FROM s1),
r2 AS MATERIALIZED (SELECT *, {second} AS pr2, {strip(f"split_part('ANSWER: ' || regexp_extract({second}, '{A.OPENED}', 1), '<|im_end|>', 1)")} AS raw2 FROM t1), m AS MATERIALIZED (SELECT *, {c1} AS c1, {u1} AS u1, {c2} AS c2, {u2} AS u2 FROM r2),
res AS (SELECT id, len(p) AS n_passages, 2 AS n_rounds, array_to_string(sel, ',') AS opened, {ANSWER_OF} AS response, '1/expand/' || array_to_string(list_transform(sel, lambda i: i - 1), '+') || '/0/' || c1 || '/' || u1 || '|2/answer/' || len(sel) || '/' || c2 || '/' || u2 AS steps, {saved('c2', 'u2')} AS savings_pct FROM m)"""


def round_sql(opened: bool, left: int) -> str:
    shown = f"'[Open passages]' || {NL} || {OPENED} || {NL} || {NL} || " if opened else ""
    ask = "Ask for more with `EXPAND: <numbers>`, or finish with `ANSWER: <answer>`." if opened else "Compressed passages can''t be quoted. Ask for at least one now: `EXPAND: <numbers>`."
    return f"head || '[Passages, compressed]' || {NL} || {COMPRESSED_LIST} || {NL} || {NL} || {shown}'Question: ' || question || {NL} || {NL} || 'Rounds left after this one: {left}.' || {NL} || '{ask}'"


DOC_SAMPLES = f"{CHUNKS}, b0 AS (SELECT id, list(passage ORDER BY passage_no) AS p, {HEAD2} AS head, 'What is said?' AS question FROM k GROUP BY id)"
RULES = "You read a long text in compressed passages. `EXPAND: <numbers>` opens passages, `ANSWER: <answer>` ends. Open at least one first. There are 5 rounds."
START_CHAT = f"'<|im_start|>system' || {NL} || '{RULES}<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || head || '[Passages, compressed]' || {NL} || {COMPRESSED_LIST} || {NL} || {NL} || 'Question: ' || question || '<|im_end|>' || {NL} || "
TOLD = f"'[Opened]' || {NL} || array_to_string(list_transform(sel, lambda i: 'Passage ' || i || ':' || {NL} || {strip('p[i]')}), {NL} || {NL}) || {NL} || {NL} || 'Rounds left: 4'"
CHAT_1 = f"{START_CHAT}'<|im_start|>assistant' || {NL}"
CHAT_2 = f"{START_CHAT}'<|im_start|>assistant' || {NL} || raw1 || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || {TOLD} || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}"


@query(f"{two_rounds(DOC_SAMPLES, round_sql(False, 4), round_sql(True, 3))} SELECT * FROM res")
def agent_loop(t: Tables) -> DataFrame:
    return flat_steps(A.agent_loop(with_passages(t)))


@query(f"{two_rounds(DOC_SAMPLES, CHAT_1, CHAT_2)} SELECT * FROM res")
def agent_loop_chat(t: Tables) -> DataFrame:
    return flat_steps(A.agent_loop_chat(with_passages(t)))


ITEM_SAMPLES = f"""WITH RECURSIVE {SAMPLE}, {chunks_of("SELECT item_id AS id, body AS text FROM ps JOIN benchmark_rows USING (item_id) WHERE NOT coalesce(contains(category, '/vt_'), false)")},
b0 AS (SELECT id, p, {HEAD.format(NL + ' || ' + NL)} AS head, {strip('question')} AS question FROM (SELECT id, list(passage ORDER BY passage_no) AS p FROM k GROUP BY id) JOIN ps ON item_id = id)"""
BLOCK_C, BLOCK_U = stats_sql("pr")
SINGLE = f"""one AS MATERIALIZED (SELECT item_id AS id, {HEAD.format(NL)} || '<|memory_start|>' || {NL} || body || {NL} || '<|memory_end|>' || {NL} || {NL} || {strip('question')} AS pr FROM ps JOIN benchmark_rows USING (item_id) WHERE contains(category, '/vt_')),
both_ AS (SELECT 'agent' AS flow, * FROM res UNION ALL SELECT 'compressed', id, 1, 0, '', 'EXPAND: 1, 1', '', {saved(BLOCK_C, BLOCK_U)} FROM one)"""
TRUE = "extra_info.ground_truth.answers"
SCORE_OF = f"CASE WHEN len(list_filter({TRUE}, lambda a: a IS NOT NULL)) > 0 THEN 100.0::DOUBLE * len(list_filter({TRUE}, lambda a: a IS NOT NULL AND contains(lower(coalesce(response, '')), lower(a)))) / len(list_filter({TRUE}, lambda a: a IS NOT NULL)) ELSE 0.0::DOUBLE END"


@query(f"{two_rounds(ITEM_SAMPLES, round_sql(False, 4), round_sql(True, 3))}, {SINGLE} SELECT both_.*, category AS subtask, array_to_string({TRUE}, '|') AS expected, round({SCORE_OF}, 4) AS score FROM both_ JOIN benchmark_rows ON item_id = id")
def run_one_sample(t: Tables) -> DataFrame:
    s = t.benchmark_rows.where("prompt is not null").select(F.col("item_id").alias("id"), F.col("category").alias("subtask"), F.col("prompt").alias("input"), F.col("extra_info.ground_truth.answers").alias("outputs"))
    flow = F.when(F.coalesce(F.col("subtask").contains("/vt_"), F.lit(False)), "compressed").otherwise("agent")
    r = flat_steps(A.run_samples(s, flow))
    return r.withColumns({"score": F.round(F.col("metrics")["score"], 4), "expected": F.array_join("expected", "|")}).drop("metrics")

"""The queries of the problems on training data. Each runs over its whole tables; rows delivered twice count once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm.bpe import count_tokens, encode_texts
from ctxspark.llm.chunk import base_items, raw_items, split_items
from ctxspark.llm.fill import fill_containers, fill_report
from ctxspark.llm.leaks import leaked_items
from ctxspark.llm.near import similar_groups, similar_links, similar_records
from ctxspark.llm.pairs import defective_pairs
from ctxspark.llm.records import BASE, RAW, record_texts
from ctxspark.llm.spans import shared_amounts, shared_spans

LIMIT, OVERLAP = 3000, 200
NEAR = {"k": 3, "t_num": 3, "t_den": 5, "least_words": 20}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    items = raw_items(_table(spark, d, RAW), LIMIT).unionByName(base_items(_table(spark, d, BASE), LIMIT))
    return split_items(items, LIMIT, OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts over the limit and the coarsest level of boundaries that suffices to cut them."""
    return _pieces(spark, d).where("piece_no = 0").select("src", "rec_id", "item_no", "cut_at").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all texts over the limit."""
    return _pieces(spark, d).dropDuplicates(["src", "rec_id", "item_no", "piece_no"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of records of a table with a Jaccard similarity of 0.6 or more on runs of three words."""
    return similar_records(record_texts(spark, d), **NEAR)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of near-duplicates of each record."""
    return similar_groups(record_texts(spark, d), **NEAR)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """How many other texts are similar to that of each record."""
    return similar_links(record_texts(spark, d), **NEAR)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The chat rows whose target is defective, and how."""
    return defective_pairs(_table(spark, d, RAW))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "benchmark_rows").select("item_id", "prompt", F.col("extra_info.ground_truth.answers").alias("answers"))
    return leaked_items(record_texts(spark, d), items)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that hold 13 consecutive words of an item's passage."""
    return _leaks(spark, d).select("src", "rec_id", "item_id")


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item, in how many records its passage is, and in how many with its question or an answer."""
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    return _leaks(spark, d).groupBy("item_id", "src").agg(F.count("*").alias("n_records"), count("has_question").alias("n_question"), count("has_answer").alias("n_answer"), F.sum("n_runs").alias("n_runs"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode_texts(_table(spark, d, "documents"), ["doc_id"])


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens of byte_bpe_50k."""
    return fill_containers(count_tokens(_table(spark, d, "documents"), ["doc_id"]), 2048)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and how many there must be at least."""
    return fill_report(p6_containers(spark, d), 2048)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The maximal runs of places shared with another document in stretches of 100 characters or more."""
    return shared_spans(_table(spark, d, "documents"))


def p7_amounts(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document occurs elsewhere."""
    return shared_amounts(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p2_links, p3_found, p4_found, p4_items, p5_ids, p6_containers, p6_fill, p7_found, p7_amounts)
}

# The counterparts for DuckDB.
RAW_ITEMS = "SELECT 'raw_rows' AS src, row_id AS rec_id, i - 1 AS item_no, prompt[i].content AS text FROM (SELECT row_id, prompt, unnest(range(1, len(prompt) + 1)) AS i FROM raw_rows)"
BASE_ITEMS = "SELECT 'base_examples' AS src, example_id AS rec_id, i - 1 AS item_no, memory_strings[i] AS text FROM (SELECT example_id, memory_strings, unnest(range(1, len(memory_strings) + 1)) AS i FROM base_examples)"
PARAGRAPHS, SENTENCES, SPACES = r"'\n[ \t\r\n]*\n'", r"'[ \t\r\n]+'", r"'[ \t\r\n]+'"
#: Longest part once a text is cut: at paragraphs, then behind full stops (marked first, as there is no look-behind), then at white space.
STOPPED = r"regexp_replace(regexp_replace(x, '([.!?])[ \t\r\n]+', '\1' || chr(57344), 'g'), '([。！？])[ \t\r\n]*', '\1' || chr(57344), 'g')"
P1 = f"""WITH t AS (SELECT DISTINCT * FROM ({RAW_ITEMS} UNION ALL {BASE_ITEMS}) WHERE length(text) > {LIMIT} AND rec_id IS NOT NULL),
p AS (SELECT src, rec_id, item_no, unnest(regexp_split_to_array(text, {PARAGRAPHS})) AS x FROM t),
s AS (SELECT src, rec_id, item_no, max(length(x)) OVER (PARTITION BY src, rec_id, item_no) AS para, unnest(string_split({STOPPED}, chr(57344))) AS y FROM p),
w AS (SELECT src, rec_id, item_no, para, max(length(y)) OVER (PARTITION BY src, rec_id, item_no) AS sent, list_max(list_transform(regexp_split_to_array(y, {SPACES}), lambda z: length(z))) AS word FROM s)
SELECT src, rec_id, item_no, CASE WHEN max(para) <= {LIMIT} THEN 'paragraph' WHEN max(sent) <= {LIMIT} THEN 'sentence' WHEN max(word) <= {LIMIT} THEN 'word' ELSE 'none' END AS cut_at FROM w GROUP BY ALL"""
RECORDS = r"""rec AS (SELECT DISTINCT src, rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (
SELECT 'raw_rows' AS src, row_id AS rec_id, array_to_string(list_filter(list_transform(prompt, lambda m: m.content), lambda c: c IS NOT NULL), chr(10)) AS text FROM raw_rows
UNION ALL SELECT 'base_examples', example_id, array_to_string(list_filter(memory_strings, lambda c: c IS NOT NULL), chr(10)) FROM base_examples) WHERE rec_id IS NOT NULL AND text IS NOT NULL)"""
P2 = f"""WITH {RECORDS}, g AS (SELECT DISTINCT src, rec_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM rec WHERE len(w) >= 20),
n AS (SELECT src, rec_id, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT a.src, a.rec_id AS id_a, b.rec_id AS id_b, count(*) AS k FROM g a JOIN g b ON a.src = b.src AND a.g = b.g AND a.rec_id < b.rec_id GROUP BY ALL)
SELECT c.src, id_a, id_b FROM c JOIN n x ON x.src = c.src AND x.rec_id = id_a JOIN n y ON y.src = c.src AND y.rec_id = id_b WHERE k * 5 >= (x.n + y.n - k) * 3"""
#: Records with the same runs have one number; links are other numbers that are similar.
NUMBERED = f"""WITH pairs AS ({P2}), {RECORDS}, gg AS (SELECT DISTINCT src, rec_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM rec WHERE len(w) >= 20),
sets AS (SELECT src, rec_id, md5(string_agg(g, '|' ORDER BY g)) AS sid FROM gg GROUP BY ALL), copies AS (SELECT src, sid, count(*) - 1 AS n_copies FROM sets GROUP BY ALL),
both_ AS (SELECT src, id_a, id_b FROM pairs UNION ALL SELECT src, id_b, id_a FROM pairs)"""
P2_LINKS = f"""{NUMBERED}, l AS (SELECT x.src, x.rec_id, count(DISTINCT y.sid) AS n FROM both_ b JOIN sets x ON x.src = b.src AND x.rec_id = b.id_a JOIN sets y ON y.src = b.src AND y.rec_id = b.id_b WHERE x.sid <> y.sid GROUP BY ALL)
SELECT s.src, s.rec_id, coalesce(n, 0)::BIGINT AS n_links, n_copies FROM sets s JOIN copies USING (src, sid) LEFT JOIN l ON l.src = s.src AND l.rec_id = s.rec_id"""
P2_GROUPS = f"""{NUMBERED.replace('WITH pairs', 'WITH RECURSIVE pairs', 1)}, reach AS (SELECT src, rec_id, rec_id AS root FROM sets UNION SELECT r.src, b.id_b, r.root FROM reach r JOIN both_ b ON b.src = r.src AND b.id_a = r.rec_id)
SELECT s.src, s.rec_id, min(root) AS group_id, any_value(n_copies) AS n_copies FROM sets s JOIN copies USING (src, sid) JOIN reach r ON r.src = s.src AND r.rec_id = s.rec_id GROUP BY s.src, s.rec_id"""
P4 = rf"""WITH {RECORDS}, g AS (SELECT src, rec_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM rec),
q AS (SELECT item_id, regexp_extract_all(lower(unnest(regexp_extract_all(prompt, '(?s)<\|memory_start\|>(.*?)<\|memory_end\|>', 1))), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark_rows),
r AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM q) SELECT DISTINCT src, rec_id, item_id FROM g JOIN r USING (g)"""
P4_ITEMS = rf"""WITH {RECORDS}, g AS (SELECT src, rec_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM rec),
q AS (SELECT item_id, no, regexp_extract_all(lower(ps[no]), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT item_id, ps, unnest(range(1, len(ps) + 1)) AS no FROM (SELECT item_id, regexp_extract_all(prompt, '(?s)<\|memory_start\|>(.*?)<\|memory_end\|>', 1) AS ps FROM benchmark_rows))),
r AS (SELECT DISTINCT item_id, no, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM q), f AS (SELECT src, rec_id, item_id, count(*) AS n_runs FROM g JOIN r USING (g) GROUP BY ALL),
i AS (SELECT item_id, CASE WHEN contains(prompt, '<|memory_end|>') THEN array_to_string(regexp_extract_all(lower(string_split(prompt, '<|memory_end|>')[-1]), '[\p{{L}}\p{{N}}]+'), ' ') ELSE '' END AS qw,
list_filter(list_transform(coalesce(extra_info.ground_truth.answers, []), lambda a: array_to_string(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}]+'), ' ')), lambda a: a <> '') AS aw FROM benchmark_rows),
x AS (SELECT f.*, qw <> '' AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || qw || ' ') AS q, len(list_filter(aw, lambda a: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || a || ' '))) > 0 AS a FROM f JOIN i USING (item_id) JOIN rec USING (src, rec_id))
SELECT item_id, src, count(*) AS n_records, sum(q::INT)::BIGINT AS n_question, sum(a::INT)::BIGINT AS n_answer, sum(n_runs)::BIGINT AS n_runs FROM x GROUP BY ALL"""
P7_RUNS = """d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE length(text) >= 100 GROUP BY doc_id),
s AS (SELECT doc_id, unnest(range(0, length(text) - 99)) AS a, text FROM d), h AS (SELECT doc_id, a, md5_number(substring(text, a + 1, 100)) AS g FROM s),
m AS (SELECT g FROM h GROUP BY g HAVING min(doc_id) <> max(doc_id)), f AS (SELECT doc_id, a, CASE WHEN a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 100 THEN 1 ELSE 0 END AS new FROM h JOIN m USING (g)),
r AS (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM f), runs AS (SELECT doc_id, min(a) AS first_pos, max(a) + 100 AS end_pos FROM r GROUP BY doc_id, run)"""
P7 = f"WITH {P7_RUNS} SELECT doc_id, first_pos, end_pos FROM runs"
P7_AMOUNTS = f"""WITH {P7_RUNS}, k AS (SELECT doc_id, sum(end_pos - first_pos)::BIGINT AS n_shared, count(*) AS n_spans FROM runs GROUP BY doc_id),
e AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id) SELECT doc_id, n_chars, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_spans, 0)::BIGINT AS n_spans FROM e LEFT JOIN k USING (doc_id)"""
ORACLES: dict[str, str] = {"p1_found": P1, "p2_found": P2, "p2_groups": P2_GROUPS, "p2_links": P2_LINKS, "p4_found": P4, "p4_items": P4_ITEMS, "p7_found": P7, "p7_amounts": P7_AMOUNTS}

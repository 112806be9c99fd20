"""Responses, passages, rounds, scores, telemetry and configuration."""

import random

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import parsing as P
from ctxspark.operators import agent as A
from ctxspark.operators import passages as G
from ctxspark.operators import scoring as S
from ctxspark.operators import telemetry as L
from ctxspark.sources import config
from ctxspark.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("text,action,indices,answer", [
    ("EXPAND: 7, 9", "expand", [6, 8], None), ("ANSWER: x\nEXPAND: 2", "expand", [1], None), ("EXPAND: 2\nANSWER: y", "answer", None, "y"),
    ("ANSWER: a ANSWER: b", "answer", None, "a ANSWER: b"), ("hello", "answer", None, "hello"), ("EXPAND: 99", "expand", [], None), ("answer : z<|im_end|> w", "answer", None, "z"),
])
def test_parse_round(spark, text, action, indices, answer):
    r = one(spark, text, P.parse_round("x", 12))
    assert (r.action, r.indices, r.answer) == (action, indices, answer)


def test_parse_others(spark):
    sel = [one(spark, t, P.parse_selection("x", 5)) for t in ("SELECTED: 3,5,9", "no\n2 and 4", "none")]
    assert sel == [[2, 4], [1, 3], [0]]
    assert one(spark, "maybe 3 or 40 or 1", P.forced_expand("x", 12)) == [0, 2]
    assert one(spark, "unknown", P.forced_expand("x", 12)) == [0]
    assert one(spark, "x", P.even_stride_pick(F.array(F.lit(3).cast("bigint")), F.lit(10), 4)) == [0, 3, 4, 7]
    lines = [tuple(one(spark, t, P.sample_lines("x"))) for t in ("b", "b\nq", "p\nb\nq", "p\nb\nc\nq")]
    assert lines == [("", "b", ""), ("", "b", "q"), ("p", "b", "q"), ("p", "b\nc", "q")]
    assert one(spark, None, P.parse_round("x", 3)).action is None


def test_scores(spark):
    df = spark.createDataFrame([(1, ["Ab", "zz"], "xxabxx"), (2, [], "a"), (3, None, "a"), (4, ["a"], None), (5, [None, "q"], "Q")], "id int, answers array<string>, response string")
    assert [r.s for r in df.orderBy("id").select(P.score_match_all("answers", "response").alias("s")).collect()] == [50.0, 0.0, 0.0, 0.0, 100.0]
    m = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 3.0},)], "metrics map<string,double>")
    assert {r.metric: (r.n_with, r["mean"]) for r in S.metric_aggregate(m, []).collect()} == {"a": (2, 2.0), "b": (1, 2.0), "__n__": (2, 2.0)}


def test_contained_needles(spark):
    texts = spark.createDataFrame([(1, "xABCx"), (2, None), (3, "b")], "id bigint, text string")
    needles = spark.createDataFrame([(7, "abc"), (8, "B"), (9, ""), (10, None), (7, "abc")], "needle_id bigint, needle string")
    want = {(1, 7), (1, 8), (3, 8)}
    assert {tuple(r) for r in S.contained_needles(texts, needles).collect()} == want
    assert {tuple(r) for r in S.contained_needles(texts, needles, at_once=1).collect()} == want
    assert S.contained_needles(texts, needles.limit(0)).count() == 0


def test_chunks_golden(spark):
    df = spark.createDataFrame([(1, "A b c. D e. F g h i j k l. M."), (2, " \n "), (3, "a b."), (4, ""), (5, None)], "id bigint, text string")
    got = {(r.id, r.passage_no): r.passage for r in G.chunk_sentences(df, 7).collect()}
    assert got == {(1, 0): "A b c. D e.", (1, 1): "F g h i j k l.", (1, 2): "M.", (3, 0): "a b."}


def test_chunk_paragraphs_equals_a_loop(spark):
    import re

    def sents(t, size):
        out, cur, n = [], [], 0
        for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", t):
            k = G.python_tokens(s)
            if cur and n + k > size:
                out.append(" ".join(cur))
                cur, n = [], 0
            cur.append(s)
            n += k
        return out + ([" ".join(cur)] if cur else [])

    def plain(t, size):
        if not t.strip():
            return []
        if G.python_tokens(t) <= size:
            return [t]
        out, cur, n = [], [], 0
        for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", t):
            if not p.strip():
                continue
            k = G.python_tokens(p)
            if cur and (k > size or n + k > size):
                out.append("\n\n".join(cur))
                cur, n = [], 0
            if k > size:
                out += sents(p, size)
            else:
                cur.append(p)
                n += k
        return [x for x in out + (["\n\n".join(cur)] if cur else []) if x.strip()]

    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(["word ", "x. ", "y! ", "\n\n", "\n \n", "zz"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    got = {}
    for r in G.chunk_paragraphs(spark.createDataFrame(texts, "id bigint, text string"), 12).collect():
        got[r.id, r.passage_no] = r.passage
    assert got == {(i, k): p for i, t in texts for k, p in enumerate(plain(t, 12))}


def samples(spark):
    return spark.createDataFrame([(1, "p", ["aa", "bb", "cc"], "q?"), (2, "", ["one"], "q"), (3, "p", [], "q")], "id bigint, prefix string, passages array<string>, question string")


def result(df):
    return {r.id: (r.n_rounds, r.opened, r.response, [s.action for s in r.steps]) for r in df.collect()}


@pytest.mark.parametrize("loop", [A.agent_loop, A.agent_loop_chat])
def test_rounds(spark, loop):
    say = lambda text: lambda prompt, n: F.lit(text)
    assert result(loop(samples(spark), say("ANSWER: 2 it is"), 5))[1] == (2, [2], "2 it is", ["answer_demoted_to_expand", "answer"])
    assert result(loop(samples(spark), say("EXPAND: 2"), 5))[1] == (3, [2], "EXPAND: 2", ["expand", "expand", "forced_answer"])
    assert result(loop(samples(spark), say("EXPAND: 1, 3"), 1))[1] == (2, [], "EXPAND: 1, 3", ["expand", "forced_answer"])
    echo = result(loop(samples(spark)))
    assert echo[1][3] == ["expand", "answer"] and 3 not in echo


def test_steps_have_stats(spark):
    steps = A.agent_loop(samples(spark)).where("id = 1").collect()[0]
    assert steps.answer_stats == steps.steps[-1].stats and all(x.stats.compressed >= x.stats.uncompressed > 0 for x in steps.steps)  # passages of one token are a latent each
    long = spark.createDataFrame([(1, "", ["word " * 100, "b"], "q")], "id bigint, prefix string, passages array<string>, question string")
    s = A.agent_loop(long).collect()[0].steps[0].stats
    assert s.uncompressed - s.compressed == 100 - 7 and s.savings_pct == round((1 - s.compressed / s.uncompressed) * 100, 1)


def test_rounds_end_when_all_are_done(spark):
    """As many rounds are run as the longest sample needs."""
    asked = []

    def responder(prompt, n):
        asked.append(1)
        return A.echo_responder(prompt, n)

    A.agent_loop(samples(spark), responder, 50).collect()
    assert len(asked) <= 4


def test_run_samples(spark):
    rows = [(1, "vt", "head\nbody one. two.\nq?", ["one", "x"]), (2, "niah", "head\nThe key is 42. " + "More words here. " * 200 + "\nq?", ["42"]), (3, "niah", "only\n\nq", []), (4, None, "h\nbody\nq", None)]
    df = spark.createDataFrame(rows, "id bigint, subtask string, input string, outputs array<string>")
    say = lambda prompt, n: F.lit("ANSWER: 42 and one, see 1")
    got = {r.id: r for r in A.run_samples(df, F.when(F.col("subtask") == "vt", "compressed").otherwise("agent"), say).collect()}
    assert sorted(got) == [1, 2, 4]  # a blank body has no passages
    assert (got[1].flow, got[1].n_passages, got[1].n_rounds, got[1].opened, got[1].metrics["score"]) == ("compressed", 1, 0, [], 50.0)
    assert (got[2].flow, got[2].n_passages > 1, got[2].n_rounds, got[2].opened, got[2].response, got[2].metrics["score"], got[2].expected) == ("agent", True, 2, [1], "42 and one, see 1", 100.0, ["42"])
    assert [x.action for x in got[2].steps] == ["answer_demoted_to_expand", "answer"] and got[4].metrics["score"] == 0.0


def test_hot_run(spark):
    """Steps of one run in many ranges, a null run beside it: throughput and running losses equal plain loops."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + [None]), i, 0, rng.choice([None, float("nan"), rng.random()]), 1, 2, i + rng.random() * 3) for i in range(900)]
    steps = L.per_step(L.once(spark.createDataFrame(rows, "run_name string, step bigint, rank int, loss double, memory_tokens bigint, decoder_tokens bigint, t_sec double")))
    dt, mean = {}, {}
    for run in ("hot", None):
        mine = [r for r in rows if r[0] == run]
        dt |= {(run, b[1]): b[6] - a[6] for a, b in zip(mine, mine[1:])}
        losses = [(r[1], r[3]) for r in mine if r[3] is not None and r[3] == r[3]]
        mean |= {(run, s): sum(x for _, x in losses[max(0, i - 99) : i + 1]) / min(i + 1, 100) for i, (s, _) in enumerate(losses)}
    got = {(r.run_name, r.step): r.dt for r in L.throughput(steps).collect()}
    assert got.keys() == dt.keys() and all(abs(got[k] - dt[k]) < 1e-9 for k in dt)
    got = {(r.run_name, r.step): r.running for r in L.running_loss(steps).collect()}
    assert got.keys() == mean.keys() and all(abs(got[k] - mean[k]) < 1e-9 for k in mean)


def test_append_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None), (None, None)], "k bigint, v string")
    path, summary = f"file://{tmp_path}/out", f"file://{tmp_path}/summary"
    for _ in range(3):
        assert files.append_missing(df, path, ["k", "v"], summary)
    assert spark.read.parquet(path).count() == 3
    files.write_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 8.0)], "task string, score double"), summary)
    assert not files.append_missing(df.withColumn("k", F.lit(9).cast("bigint")), path, ["k", "v"], summary) and spark.read.parquet(path).count() == 3
    assert {(r.task, r.n, r["mean"], r.is_overall) for r in spark.read.json(summary).collect()} == {("a", 2, 2.0, False), (None, 1, 8.0, False), (None, 3, 5.0, True)}


@pytest.mark.parametrize("nested,several,single,want", [(["a"], ["b"], "c", ["a"]), ([], ["b"], "c", ["c"]), (None, ["b"], "", ["b"]), (None, None, None, []), ([], [], None, [])])
def test_answers_of(spark, nested, several, single, want):
    df = spark.createDataFrame([(nested, several, single)], "n array<string>, s array<string>, o string")
    assert df.select(files.answers_of(F.col("n"), F.col("s"), F.col("o")).alias("a")).collect()[0].a == want


def test_resume_warnings(spark):
    from ctxspark.operators import order as O

    fs = spark.createDataFrame([(f"f{i}",) for i in range(5)], "file_path string")
    first = O.file_shuffle(fs).where("file_ord = 2").select(F.col("file_path").alias("current_file"), "file_ord")
    saved = O.fingerprint(fs, 1, 2).crossJoin(first)
    assert O.resume_warnings(saved, fs, 1, 2).count() == 0
    assert {r.what for r in O.resume_warnings(saved, fs.where("file_path <> 'f0'"), 1, 2).collect()} >= {"fingerprint", "number of files"}
    assert {r.what for r in O.resume_warnings(saved.withColumn("current_file", F.lit("gone")), fs, 1, 2).collect()} == {"current file"}


def test_streams(spark, tmp_path):
    """Several batches carry the open packs of shards on, the null one apart from the empty name; a stop ends between batches and a new start goes on."""
    from ctxspark.operators import packing
    from ctxspark.streaming import jobs as J

    rng = random.Random(8)
    schema = "shard string, ord string, id bigint, n bigint"
    rows = []
    for b in range(4):
        part = [(rng.choice(["a", "", None]), f"{b}-{rng.randrange(9)}", b * 100 + i, rng.choice([0, 3, 50, 99, 101, None])) for i in range(40)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        rows += part
    items = J.stream_scan(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema)
    J.run_to_file(J.stream_pack(items, 100), f"file://{tmp_path}/out", f"file://{tmp_path}/place")
    got = {tuple(r) for r in spark.read.schema(J.PACKED).parquet(f"file://{tmp_path}/out").collect()}
    want = {tuple(r) for r in packing.pack_next_fit(spark.createDataFrame(rows, schema), 100).collect()}
    assert got == want and {None, "", "a"} == {r[0] for r in got}
    seen = []
    each = lambda df, i: seen.append(sorted(r.id for r in df.collect()))
    assert J.run_batches(items, each, f"file://{tmp_path}/stop", "append", stop=lambda: len(seen) == 2) == 2
    assert J.run_batches(items, each, f"file://{tmp_path}/stop", "append") == 2
    assert sorted(i for s in seen for i in s) == sorted(r[2] for r in rows)
    with pytest.raises(Exception, match="own error"):
        J.run_batches(items, lambda df, i: (_ for _ in ()).throw(ValueError("own error")), f"file://{tmp_path}/error", "append")


def test_late_rows_leave(spark, tmp_path):
    from datetime import datetime, timedelta

    from ctxspark.streaming import jobs as J

    t0, schema = datetime(2024, 1, 10), "run_name string, logged_at timestamp_ntz, decoder_tokens bigint"
    for days in (0, 3, -5, 1):  # in order of arrival
        spark.createDataFrame([("r", t0 + timedelta(days=days), 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    log = J.stream_scan(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema)
    J.run_windows(J.step_windows(log, late="1 day"), f"file://{tmp_path}/out", f"file://{tmp_path}/place")
    assert {r.window_start.day for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {10, 13}


def test_names_and_numbers():
    assert config.short_run_name("x/Qwen3-Embedding-0.6B-v2", "y/Qwen3-4B-Instruct-2507") == "Qwen3-Embedding-0.6B-Qwen3-4B-Instruct"
    assert config.parse_betas(" 0.9, 0.999 ") == (0.9, 0.999)
    for bad in ("0.9", "a,b", "", None):
        with pytest.raises(ValueError):
            config.parse_betas(bad)
    assert [config.shard_sizes(n, 4) for n in (0, 1, 8, 9)] == [(0, 0), (1, 3), (2, 0), (3, 3)]


def test_telemetry(spark):
    log = spark.createDataFrame([("r", i, 0, float(i), 1, 1, float(i)) for i in range(1, 151)] + [("r", 151, 0, float("nan"), None, 1, 151.0)] * 2, "run_name string, step bigint, rank int, loss double, memory_tokens bigint, decoder_tokens bigint, t_sec double")
    steps = L.per_step(L.once(log))
    running = {r.step: r.running for r in L.running_loss(steps).collect()}
    assert running[150] == 100.5 and 151 not in running
    assert [r.step for r in steps.where("is_bad").collect()] == [151]
    assert {r.step for r in L.skipped(steps, "24-26,40").collect()} == {24, 25, 26, 40}
    assert L.skipped(steps, "", anti=True).count() == 151
    lr = spark.createDataFrame([(s,) for s in (5, 10, 60, 110, 111)], "s bigint").select(L.learning_rate(F.col("s"), 1.0, 10, 110).alias("l")).collect()
    assert [round(r.l, 6) for r in lr] == [0.5, 1.0, 0.5, 0.0, 0.0]
    names = spark.createDataFrame([("r", n) for n in ("stage1_step_100", "stage1_step_90", "stage1_final")], "run_name string, name string")
    assert {(r.name, r.keep) for r in L.retain_latest(names, 1).collect()} == {("stage1_step_100", True), ("stage1_step_90", False)}


def test_config(tmp_path):
    shape = config.Shape(overlap=256, bidirectional=False)
    assert config.experiment_name("X/E", "Y/D", shape) == "E-D-cs16-w1024-mean-mlp-ov256-causal"
    assert config.experiment_name("X/E", "Y/D", config.Shape(overlap=0)) == "E-D-cs16-w1024-mean-mlp"
    for bad in ({"window": 1000}, {"pooling": "max"}):
        with pytest.raises(ValueError):
            config.Shape(**bad)
    path = tmp_path / "c.yaml"
    path.write_text("models: {lr: 1}\ndata: {a: [x, y], b: false, c: true}\nstages: {two: {lr: 2}}\n")
    assert config.to_argv(config.load_yaml(str(path), "two")) == ["--lr", "2", "--a", "x", "y", "--c"]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"prompt": "p", "k": 1}\n\n{"prompt": [{"role": "user", "content": "c"}], "k": "two"}\n')
    rows = sorted(files.read_jsonl(spark, str(path)).select("prompt", "messages", F.expr("variant_get(meta, '$.k', 'string')").alias("k")).collect(), key=lambda r: r.k)
    assert (rows[0].prompt, rows[0].messages, rows[0].k) == ("p", None, "1")
    assert rows[1].prompt is None and rows[1].messages[0].content == "c"

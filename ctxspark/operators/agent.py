"""The rounds of opening passages and answering, over a table of samples.

All samples take a round together: one projection makes prompts, asks the responder and reads its directive. Passages are written once; a round's
table holds what changes (what is open, what was said) of the samples that are not done, so a lost executor costs one round at most and the
rounds end when every sample has ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import parsing as P
from ctxspark.functions import text as T
from ctxspark.operators import passages as G
from ctxspark.plans.stage import written

#: Takes the prompt and the number of passages, gives the response. A model is a vectorised UDF with this shape.
Responder = Callable[[Column, Column], Column]
#: Takes the true answers and the response, gives a score.
Scorer = Callable[[Column, Column], Column]

STATS = "struct<compressed:bigint,uncompressed:bigint,savings_pct:double>"
STEP = f"struct<round:int,action:string,indices:array<bigint>,answer:string,raw:string,n_opened:int,stats:{STATS}>"
TURN = "struct<raw:string,new:array<bigint>,left:int>"
OPENED = r"(?s)\[(?:Open passages|Opened)\]\n(?:Passage \d+:\n)?(.{0,40})"
ASK = "No rounds are left: write `ANSWER: <answer>` now."


def echo_responder(prompt: Column, n: Column) -> Column:
    """A deterministic stand-in: opens two passages the prompt's length picks, then answers with what the first open one begins with."""
    text = F.regexp_extract(prompt, OPENED, 1)
    pick = F.length(prompt) % n
    return F.when(text != "", F.concat(F.lit("ANSWER: "), text)).otherwise(F.concat(F.lit("EXPAND: "), pick + 1, F.lit(", "), (pick + 1) % n + 1))


def prompt_stats(prompt: Column, ratio: int = C.RATIO) -> Column:
    """Struct (compressed, uncompressed, savings_pct) of a prompt: its tokens with latents, those with the regions' text, what is saved in percent."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    real = total(F.transform(T.outside_parts(prompt), T.n_tokens)) + 2 * F.size(T.regions(prompt))
    short, long = real + total(T.region_latents(prompt, ratio)), real + total(F.transform(T.regions(prompt), T.n_embed_tokens))
    return F.struct(short.alias("compressed"), long.alias("uncompressed"), F.when(long > 0, F.round((1 - short / long) * 100, 1)).otherwise(F.lit(0.0)).alias("savings_pct"))


def _fresh() -> dict[str, Column]:
    none = F.array().cast("array<bigint>")
    return {"opened": none, "done": F.lit(False), "response": F.lit(None).cast("string"), "steps": F.array().cast(f"array<{STEP}>"), "turns": F.array().cast(f"array<{TURN}>")}


STATE = ["id", "n", "opened", "done", "response", "steps", "turns"]


def _step(action: Column, indices: Column, answer: Column) -> Column:
    return F.struct((F.size("steps") + 1).alias("round"), action.alias("action"), indices.alias("indices"), answer.alias("answer"), F.col("raw").alias("raw"), F.size("opened").alias("n_opened"), F.col("stats").alias("stats")).cast(STEP)


def _advance(state: DataFrame, prompt: Column, responder: Responder, left: int) -> DataFrame:
    """One round of samples that aren't done."""
    s = state.withColumn("prompt", prompt)
    s = s.withColumns({"raw": P.clean_response(responder(F.col("prompt"), F.col("n"))), "stats": prompt_stats(F.col("prompt"))}).withColumn("p", P.parse_round("raw", F.col("n")))
    s = s.withColumn("demoted", (F.col("p.action") == "answer") & (F.size("opened") == 0))
    none = F.array().cast("array<bigint>")
    s = s.withColumn("asked", F.when(F.col("demoted"), P.forced_expand("raw", F.col("n"))).otherwise(F.coalesce("p.indices", none)))
    s = s.withColumn("new", F.array_except("asked", F.col("opened")))
    answered = ~F.col("demoted") & (F.col("p.action") == "answer")
    stuck = ~answered & ~F.col("demoted") & ((F.size("new") == 0) | F.lit(left == 0))
    step = _step(F.when(F.col("demoted"), "answer_demoted_to_expand").otherwise(F.col("p.action")), F.when(F.col("demoted"), F.col("asked")).otherwise(F.col("p.indices")), F.col("p.answer"))
    opens = ~answered & ~stuck
    new = F.when(opens, F.col("new")).otherwise(none)
    return s.select(
        "id", "n", F.when(opens, F.array_sort(F.array_union("opened", "new"))).otherwise(F.col("opened")).alias("opened"), (answered | stuck).alias("done"), F.when(answered, F.col("p.answer")).alias("response"),
        F.concat("steps", F.array(step)).alias("steps"), F.concat("turns", F.array(F.struct(F.coalesce("raw", F.lit("")).alias("raw"), new.alias("new"), F.lit(left).alias("left")).cast(TURN))).alias("turns"),
    )


def _force(state: DataFrame, prompt: Column, responder: Responder) -> DataFrame:
    """Asks samples without an answer for one."""
    s = state.withColumn("prompt", prompt)
    s = s.withColumns({"raw": P.clean_response(responder(F.col("prompt"), F.col("n"))), "stats": prompt_stats(F.col("prompt"))}).withColumn("p", P.parse_round("raw", F.col("n")))
    answer = F.coalesce("p.answer", "raw")
    step = _step(F.lit("forced_answer"), F.lit(None).cast("array<bigint>"), answer)
    return s.select("id", "n", "opened", F.lit(True).alias("done"), answer.alias("response"), F.concat("steps", F.array(step)).alias("steps"), "turns")


def _loop(samples: DataFrame, prompt: Callable[[int], Column], last: Column, responder: Responder, rounds: int) -> DataFrame:
    """All rounds; ``prompt`` gives the prompt by the rounds left, ``last`` is that of the forced answer."""
    base = written(samples.select("id", "prefix", "passages", "question", F.size("passages").alias("n")).where("n > 0"), "agent-samples")
    state = base.withColumns(_fresh())
    done = []
    for r in range(rounds):
        left = rounds - r - 1
        now = written(_advance(state, prompt(left), responder, left), "agent")
        done.append(now.where("done"))
        going = now.where("not done")
        state = base.join(going.drop("n"), "id")
        if going.isEmpty():
            break
    out = state.select(*STATE)
    for d in done:
        out = out.unionByName(d.select(*STATE))
    answered, open_ = out.where("response is not null"), base.join(out.where("response is null").drop("n"), "id")
    every = answered.unionByName(_force(open_, last, responder))
    return every.select("id", F.col("n").alias("n_passages"), F.size("steps").alias("n_rounds"), F.transform("opened", lambda i: i + 1).alias("opened"), "response", F.element_at("steps", -1)["stats"].alias("answer_stats"), "steps")


def agent_loop(samples: DataFrame, responder: Responder = echo_responder, rounds: int = 5) -> DataFrame:
    """(id, n_passages, n_rounds, opened, response, answer_stats, steps) of samples (id, prefix, passages, question).

    Each round's prompt is built anew. An answer before any passage is open opens those it names instead; asking for nothing
    new, or in the last round, leads to a forced answer. ``opened`` is 1-based. Samples without passages have no row. A step has the round's number, action, indices,
    answer, raw response, number of passages open before it and the prompt's ``stats``; ``answer_stats`` are those of the answer.
    """
    prompt = lambda left: G.prompt_round(F.col("prefix"), F.col("passages"), F.col("opened"), F.col("question"), F.lit(left))
    return _loop(samples, prompt, F.concat(prompt(0), F.lit("\n\n" + ASK)), responder, rounds)


def agent_loop_chat(samples: DataFrame, responder: Responder = echo_responder, rounds: int = 5) -> DataFrame:
    """The same as a growing conversation: regions only in the first user message, opened passages as later ones. Messages are made of the turns when they are needed."""

    def turn(t: Column) -> Column:
        said = F.struct(F.lit("assistant").alias("role"), t["raw"].alias("content"))
        told = F.struct(F.lit("user").alias("role"), G.tool_result(F.col("passages"), t["new"], t["left"]).alias("content"))
        return F.when(F.size(t["new"]) > 0, F.array(said, told)).otherwise(F.array(said))

    messages = F.concat(G.chat_init(F.col("prefix"), F.col("passages"), F.col("question"), rounds), F.flatten(F.transform("turns", turn)))
    ask = F.array(F.struct(F.lit("user").alias("role"), F.lit(ASK).alias("content")))
    return _loop(samples, lambda left: T.render_chat(messages), T.render_chat(F.concat(messages, ask)), responder, rounds)


def run_samples(samples: DataFrame, flow: Column, responder: Responder = echo_responder, rounds: int = 5, size: int = 450, scorer: Scorer = P.score_match_all) -> DataFrame:
    """(id, subtask, flow, n_passages, n_rounds, opened, steps, response, expected, metrics, answer_stats) of samples (id, subtask, input, outputs): prefix, body and question are the input's lines.

    ``flow`` is ``compressed``, one region and one answer, or ``agent``, passages and rounds; a sample whose body has no passages has no row in the latter. ``metrics`` is a map with the ``score``
    of the response against ``outputs``, the ``expected`` answers.
    """
    p = written(samples.select("id", "subtask", "outputs", flow.alias("flow"), P.sample_lines("input").alias("l")).select("id", "subtask", "outputs", "flow", "l.*"), "samples")
    none = F.array().cast("array<bigint>")
    whole = p.where("flow = 'compressed'").withColumn("prompt", G.prompt_single_block(F.col("prefix"), F.col("body"), F.col("question")))
    whole = whole.select("id", F.lit(1).alias("n_passages"), F.lit(0).alias("n_rounds"), none.alias("opened"), P.clean_response(responder(F.col("prompt"), F.lit(1))).alias("response"), prompt_stats(F.col("prompt")).cast(STATS).alias("answer_stats"), F.array().cast(f"array<{STEP}>").alias("steps"))
    ours = p.where("flow = 'agent'")
    cut = G.passages_of(G.chunk_sentences(ours.select("id", F.col("body").alias("text")), size))
    loop = agent_loop(ours.select("id", "prefix", "question").join(cut, "id"), responder, rounds)
    results = whole.unionByName(loop).join(p.select("id", "subtask", "flow", F.col("outputs").alias("expected")), "id")
    metrics = F.create_map(F.lit("score"), scorer(F.col("expected"), F.col("response")))
    return results.select("id", "subtask", "flow", "n_passages", "n_rounds", "opened", "steps", "response", "expected", metrics.alias("metrics"), "answer_stats")

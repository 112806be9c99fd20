"""Operators on training data against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import bpe, chunk, fill, leaks, near, pairs, spans
from ctxspark.plans import stage

WORD = re.compile(r"[^\W_]+")
TEXTS = "src string, rec_id bigint, text string"
VOCABULARY = Path(bpe.FOLDER) / "byte_bpe_50k.tiktoken"


def clashing(df):
    """The same rows with columns whose names operators use inside, null here and there."""
    names = [c for c in ("n", "sid", "tid", "bucket", "runs", "a", "b", "shared", "piece", "pos", "last", "grp", "kind", "defect", "ids", "container") if c not in df.columns]
    return df.withColumns({c: F.when(F.rand(1) > 0.5, F.lit("x")) for c in names})


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(60)) for _ in range(n))


# splitting


def brute_level(text, limit):
    para = re.split(r"\n[ \t\r\n]*\n", text)
    if max(map(len, para)) <= limit:
        return "paragraph"
    sent = [s for p in para for s in re.split(r"(?<=[.!?])[ \t\r\n]+|(?<=[。！？])[ \t\r\n]*", p)]
    if max(map(len, sent)) <= limit:
        return "sentence"
    return "word" if max(len(w) for s in sent for w in re.split(r"[ \t\r\n]+", s)) <= limit else "none"


def test_split_items(spark):
    rng = random.Random(1)
    bits = ["a", "bc", ". ", "。", "\n\n", " ", "\n \n# x ", "x" * 30, " " * 90, "é🙂", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(150)] + ["", None, " " * 500, "y" * 1000]
    rows = [("s", i, 0, t) for i, t in enumerate(texts)]
    items = clashing(spark.createDataFrame(rows + rows[:3], "src string, rec_id bigint, item_no bigint, text string"))
    got = {}
    for r in chunk.split_items(items, 80, 20).distinct().collect():
        got.setdefault(r.rec_id, []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 80}
    for i, found in got.items():
        found.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in found] == list(range(len(found)))
        assert "".join(r.piece[r.n_repeated :] for r in found) == texts[i]
        assert all(len(r.piece) <= 80 and 0 <= r.n_repeated <= 20 and texts[i].startswith(r.piece, r.first) for r in found)
        assert {r.cut_at for r in found} == {brute_level(texts[i], 80)}
    assert chunk.split_items(items.limit(0), 80, 20).count() == 0
    with pytest.raises(ValueError):
        chunk.split_items(items, 80, 80)


def test_long_runs_of_white_space():
    import time

    t = time.time()
    for blank in ("\n" * 1_000_000, " \n" * 500_000, ". " * 500_000, "。" * 300_000):
        got, level = chunk.pieces("a" + blank + "b", 3000, 200)
        assert all(e - s <= 3000 for s, e, _ in got)
    assert time.time() - t < 20


def test_signs_stay_together():
    family = "\U0001F468\u200d\U0001F469\u200d\U0001F467"
    text = "".join(random.Random(2).choice(["e\u0301\u0323", family, "x"]) for _ in range(300))
    got, level = chunk.pieces(text, 40, 10)
    assert level == "none" and "".join(text[new:e] for _, e, new in got) == text
    import regex

    edges = {m.end() for m in regex.finditer(r"\X", text)}
    assert all(e in edges and e - s <= 40 for s, e, _ in got)


def test_items_of_tables(spark):
    raw = spark.createDataFrame([(1, [("u", "x" * 9), (None, None), ("u", "y")], "t"), (2, None, None), (3, [], ""), (None, [("u", "z" * 9)], "")], "row_id bigint, prompt array<struct<role:string,content:string>>, target string")
    assert [(r.rec_id, r.item_no, len(r.text)) for r in chunk.split_items(chunk.raw_items(raw, 5).withColumn("text", F.col("text")), 5, 1).groupBy("rec_id", "item_no").agg(F.max("piece").alias("text")).collect()] == [(1, 0, 5)]
    base = spark.createDataFrame([(1, ["a", None, "b" * 7]), (2, None), (3, [])], "example_id bigint, memory_strings array<string>")
    assert {(r.rec_id, r.item_no) for r in chunk.split_items(chunk.base_items(base, 5), 5, 1).collect()} == {(1, 2)}


# near-duplicates


def runs(text, k):
    w = WORD.findall(text.lower())
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset(), len(w)


def brute_pairs(rows, k, t, least):
    sets = {}
    for src, i, text in rows:
        if i is None or text is None:
            continue
        s, n = runs(text, k)
        if n >= least and s:
            sets[src, i] = s
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for x, a in enumerate(keys) for b in keys[x + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(0, 160, 4):
        text = sentence(rng, rng.choice([8, 22, 40, 90]))
        for j in range(4):
            w = text.split(" ")
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 2])] = [sentence(rng, 1)]
            rows.append((rng.choice("ab"), i + j, " ".join(w)))
    same = sentence(rng, 30)
    rows += [("a", 1000 + i, same.upper() if i % 2 else same + " !") for i in range(12)]  # copies but for case and signs
    return rows + [("a", 2000, None), ("a", 2001, ""), ("a", None, same), ("b", 2002, "one two"), ("b", 2003, "same " * 500), ("b", 2004, "same " * 400)] + rows[:5]


@pytest.mark.parametrize("k,t_num,t_den,least", [(3, 3, 5, 20), (5, 4, 5, 0), (1, 1, 2, 5), (2, 1, 4, 0)])
def test_similar_records(spark, k, t_num, t_den, least):
    rows = near_rows(k)
    df = clashing(spark.createDataFrame(rows, TEXTS))
    got = {tuple(r) for r in near.similar_records(df, k=k, t_num=t_num, t_den=t_den, least_words=least).collect()}
    assert got == brute_pairs(rows, k, t_num / t_den, least)


def test_similar_groups(spark):
    rows = near_rows(9)
    want = brute_pairs(rows, 3, 0.6, 20)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, a, b in want:
        root[max(find((s, a)), find((s, b)))] = min(find((s, a)), find((s, b)))
    groups = near.similar_groups(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5, least_words=20).collect()
    assert {(r.src, r.rec_id): r.group_id for r in groups if (r.src, r.rec_id) in root} == {k: find(k)[1] for k in root}
    assert all(r.group_id == r.rec_id for r in groups if (r.src, r.rec_id) not in root)
    assert near.similar_groups(spark.createDataFrame([], TEXTS)).count() == 0
    sets = {(s, i): runs(t, 3)[0] for s, i, t in rows if i is not None and t and runs(t, 3)[1] >= 20}
    linked = {}
    for s, a, b in want:
        if sets[s, a] != sets[s, b]:
            linked.setdefault((s, a), set()).add(sets[s, b])
            linked.setdefault((s, b), set()).add(sets[s, a])
    links = near.similar_links(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5, least_words=20).collect()
    assert {(r.src, r.rec_id): r.n_links for r in links} == {k: len(linked.get(k, ())) for k in sets}
    assert {(r.src, r.rec_id): r.n_copies for r in links} == {(r.src, r.rec_id): r.n_copies for r in groups}


def test_no_hot_signature():
    """20,000 random sets of one size: no signature of the index or the probes has a hundredth of the sets."""
    rng = np.random.default_rng(5)
    n, size = 20_000, 18
    sid, h = rng.integers(1, 1 << 62, n).astype(np.uint64), rng.integers(0, 1 << 63, n * size).astype(np.uint64)
    needy = 0
    for kind, sig, of in near.signatures(sid, np.full(n, size), h, near.bands(4, 1.25), np.ones(1 << near.SKETCH_BITS, np.int32), 3, 5):
        if kind == near.NEEDY:
            needy += len(of)
        else:
            assert np.unique(sig, return_counts=True)[1].max(initial=0) < n / 100
    assert needy < n


def test_group_of_many_edits_costs_few_pairs(spark):
    """Sets that are all similar hang together after the first step, so no pair within them is looked at in the second."""
    rng = random.Random(6)
    text = sentence(rng, 80).split(" ")
    rows = []
    for i in range(120):
        w = list(text)
        w[rng.randrange(80)] = f"edit{i}"
        rows.append(("a", i, " ".join(w)))
    s = near.Search(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5)
    links = s.candidates(star=True)
    assert links.count() < 120 * 118 / 4
    labels = s.sets.select("sid", F.lit(1).cast("bigint").alias("label"))
    assert s.candidates(labels).count() == 0
    assert {r.group_id for r in near.similar_groups(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5).collect()} == {0}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_levels_reach_what_is_needed():
    rng = np.random.default_rng(2)
    rec = np.repeat(np.arange(5), 6)
    count = rng.integers(0, 4, 30)
    need = np.array([1, 3, 5, 8, 12])
    level, needy = near.choose_levels(rec, count, rng.integers(1, 9, 30), rng.integers(1, 9, 30), need, 5)
    assert np.bincount(rec, weights=level).tolist() == np.where(needy, 0, need).tolist()
    assert (level <= np.minimum(count, 2)).all() and needy.tolist() == (np.bincount(rec, weights=np.minimum(count, 2)) < need).tolist()


# defective pairs

PAIRS = [
    ("What is the number for Ann?", None, "empty"), ("What is the number for Ann?", "<|im_end|>\n", "empty"), ("What is it?", "***", "empty"),
    ("What is the number for Ann?", "I cannot answer questions about Ann.", "refusal"), ("¿Cuál es el número de Ana?", "Prefiero no responder a esta pregunta.", "refusal"),
    ("What is it?", "I am unable to fault the count. Ann holds 33 notes, while Bob holds 4.", None), ("Where is the thing of Ann?", 'It is in Rome. The clerk wrote "I cannot help with that" in the margin.', None),
    ("Where is the big red thing of Ann?", "Where is the big red thing of Ann?", "copy"), ("Where is the big red thing of Ann?", "WHERE IS BIG RED THING OF ANN", "copy"),
    ("Where is the big red thing of Ann?", 'You asked: "Where is the big red thing of Ann?" It is kept at Rome with 33 spoons.', None), ("Does Ann or Bob keep the first red thing?", "Bob", None),
    ("<|memory_start|>the text of old<|memory_end|>\nWhere did they store the things of Ann?", "Sie wurden neben der Brücke von Rom gelagert, nicht weit von Ann.", "language"),
    ("Where did they store the things of Ann? Please answer in German.", "Sie wurden neben der Brücke von Rom gelagert, nicht weit von Ann.", None),
    ("Where did they store the things of Ann?", "They were stored beside the bridge. By week 33 the clerk had", "truncated"), ("List 3 findings about Ann.", "- Rome town, 3 things\n- Oslo town, 4 things\n- Ber", "truncated"),
    ("List 2 findings about Ann.", "- Rome town, 3 things\n- Oslo town, 4 things", None), ("Return JSON with the things of Ann.", '{"a": 1, "b": "c', "truncated"), ("Return JSON with the things of Ann.", '{"a": 1}', None),
    ("Write a function for Ann.", "Here: ```python\ndef f(x):\n    return x + [", "truncated"), ("Write a function for Ann.", "```python\ndef f(x):\n    return x\n```", None), ("Where is it kept now?", "in the third week", None), ("", "It is here.", None), (None, None, "empty"),
]


def test_defective_pairs(spark):
    schema = "row_id bigint, prompt array<struct<role:string,content:string>>, target string"
    rows = [(i, [("system", "Be brief."), ("user", q)], t) for i, (q, t, _) in enumerate(PAIRS)]
    more = [(900, None, None), (901, [], "x"), (902, [("user", "q")], "NA_string_only"), (None, [("user", "q")], None), (903, [(None, None)], None), (904, [("user", "What is the word? " * 3000)], "I see a word. " * 20000 + "and")]
    df = spark.createDataFrame(rows + rows[:2] + more, schema).withColumn("defect", F.lit(1)).withColumn("last", F.lit(None).cast("string"))
    got = {r.row_id: r.defect for r in pairs.defective_pairs(df).collect()}
    want = {i: d for i, (_, _, d) in enumerate(PAIRS) if d} | {903: "empty", 904: "truncated"}
    assert got == want
    assert pairs.defective_pairs(df.limit(0)).count() == 0


#: Phrases that stand in none of the operators' lists.
REFUSED = """I refuse.|I can't discuss that topic.|I'm not comfortable sharing that information.|I am afraid I won't be able to answer this.|We are not able to provide this information at this time.
That falls outside what I'm permitted to talk about.|I'd rather not say anything about Ann.|Sorry, but I can't do that.|As an AI, I cannot give opinions on this matter. Please consult an expert.|My policy prevents me from answering.
Dabei kann ich Ihnen leider nicht weiterhelfen.|Lo siento, no puedo responder a eso.|Me temo que no puedo darte esa información.|Mi dispiace, ma non posso aiutarti con questo.|Non sono autorizzato a rispondere.
Je suis désolé, mais je ne peux pas répondre à cela.|Het spijt me, daar kan ik niet op antwoorden.|Przykro mi, nie mogę na to odpowiedzieć.|Tyvärr kan jag inte svara på det.|Não posso dizer nada sobre isso.|申し訳ありませんが、お答えできません。"""
ANSWERED = """I can't say it better than the text: Ann holds 33 boxes.|The clerk refused to answer and left.|No, it was not given to Bob.|Ann did not help Bob with the crates.|I counted them twice and could not find more than 33.
The answer is not given in the passage, but Ann holds 33 of them.|Nicht weit von Ann, neben der Brücke.|No se sabe cuándo llegó el barco.|We measured the queue and it held 44 rows, which we did not report.|He said "I can't tell you" and closed the gate."""
FOREIGN = """De kisten stonden naast de oude brug van Rome.|Skrzynie stały obok starego mostu, nie w mieście.|Lådorna stod bredvid den gamla bron i Rom.|Le casse erano vicino al vecchio ponte di Roma.|Kasserne stod ved siden af den gamle bro i Rom.
A ládák a régi híd mellett voltak, és nem a városban.|Laatikot olivat vanhan sillan vieressä, ja ne on jo siirretty.|Kutular eski köprünün yanındaydı ve çok ağırdı.|Kotak-kotak itu berada di dekat jembatan tua dan tidak di kota.|Cutiile erau lângă podul vechi și nu în oraș.|箱は古い橋のそばにありました。|상자는 오래된 다리 옆에 있었다."""


def test_held_out_refusals_and_languages():
    split = lambda t: [x for line in t.split("\n") for x in line.split("|")]
    question = "Where did they store the things of Ann?"
    of = lambda t: pairs.defect_of(question, "", t)[0]
    assert {t: of(t) for t in split(REFUSED)} == {t: "refusal" for t in split(REFUSED)}
    assert {t: of(t) for t in split(ANSWERED) if of(t) not in (None, "language")} == {}
    assert {t: of(t) for t in split(FOREIGN)} == {t: "language" for t in split(FOREIGN)}
    for t in split(FOREIGN)[:6]:  # a question in the same language
        assert pairs.defect_of(t[:-1] + "?", "", t[::-1][:0] + t + " " + t)[0] != "language"
    assert of("latents, batches, buffer, tokens, markers and spans") is None
    assert of(("I am sorry, I really cannot help with any of that. " * 20).strip()) == "refusal"


def test_lexicon_judges_last_words(spark):
    schema = "row_id bigint, prompt array<struct<role:string,content:string>>, target string"
    q = "What is known of the place?"
    rows = [(i, [("user", q)], "It lies by the river, and the river is wide. They had to wait for the boats.") for i in range(40)]
    rows += [(100, [("user", q)], "It is a large city on the riv"), (101, [("user", q)], "a city by the river"), (102, [("user", q)], "a city by the sea"), (103, [("user", q)], "a city that they had")]
    rows += [(104, [("user", "What is the capital of the northern province?")], "The capital of the northern province is the city of"), (105, [("user", "Name 3 findings.")], "- wide river\n- many boats\n- long wai")]
    got = {r.row_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {100: "truncated", 103: "truncated", 104: "truncated", 105: "truncated"}


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.common(a, b) == t[-1][-1]


# leaks


def leak_case():
    rng = random.Random(5)
    items = [(i, f"read <|memory_start|>{sentence(rng, rng.choice([5, 13, 30, 90]))}<|memory_end|> Who is Ann{i}?", [f"gold{i}", None]) for i in range(30)]
    items += [(40, items[3][1], None), (41, None, None), (42, "no markers", []), (43, "a <|memory_start|> open", None), (None, items[3][1], None), items[0]]
    items += [(44, "<|memory_start|>" + "same " * 40 + "<|memory_end|> x", []), (45, "<|memory_start|>" + "tick tack " * 20 + "<|memory_end|>and<|memory_start|>" + sentence(rng, 20) + "<|memory_end|>", [])]
    texts = []
    for i in range(120):
        w = sentence(rng, rng.choice([0, 3, 40, 200])).split(" ")
        if i % 2:
            p = leaks.words(leaks.passages(rng.choice(items[:30])[1])[0])
            s = rng.randrange(max(1, len(p) - 12))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[s : s + rng.choice([12, 13, 14, 60])]
        texts.append((rng.choice("ab"), i, rng.choice([" ", ", ", "-\n"]).join(w)))
    texts += [("a", 500, None), ("a", 501, ""), ("a", None, items[2][1]), ("a", 503, "gold2 " + items[2][1].replace("Who", "who")), ("a", 504, "same " * 13), ("a", 505, "same " * 12), ("b", 506, "tick tack " * 300), texts[1]]
    return items, texts


def item_grams(items):
    grams = {}
    for i, p, _ in items:
        for x in leaks.passages(p) if i is not None else ():
            w = leaks.words(x)
            for j in range(len(w) - 12):
                grams.setdefault(tuple(w[j : j + 13]), set()).add(i)
    return grams


@pytest.mark.parametrize("chars", [leaks.INDEX_CHARS, 900])
def test_leaked_items(spark, chars):
    items, texts = leak_case()
    df = clashing(spark.createDataFrame(texts, TEXTS))
    ev = spark.createDataFrame(items, "item_id bigint, prompt string, answers array<string>").withColumn("src", F.lit("x"))
    got = {(r.src, r.rec_id, r.item_id): r for r in leaks.leaked_items(df, ev, index_chars=chars).collect()}
    grams = item_grams(items)
    want = Counter()
    for s, r, t in set(texts):
        if r is not None:
            w = leaks.words(t or "")
            want.update((s, r, i) for j in range(len(w) - 12) for i in grams.get(tuple(w[j : j + 13]), ()))
    assert {k: r.n_runs for k, r in got.items()} == want and len(want) > 20
    plain = {(s, r): f" {' '.join(leaks.words(t or ''))} " for s, r, t in texts}
    of = {i: (f" {' '.join(leaks.words(p.rpartition(leaks.END)[2]))} ", [x for x in a or [] if x]) for i, p, a in items if p and i is not None}
    for (s, r, i), x in got.items():
        q, a = of[i]
        assert x.has_question == (bool(q.strip()) and q in plain[s, r]) and x.has_answer == any(f" {y} " in plain[s, r] for y in a)
    # texts with a passage of 30 words or more of the item and all of its prompt
    assert any(x.has_question and x.has_answer for x in got.values()) == (("a", 503, 2) in want)
    assert leaks.leaked_items(df, ev.limit(0)).count() == 0 and leaks.leaked_items(df.limit(0), ev).count() == 0


def test_wand_finds_what_scores_enough_and_skips():
    items, texts = leak_case()
    more = [(100 + i, f"<|memory_start|>{sentence(random.Random(i), 200)}<|memory_end|>", []) for i in range(60)]
    parts = [(i, " " + " ".join(leaks.words(p)) + " ", "  ", []) for i, q, _ in items + more for p in leaks.passages(q) if i is not None]
    ix = leaks.Index(parts, 13)
    rng = np.random.default_rng(1)
    scored = pairs = 0
    for _ in range(40):
        window = rng.integers(len(ix.owner))
        terms = np.unique(np.concatenate([rng.integers(0, len(ix.terms), 30), np.nonzero([window in ix.doc[ix.start[t] : ix.start[t + 1]] for t in range(len(ix.terms))])[0][: rng.integers(24)]]))
        q, d, n = ix.wand(np.zeros(len(terms), np.int64), terms)
        total = np.zeros(len(ix.owner))
        for t in terms:
            s = slice(ix.start[t], ix.start[t + 1])
            total[ix.doc[s]] += ix.impact[s]
        assert set(d.tolist()) >= set(np.nonzero(total >= 1 + 1e-4)[0].tolist()) and set(d.tolist()) <= set(np.nonzero(total >= 1 - 1e-4)[0].tolist())
        scored, pairs = scored + n, pairs + int((total > 0).sum())
    assert scored < pairs / 3
    assert ix.nbytes() < 64 * sum(len(p) for _, p, _, _ in parts)


# encoding


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_encode_texts(spark):
    import tiktoken

    ranks = bpe.read_ranks(str(VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", None, " ", "a" * 3000, "<|endoftext|><|im_end|>", "it's  we're\n\n x", "日本語" * 200, "🙂é́​﻿", " " * 700 + "!" * 200, "\x00\x01"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 3000), 32, 0x1F600 + rng.randrange(60)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    rows = bpe.encode_texts(df, ["doc_id"]).collect()
    assert len(rows) == len(texts) + 1
    assert all(r.ids == plain.encode_ordinary(texts[r.doc_id] or "") for r in rows)
    assert all(plain.decode(r.ids) == (texts[r.doc_id] or "") for r in rows)
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert bpe.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    other = bpe.encode_texts(df.limit(20), ["doc_id"], name="byte_bpe_multi_50k").collect()
    multi = tiktoken.Encoding("multi", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(str(VOCABULARY.with_name("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    assert all(r.ids == multi.encode_ordinary(texts[r.doc_id] or "") for r in other)


# containers


def test_fill_containers(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 5, rng.randrange(100), rng.randrange(500)])) for i in range(900)] + [(2000, None), (None, 5), (3, 0)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"))
    out = fill.fill_containers(df, 100, group_items=300).collect()
    sizes = {}
    for i, n in rows:
        if i is not None:
            sizes[i] = max(sizes.get(i, 0), n or 0)
    got, bins = {}, {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
        bins.setdefault(r.container, []).append((r.place, r.n_tokens))
    assert {i: sum(n for _, _, n in p) for i, p in got.items()} == sizes
    for i, p in got.items():
        p.sort()
        assert [f for _, f, _ in p] == [100 * k for k in range(len(p))] and all(n == 100 for _, _, n in p[:-1])
        assert len(p) == max(1, -(-sizes[i] // 100))
    assert all(sorted(k for k, _ in b) == list(range(len(b))) and sum(n for _, n in b) <= 100 for b in bins.values())
    assert len(bins) <= 1.03 * sum(sizes.values()) / 100 + 6
    assert fill.fill_containers(df.limit(0), 100).count() == 0
    report = fill.fill_report(fill.fill_containers(df, 100, group_items=300), 100).collect()[0]
    assert (report.n_containers, report.n_tokens, report.least_containers) == (len(bins), sum(sizes.values()), -(-sum(sizes.values()) // 100))
    assert fill.fill_report(fill.fill_containers(df.limit(0), 100), 100).collect()[0].n_containers == 0


def test_search_empties_containers():
    """Sizes of which best fit makes eleven containers and nine suffice, some times over."""
    for times in (1, 5, 40):
        sizes = np.repeat([51, 27, 26, 23], [6 * times, 6 * times, 6 * times, 12 * times])
        before, after = fill.best_fit(sizes, 100), fill.fill(sizes, 100)
        assert len(before) == 11 * times and len(after) <= 9.5 * times + 1, (len(before), len(after))
        assert sorted(i for b in after for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 100 for b in after)


def test_search_improves_best_fit():
    rng = np.random.default_rng(8)
    better = 0
    for _ in range(40):
        sizes = rng.integers(15, 60, 60)
        before, after = fill.best_fit(sizes, 100), fill.fill(sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(60)) and all(sizes[b].sum() <= 100 for b in after)
        square = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
        assert square(after) >= square(before) and len(after) <= len(before)
        better += square(after) > square(before)
    assert better > 10


# shared spans


def brute_spans(docs, least):
    seen = {}
    for i, t in docs.items():
        for a in range(len(t) - least + 1):
            seen.setdefault(t[a : a + least], set()).add(i)
    out = set()
    for i, t in docs.items():
        run = None
        for a in range(len(t) - least + 1):
            if len(seen[t[a : a + least]]) > 1:
                if run and a <= run[1]:
                    run[1] = a + least
                else:
                    if run:
                        out.add((i, *run))
                    run = [a, a + least]
        if run:
            out.add((i, *run))
    return out


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n]


@pytest.mark.parametrize("least,group", [(100, 50_000), (13, 50_000), (100, 3), (13, 2)])
def test_shared_spans(spark, least, group):
    rng = random.Random(least)
    word = lambda n: "".join(rng.choice("abcdefgh é🙂\n") for _ in range(n))
    parts = [word(rng.randrange(1, 3 * least)) for _ in range(12)] + ["z" * 4 * least, "ab" * 2 * least]
    docs = {i: "".join(rng.choice([rng.choice(parts), word(rng.randrange(2 * least))]) for _ in range(rng.randrange(7))) for i in range(90)}
    docs |= {300: thue_morse(1024), 301: thue_morse(1024).translate(str.maketrans("ab", "ba"))}  # equal modulo 2**64 in any base
    docs |= {200: docs[5], 201: docs[5], 202: "q" * 9 * least, 203: "q" * 5 * least, 204: "short", 205: ""}
    rows = [*docs.items(), (206, None), (None, docs[5]), *list(docs.items())[:4]]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_spans(docs, least)
    assert {tuple(r) for r in spans.shared_spans(df, least, group=group).collect()} == want and len(want) > 30
    amounts = {r.doc_id: (r.n_chars, r.n_shared) for r in spans.shared_amounts(df, least).collect()}
    assert amounts == {i: (len(t), sum(e - s for d, s, e in want if d == i)) for i, t in docs.items()} | {206: (0, 0)}
    assert spans.shared_spans(df.limit(0), least).count() == 0


def test_spans_are_compared_by_characters(spark, monkeypatch):
    """With anchors whose hashes all collide, what comes out is the same."""
    rng = random.Random(4)
    shared = "".join(rng.choice("abc") for _ in range(60))
    docs = {i: "".join(rng.choice("abc") for _ in range(90)) + (shared if i % 3 else "") + "".join(rng.choice("abc") for _ in range(40)) for i in range(12)}
    wins, tid, lead = [], [], []
    for i, t in docs.items():
        for p in range(0, len(t) - 10, 3):
            wins.append(t[max(0, p - 10) : p + 20])
            lead.append(min(10, p))
            tid.append(i)
    at, l = spans.repeats(np.array(lead), wins, np.array(tid), 10, 20)
    want = set()
    for a in range(len(wins)):
        for x in range(11):
            s = wins[a][lead[a] - x : lead[a] - x + 20] if lead[a] >= x else ""
            if len(s) == 20 and any(tid[b] != tid[a] and lead[b] >= x and wins[b][lead[b] - x : lead[b] - x + 20] == s for b in range(len(wins))):
                want.add((a, x))
    assert set(zip(at.tolist(), l.tolist())) == want and len(want) > 20


@pytest.mark.parametrize("two_levels", [False, True])
def test_exchange_levels(monkeypatch, spark, two_levels):
    """Blobs reach the same buckets' contents in one exchange and in two."""
    from ctxspark.llm import exchange as X

    if two_levels:
        monkeypatch.setattr(X, "LEVEL", 3)
    rng = np.random.default_rng(3)
    keys, owners = rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1), np.sort(rng.integers(1, 40, 500)).astype(np.uint64)
    coarse, wide = X.first_level(50)
    rows = X.pack(X.TRIPLE, coarse, keys, owners, np.arange(500), wide, tags=owners * np.uint64(7)) + X.pack(X.CREDIT, coarse, owners, owners, np.arange(500), keyless=True)
    df = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], X.SCHEMA)
    got, credits = set(), 0
    for r in X.meet(df, 50).collect():
        k, o, v, t = X.unpack([r.asDict()])
        if r.kind == X.TRIPLE:
            assert (t == o * np.uint64(7)).all() and (X.bucket_of(keys[v], 50) == r.bucket).all()
            got |= set(zip(o.tolist(), v.tolist()))
        else:
            credits += len(o)
    assert got == set(zip(owners.tolist(), range(500))) and credits == 500


@pytest.mark.parametrize("t_num,t_den", [(1, 4), (1, 2), (3, 5), (4, 5), (9, 10)])
def test_segments_suffice(t_num, t_den):
    tops = near.bands(4, 1.25, 5000)
    for top in tops.tolist():
        largest = np.array([top * t_den // t_num])
        need = near.differences(largest, np.minimum(largest, top), t_num, t_den) + 1
        assert need[0] <= 2 * near.segments_of(np.array([top]), t_num, t_den)[0]


def test_search_in_rounds(spark, monkeypatch):
    """Rounds over bands, and parts of a band that is too much for one, find what one round finds; none is for more than it should."""
    tops, load = near.bands(4, 1.25), {3: 100, 4: 100_000, 7: 20, 8: 20}
    turns = near.rounds(load, 200_000, 3, 5, tops)
    assert all(t[4] <= 200_000 for t in turns) and max(t[3] for t in turns) > 1
    covered = [(b, t[2]) for t in turns for b in range(t[0], t[1])]
    assert len(covered) == len(set(covered)) and {b for b, _ in covered} == set(range(9))
    rows = near_rows(3)
    monkeypatch.setattr(near, "ROUND", 2e-4)
    s = near.Search(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5, least_words=20)
    before = len(stage._PATHS)
    s.candidates()
    assert len([p for p in stage._PATHS[before:] if "near-found" in p]) > 2
    got = {tuple(r) for r in near.similar_records(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5, least_words=20).collect()}
    assert got == brute_pairs(rows, 3, 0.6, 20)
    assert len([p for p in stage._PATHS[before:] if "near-similar" in p]) > 1


def test_counts_take_few_bytes(spark):
    """How many runs of a set are elsewhere comes together in the bucket of the set: one written row for a record, however many buckets its runs have."""
    rows = near_rows(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        before = len(stage._PATHS)
        near.Search(spark.createDataFrame(rows, TEXTS), k=3, t_num=3, t_den=5, least_words=20)
        records = len({(s, i) for s, i, t in rows if i is not None and t})
        assert all(spark.read.parquet(p).count() <= records for p in stage._PATHS[before:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_key_filter(spark):
    keys = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 20_000)
    bits = near.key_filter(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k bigint")).value
    assert near.marked(bits, keys[:1000]).all() and near.marked(bits, keys[1000:]).mean() < 0.01

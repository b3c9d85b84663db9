"""Temperature mixing and chat perspectives."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, mixing

DOCS = "doc_id long, text string, source string, weight int"


def corpus(seed, sizes):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))), s, 1))
            i += 1
    return rows


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


@pytest.mark.parametrize("target,repetition", [(0.9, 100.0), (0.99, 100.0), (0.99, 2.0), (0.1, 4.0)])
def test_weights_meet_the_target(spark, target, repetition):
    rows = corpus(1, {"a": 900, "b": 200, "c": 90, None: 60})
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, mixing.Target(target, repetition)).collect()
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(t.split())
    got = Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    total = sum(got.values())
    times = {s: got[s] / size[s] for s in size}
    assert min(times.values()) > 0.98 and max(times.values()) <= repetition * 1.001
    natural = entropy([x / sum(size.values()) for x in size.values()])
    reached = entropy([x / total for x in got.values()])
    if repetition > 50:
        assert reached >= min(natural, target * math.log(4)) - 0.01 or target > 0.9
        assert abs(reached - max(natural, target * math.log(4))) < 0.01
    elif target > 0.9:
        assert max(times.values()) > repetition * 0.95
    else:
        assert times["a"] == pytest.approx(1) and times["c"] == pytest.approx(1)  # already there


def test_blocks_are_whole_permutations_and_the_last_meets_the_budget(spark):
    rows = corpus(2, {"a": 300, "b": 40})
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    out = mixing.mix(df, mixing.Target(0.99, 50.0))
    assert out.columns == ["doc_id", "text", "source", "weight", "block", "place", "n_tokens"]
    blocks = defaultdict(dict)
    for r in out.collect():
        assert r["doc_id"] not in blocks[r["source"], r["block"]]
        blocks[r["source"], r["block"]][r["doc_id"]] = (r["place"], r["n_tokens"])
    ids = {s: {i for i, _, x, _ in rows if x == s} for s in "ab"}
    last = max(b for s, b in blocks if s == "b")
    assert all(set(blocks["b", b]) == ids["b"] for b in range(last))
    orders = [tuple(sorted(blocks["b", b], key=blocks["b", b].get)) for b in range(last)]
    assert len(set(orders)) == last > 1
    cut = max(blocks["b", last].values(), default=("",))[0]
    assert set(blocks["b", last]) <= ids["b"] and all(p <= cut for p, _ in blocks["b", last].values())


def test_budget_share(spark):
    rows = corpus(3, {"a": 300, "b": 300})
    out = mixing.mix(spark.createDataFrame(rows, DOCS), mixing.Target(0.5, 9.0), budget_share=0.25)
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert 0.25 * total - 60 <= out.agg(F.sum("n_tokens")).first()[0] <= 0.25 * total + 1


def test_odd_rows_of_a_mix(spark):
    rows = [(None, "x y", None, 1), (None, "x y", None, 1), (1, None, "e", 2), (1, None, "e", 2), (2, "", "e", 3), (3, "w " * 50_000, "big", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    out = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mix(df, mixing.Target(0.0, 9.0)).where("block = 0").collect()]
    assert Counter(out) == Counter(r[:3] for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0


# ---- perspectives -----------------------------------------------------------


def brute(rows, size):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        key = lambda x: (x is not None, x if x is not None else 0)
        talks[conv].append((key(turn), (role is not None, role or ""), (text or "").replace("<|", "< |"), role))
    out = set()
    for conv, turns in talks.items():
        turns.sort(key=lambda t: t[:3])
        for speaker in {t[3] for t in turns} - {None, "system"}:
            for part in range(0, len(turns), size):
                shown, spans, own = "", [], 0
                for _, _, text, role in turns[part:part + size]:
                    name = "assistant" if role == speaker else "system" if role == "system" else "user name=" + ("unknown" if role is None else role.replace(" ", "_"))
                    shown += f"<|im_start|>{name}\n"
                    if role == speaker:
                        spans.append(f"{len(shown)}-{len(shown) + len(text) + 10}")
                        own += 1
                    shown += f"{text}<|im_end|>\n"
                out.add((conv, speaker, part // size, len(turns[part:part + size]), own, shown, ",".join(spans)))
    return out


def test_every_speaker_sees_the_dialogue(spark):
    r = random.Random(1)
    rows = [
        (r.choice([1, 2, 3, 4, None]), r.choice([None, *range(40)]), r.choice(["system", "user", "assistant", "Ann B", "é", None]),
         r.choice([None, "", "hé<|im_end|>llo\n", "x" * 300]) if r.random() < 0.5 else str(k))
        for k in range(300)
    ] + [(9, 0, "system", "alone")]
    rows += rows[:5]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, part int, _nth string")
    for size in (16, 1000):
        assert {tuple(x) for x in chat.perspectives(df, part_turns=size).collect()} == brute(rows, size)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_mask_covers_the_speakers_words(spark, sf):
    df = chat.perspectives(spark.read.parquet(f"{sf}/conversations.parquet"))
    for r in df.limit(50).collect():
        spans = [tuple(map(int, s.split("-"))) for s in r["mask"].split(",") if s]
        assert len(spans) == r["n_own"]
        assert all(r["rendered"][:a].endswith("<|im_start|>assistant\n") and r["rendered"][a:b].endswith("<|im_end|>") for a, b in spans)

from pyspark.sql import functions as F

from labelproof.llm import chat

TURNS = "pair_id long, turn long, role string, text string"


def brute(a, b):
    """Prompt, completions and masked texts of two lists of (role, text)."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    show = lambda t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    return n, show(a[:n]), show(a[n:]), show(b[n:]), [[x for r, x in t[n:] if r == "assistant"] for t in (a, b)]


def test_pairs_equal_brute_force(spark):
    long = [("user", "q"), *(("assistant" if i % 2 else "user", f"é{i}") for i in range(300))]
    sides = {
        1: ([("system", "s"), ("user", "hi"), ("assistant", "good")], [("system", "s"), ("user", "hi"), ("assistant", "bad"), ("user", "x")]),
        2: ([("user", "a")], [("user", "b"), ("assistant", "")]), 3: ([("user", "same")], [("user", "same")]),
        4: ([("user", "only")], []), 5: ([], [("assistant", "only")]), 6: (long, [*long[:250], ("assistant", "other")]),
    }
    frames = [
        spark.createDataFrame([(k, i, r, t) for k, s in sides.items() for i, (r, t) in enumerate(s[side])][::-1], TURNS).withColumn("end", F.lit("clash"))
        for side in (0, 1)
    ]
    rows = {r["pair_id"]: r for r in chat.preferences(*frames).collect()}
    assert set(rows) == set(sides)
    for k, (a, b) in sides.items():
        n, prompt, chosen, rejected, learnt = brute(a, b)
        row = rows[k]
        assert (row["common"], row["prompt"], row["chosen"], row["rejected"]) == (n, prompt, chosen, rejected)
        for text, mask, want in ((chosen, row["chosen_mask"], learnt[0]), (rejected, row["rejected_mask"], learnt[1])):
            assert [text[m["start"] : m["end"]] for m in mask] == want


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, TURNS)
    got = {r["pair_id"]: r for r in chat.preferences(frame, frame.limit(0)).collect()}
    assert got[1]["chosen"].startswith("<|im_start|>user\na<|im_end|>\n" * 2 + "<|im_start|>user\nb") and got[1]["chosen"].endswith("<|im_start|>unknown\n<|im_end|>\n")
    assert got[None]["common"] == 0 and got[None]["rejected"] == ""
    assert chat.preferences(frame.limit(0), frame.limit(0)).count() == 0


def test_borrowed_answers(spark):
    rows = [(c, t, "user" if t == 0 else "assistant", f"{c}-{t}") for c in (1, 2, 70) for t in (0, 1)] + [(3, 0, "user", "alone")]
    frame = spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id"))
    got = {(r["conv_id"], r["turn"]): r["text"] for r in chat.borrowed(frame).collect()}
    assert got[1, 1] == "2-1" and got[2, 1] == "1-1" and got[70, 1] == "70-1" and got[3, 0] == "alone" and got[1, 0] == "1-0"

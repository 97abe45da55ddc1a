import random

from loomrecall.llm import chat as C


def brute(turns):
    """Masks by marking every character."""
    text, mark, turn = "", [], []
    for k, (role, t) in enumerate(turns):
        head, body = C.OPEN.format(role), t + C.CLOSE
        text += head + body
        mark += [0] * len(head) + [int(role == C.TRAINED)] * len(body)
        turn += [k] * (len(head) + len(body))
    e = C.tokenizer(C.TOKENIZER).encode(text, add_special_tokens=False)
    return text, e.ids, [max(mark[a : max(z, a + 1)]) for a, z in e.offsets], [turn[a] for a, _ in e.offsets]


def test_masks_match_characters(spark):
    r = random.Random(0)
    rows, want = [], {}
    for c in range(60):
        turns = [(r.choice(("user", "assistant", "system")), "".join(r.choices("ab é漢\n😀<|end|>", k=r.choice((0, 3, 30, 400))))) for _ in range(r.randint(1, 7))]
        want[c] = brute(turns)
        rows += [(c, k, role, t, "x", 5) for k, (role, t) in enumerate(turns)]
    r.shuffle(rows)
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string, n long")).collect()
    assert len(got) == 60
    for x in got:
        assert (x.rendered, x.token_ids, x.loss_mask, x.turn_of_token) == want[x.conv_id]
        assert x.n_tokens == len(x.token_ids) and x.n_trained == sum(x.loss_mask)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, None), (1, None, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user", "q"), (None, 0, "user", "q"), (2, 0, "assistant", "word " * 50_000)]
    out = C.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert [r.conv_id for r in out].count(None) == 2 and len(out) == 4
    got = {r.conv_id: r for r in out}
    assert got[1].rendered == brute([("assistant", "a"), ("user", ""), ("assistant", "b"), ("assistant", "b")])[0]
    assert got[None].n_trained == 0 and got[2].n_trained >= 50_000
    assert C.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_spans_are_intersected():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        cut = sorted(r.sample(range(1, 60), r.randint(1, 6)))
        begin, end = np.array([0] + cut), np.array(cut + [60])
        body = np.array([r.randint(a, z) for a, z in zip(begin, end)])
        trained = np.array([r.random() < 0.5 for _ in begin])
        mark = [0] * 60
        for b, e, t in zip(body, end, trained):
            mark[b:e] = [int(t)] * (e - b)
        start = np.array(sorted(r.choices(range(60), k=20)))
        stop = np.minimum(start + np.array(r.choices(range(5), k=20)), 60)
        turn, mask = C.align(start, stop, begin, body, end, trained)
        assert mask.tolist() == [int(any(mark[a : max(z, a + 1)])) for a, z in zip(start, stop)]
        assert turn.tolist() == [max(k for k, b in enumerate(begin) if b <= a) for a in start]


def test_batches_are_cut_by_text(spark, monkeypatch):
    rows = [(c, k, role, f"{c} {k} " * 40) for c in range(50) for k, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a = sorted(map(str, C.format_chats(df).collect()))
    monkeypatch.setattr(C, "slices", lambda b, c, n: (b.slice(k, 1) for k in range(b.num_rows)))
    assert a == sorted(map(str, C.format_chats(df).collect()))

import numpy as np

from lexiweave.llm import chat


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, block int, rendered string").repartition(3)


def canonical_turn(role, text):
    return f"<|{chat.ROLES[chat.canonical(role)]}|>\n{text or ''}<|end|>\n"


def conversations(n):
    rng = np.random.default_rng(n)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows.append((c, -1, "system", "Be brief.\n\nAnswer in French."))
        for t in range(int(rng.integers(1, 9))):
            text = "\n".join(["What is it?", "- a list", "", "Plain: words here", "> quoted", "```code"][k] for k in rng.integers(0, 6, int(rng.integers(1, 6))))
            rows.append((c, t, ("user", "Human")[c % 2] if t % 2 == 0 else ("assistant", "bot")[c % 2], text))
    return rows


def test_markers():
    for style in range(len(chat.STYLES)):
        for role in [*chat.ROLES, *chat.ALIASES]:
            lines = chat.as_lines(role, "the text", style)
            named, rest, _ = chat.marker(lines[0])
            assert named - 1 == chat.canonical(role) and (rest or lines[1]) == "the text"
    assert chat.marker("Note: this") == (5, "Note: this", False) and chat.marker("no marker") == (0, "no marker", False) and chat.marker("") == (0, "", False)


def test_round_trip(spark):
    rows = conversations(40)
    got = chat.format_turns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(str(c), t): (chat.ROLES[chat.canonical(r)], 1, canonical_turn(r, x)) for c, t, r, x in rows}
    assert {(g.conv_id, g.turn): (g.role_pred, g.n_turns, g.rendered) for g in got} == want


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    rows = conversations(12) + [(99, t, "user" if t % 3 else None, f"line {t}\nmore") for t in range(60)]
    df = frame(spark, rows)
    model = chat.train(df)
    whole = sorted(map(tuple, chat.format_turns(df, model).collect()), key=str)
    rows += [(99, 7, "user", f"tie {k % 2}") for k in range(40)] + [(99, None, "assistant", "none")] * 20
    df = frame(spark, rows)
    model = chat.train(df)
    whole = sorted(map(tuple, chat.format_turns(df, model).collect()), key=str)
    # workers import the module anew, so blocks are made small by the number of ranges
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(tuple, chat.format_turns(df, model).collect()), key=str) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_path(model, symbols):
    from itertools import product

    best = max(product(range(chat.STATES - 1), repeat=len(symbols)), key=lambda p: sum(model.moves[a, b] + model.seen(s)[b] for a, b, s in zip((chat.START, *p), p, symbols)))
    return list(best)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    model = chat.Model.counted({1: 5}, {(1, 2): 9, (2, 1): 8}, {1: (5, 3), 2: (4, 9)}, {(int(s), int(y)): int(k) for s, y, k in rng.integers(1, 8, (30, 3))})
    score = lambda p, s: sum(model.moves[a, b] + model.seen(x)[b] for a, b, x in zip((chat.START, *p), p, s))
    for _ in range(5):
        symbols = [(int(a), int(b)) for a, b in zip(rng.integers(0, chat.SYMBOLS, 4), rng.integers(0, chat.WORDS, 4))]
        path = model.decode(symbols, chat.START, None)
        assert np.isclose(score(path, symbols), score(brute_path(model, symbols), symbols))
        assert np.isclose(model.matrix(symbols)[chat.START].max(), score(path, symbols))


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (1, None, "user", None), (1, 0, None, "no role"), (1, 0, None, "no role"), (2, 5, "narrator", ""), (3, 0, "user", "x\n" * 4000)]
    got = chat.format_turns(frame(spark, rows)).collect()
    assert len(got) == 6 and all(g.role_pred in chat.ROLES and g.rendered.endswith("<|end|>\n") for g in got)
    assert chat.format_turns(frame(spark, []), chat.Model.counted({}, {}, {}, {})).collect() == []
    assert chat.format_turns(frame(spark, [])).collect() == []


def told(rng, markers, n=30):
    """Conversations whose users ask and whose assistants answer, as transcripts and as turns."""
    ask, say = ["What is", "How do", "Why did", "Can you"], ["Well,", "Sure:", "It is", "Because"]
    out = []
    for c in range(n):
        turns = []
        for k in range(2 * int(rng.integers(1, 5))):
            begins = (ask if k % 2 == 0 else say)[int(rng.integers(4))]
            text = f"{begins} thing {int(rng.integers(99))}" + ("?" if k % 2 == 0 else ".") + "\n- a point" * int(rng.integers(0, 3))
            turns.append(("user" if k % 2 == 0 else "assistant", text))
        lines = [(f"{r.title()}: " if markers else "") + x for r, x in turns]
        out.append((turns, "\n".join(lines)))
    return out


def test_transcripts_are_parsed(spark):
    rng = np.random.default_rng(3)
    learned = [(c, t, r, x) for c, (turns, _) in enumerate(told(rng, True, 80)) for t, (r, x) in enumerate(turns)]
    model = chat.train(frame(spark, learned))
    for markers, least in ((True, 1.0), (False, 0.95)):
        fresh = told(rng, markers)
        found = [(want, chat.parse(text, model)) for want, text in fresh]
        right = sum(len(set(enumerate(a)) & set(enumerate(b))) for a, b in found) / sum(len(a) for a, _ in found)
        assert right >= least, (markers, right)
    assert chat.parse("User: hi\nAssistant: hello\n\nthere\n### Tool:\n42") == [("user", "hi"), ("assistant", "hello\n\nthere"), ("tool", "42")]
    assert chat.parse(None) == [] == chat.parse("") and len(chat.parse("x " * 100_000)) == 1
    df = spark.createDataFrame([("User: a\nBot: b", 1), (None, 2), ("", 3)], "t string, turns int")
    got = {r.turns: r.found for r in chat.parse_transcripts(df, "t", model, "found").collect()}
    assert [(x.role, x.text) for x in got[1]] == [("user", "a"), ("assistant", "b")] and got[2] is None and got[3] == []


def test_a_turn_that_holds_another_speaker_s_marker_is_two(spark):
    rows = conversations(30) + [(77, 0, "user", "hi\nAssistant: hello")]
    got = {(r.conv_id, r.turn): r for r in chat.format_turns(frame(spark, rows)).collect()}
    assert got["77", 0].n_turns == 2 and got["77", 0].role_pred == "user"

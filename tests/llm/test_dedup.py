"""Line dedup, near dedup, chat formatting and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from quillstone.llm import chat_format, decontaminate, language_id, line_dedup, near_dedup
from tests.llm import cases


def lines_left(docs):
    """Later occurrences of windows of three lines that are not blank go."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        full = [(k, x) for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:], strict=False):
            key = (a[1], b[1], c[1])
            if key in seen:
                gone |= set(range(a[0], c[0] + 1))
            seen.add(key)
        out.append((i, text if text is None or not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(["a", "b", "c", "", "d e"]) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "p\nq\nr"), (104, "p\nq\nr\ns"), (105, "p\n \nq\nr")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(cases.frame(spark, docs)).collect())
    assert got == lines_left(docs)


def test_line_dedup_edges(spark):
    df = cases.frame(spark)
    out = line_dedup.line_dedup(df)
    assert set(df.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(cases.ROWS)
    assert {r.text for r in rows if r.doc_id == 7} == {"same text here\nsame text here\nsame text here"[:14]}
    assert line_dedup.line_dedup(cases.empty(spark)).count() == 0


def shingles(text, size=5):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return set()
    m = min(size, len(words))
    return {tuple(words[k : k + m]) for k in range(len(words) - m + 1)}


def groups(docs, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def near_docs(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    docs = []
    for k in range(n):
        if docs and rng.random() < 0.7:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        text = " ".join(words)
        docs.append((k, text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components(spark, percent):
    docs = near_docs(percent, 120)
    rows = near_dedup.near_components(cases.frame(spark, docs), percent=percent).collect()
    want = groups(docs, percent)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingles(t)) for i, t in docs}


def test_star_of_near_copies(spark):
    """Copies link to their centre but not to each other, and the centre is not the smallest id."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    docs = [(500, " ".join(base))]
    for k in range(80):
        words = list(base)
        for at in rng.sample(range(5, 195), 3):
            words[at] = f"x{k}-{at}"
        docs.append((k, " ".join(words)))
    rows = near_dedup.near_components(cases.frame(spark, docs), percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == groups(docs, 85)


def test_bitmaps_bound_the_difference():
    sets = near_dedup.shingle_sets([t for _, t in near_docs(4, 40)])
    bits = near_dedup.parities(sets)
    for a in range(len(sets)):
        for b in range(a):
            for half in (slice(0, near_dedup.PARITY // 8), slice(near_dedup.PARITY // 8, None)):
                assert np.unpackbits((bits[a] ^ bits[b])[half]).sum() <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))


def test_small_blocks(spark, monkeypatch):
    """Buckets of several blocks, in which near misses are many, lose no link."""
    monkeypatch.setattr(near_dedup, "LEAST_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "FAN", 3)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[at] = rng.choice([f"x{k}-{at}", "same"])
        docs.append((k, " ".join(words)))
    rows = near_dedup.near_components(cases.frame(spark, docs), percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == groups(docs, 85)


def test_near_edges(spark):
    rows = near_dedup.near_components(cases.frame(spark), percent=85).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r.doc_id: r for r in rows}
    assert (by[2].n_shingles, by[2].component_id, by[2].kept) == (0, 2, True)
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert near_dedup.near_components(cases.empty(spark)).count() == 0


def test_components_of_chains(spark):
    links = [(k + 1, k) for k in range(50)] + [(100, 60), (100, 70), (80, 70), (90, 60), (91, 60)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 51)}, 70: 60, 80: 60, 90: 60, 91: 60, 100: 60}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|> <\\| <\\\\|"), (1, 2, "assistant", "<|im_start|>user\nno"), (1, 3, "user", "ends with <"), (1, 4, "assistant", "\\| starts | so"),
    (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 0, "user", "tie"), (3, None, "user", "null turn"), (4, 1, None, "no role"), (5, 0, "odd\nrole<|x", "t\n\n"), (None, 0, "user", "no id"), (6, 0, "user", "é𝔸日"), (6, 1, "assistant", ""), (6, 0, "user", "é𝔸日"),
]


def chats(spark):
    return spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat_format.chat_digests(chats(spark)).collect()}
    by = {}
    for c, turn, role, text in CHATS:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for *_, r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for *_, r, t in rows)), len(loss), sha(loss))
    assert {c for c, r in got.items() if r.valid} == {1, None}
    assert chat_format.chat_digests(chats(spark).limit(0)).count() == 0


def test_chat_segments(spark):
    row = chat_format.format_chats(chats(spark).filter("conv_id = 2")).first()
    assert row.formatted == "<|im_start|>assistant\nfirst<|im_end|>\n" == "".join(s.text for s in row.segments)
    assert [s.text for s in row.segments if s.loss] == ["first"] and (row.valid, row.final_state) == (False, "error")


def test_native_plans(spark, sf_dir):
    for df in (chat_format.chat_digests(chats(spark)), line_dedup.line_dedup(cases.frame(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    step = stages["language_id"](spark, docs, sf_dir)
    assert step.columns == docs.columns
    scorer = language_id.Scorer(language_id.fit_model(docs))
    kept = {i for i, t in rows if scorer([t])[0][0] != "und"}
    assert {r.doc_id for r in step.collect()} == kept

    step = stages["line_dedup"](spark, step, sf_dir)
    want = {i: t for i, t, n in lines_left([r for r in rows if r[0] in kept]) if not n or t.strip()}
    assert {r.doc_id: r.text for r in step.collect()} == want and all(r.n_chars == len(r.text) for r in step.collect())

    step = stages["near_dedup"](spark, step, sf_dir)
    label = groups(list(want.items()), 80)
    want = {i: t for i, t in want.items() if label[i] == i}
    assert {r.doc_id: r.text for r in step.collect()} == want

    step = stages["decontaminate"](spark, step, sf_dir)
    search = decontaminate.Searcher([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    want = {i: t for i, t in want.items() if not search(decontaminate.words_of(t))[1]}
    assert {r.doc_id for r in step.collect()} == set(want)

    out = stages["packing"](spark, step, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(want)
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def machine(roles, template):
    """States and flags one by one."""
    state, flags = template.start, []
    for role in roles:
        flags.append(role in template.trained.get("", ()) or role in template.trained.get(state, ()))
        state = template.moves.get(state, {}).get(role, "error")
    return state, flags


def test_machine_over_long_conversations(spark, monkeypatch):
    """Blocks compose: conversations of many blocks, with orders that break late, early or never."""
    monkeypatch.setattr(chat_format, "BLOCK", 5)
    rng = random.Random(21)
    chats = {0: ["system", *["user", "assistant"] * 40], 1: ["user", "assistant"] * 20 + ["assistant", "user"], 2: ["assistant"] * 30, 3: ["user"], 4: ["system"]}
    for k in range(5, 25):
        chats[k] = [rng.choice(["system", "user", "assistant", "tool"]) if rng.random() < 0.03 else ("user", "assistant")[j % 2] for j in range(rng.randint(1, 60))]
    strict = chat_format.ChatTemplate(trained={"asked": ("assistant",), "answered": ("user",)})
    for template in (chat_format.ChatTemplate(), strict):
        df = spark.createDataFrame([(c, k, r, f"t{k}") for c, roles in chats.items() for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(df, template), template).collect()}
        for c, roles in chats.items():
            state, flags = machine(roles, template)
            assert (got[c].final_state, got[c].valid) == (state, state in template.accept)
            assert [t.loss for t in got[c].turns] == flags == [s.loss for s in got[c].segments[1::3]]


def test_one_very_long_conversation(spark):
    df = spark.range(60_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('said ', id) text", "id AS segments", "id AS valid")
    row = chat_format.chat_digests(df).first()
    assert (row.n_turns, row.valid, row.loss_chars) == (60_000, True, sum(len(f"said {k}") for k in range(1, 60_000, 2)))


def test_machine_is_in_the_plan(spark, sf_dir):
    from quillstone.llm import queries

    plan = queries.op8_chat_format(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "asked>assistant" in plan and "1answered" in plan


def pipeline_tables(spark, tmp_path, docs, items):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.lit("clash").alias(c) for c in ("lang_pred", "score", "n_tokens", "kept", "component_id", "hit_flags", "contaminated", "tie", "gone", "row", "bucket_len", "salt")]
    frame.select("*", *extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_edges(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n, k: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{k}" for _ in range(n))
    clean = say(60, "x")
    leak = "one two three four five six seven eight nine ten eleven"
    docs = [(1, clean, "en", "s", 1), (2, clean, "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "12 !?", "en", "s", 1), (6, say(40, "y"), None, "s", 1), (None, say(30, "z"), "en", "s", 1), (7, f"{say(20, 'q')} {leak} {say(20, 'r')}", "en", "s", 1), (8, say(25, "v"), "en", "s", 1), (8, say(25, "w"), "en", "s", 1)]
    docs.append(docs[-1])
    sf = pipeline_tables(spark, tmp_path / "some", docs, [(1, leak), (None, None), (2, "")])
    step, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == corpus_pipeline.COLUMNS
        names.append((name, sorted((r.doc_id or 0 for r in step.collect()))))
    assert names == [("language_id", [0, 1, 2, 6, 7, 8, 8, 8]), ("line_dedup", [0, 1, 2, 6, 7, 8, 8, 8]), ("near_dedup", [0, 1, 6, 7, 8, 8, 8]), ("decontaminate", [0, 1, 6, 8, 8, 8])]
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 6, 8, 8, 8]


def test_pipeline_of_nothing(spark, tmp_path):
    sf = pipeline_tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    sf = pipeline_tables(spark, tmp_path / "plain", [(1, "some words of a text", "en", "s", 1)], [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()] == [1]


def test_staged_tables_are_deleted(spark):
    import os

    from quillstone.llm._shared import _application_dir, release

    release(spark)
    out = near_dedup.near_components(cases.frame(spark, near_docs(1, 40)), percent=85)
    left = {d.rsplit("-", 1)[0] for d in os.listdir(_application_dir(spark))}
    assert {"signatures", "class-components"} <= left <= {"signatures", "class-components", "links", "labels"}
    assert out.count() == 40
    release(spark)
    assert not os.path.exists(_application_dir(spark))


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_marks_miss_no_id(spark, bits):
    from quillstone.llm._shared import marked

    df = spark.range(3000).selectExpr("if(id % 100 = 0, null, id) AS doc_id", "id AS other")
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "doc_id")
    rows = marked(df, "doc_id", ids, bits).collect()
    assert len(rows) == 3000 and all(r.maybe for r in rows if r.doc_id is not None and r.doc_id % 7 == 0)
    assert bits == 64 or sum(r.maybe for r in rows) < 450


def test_drop_copies_keeps_all_columns(spark):
    docs = near_docs(2, 60)
    df = cases.frame(spark, [*docs, (None, "no id"), (None, "no id")]).withColumnRenamed("hit_flags", "maybe")
    label = groups(docs, 80)
    out = near_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted([(i or -1, t) for i, t in docs if label[i] == i] + [(-1, "no id")] * 2)

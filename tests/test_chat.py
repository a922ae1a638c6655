from tessera.operators import chat as H


def _turns(spark, texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_segments_and_quit(spark):
    t = _turns(spark, ["hi", "clear", "  ", "mode precise", "x", "switch", "y", "quit", "after"])
    seg = [(r.turn, r.kind, r.segment) for r in H.segment_sessions(t).orderBy("turn").collect()]
    assert [k for _, k, _ in seg] == ["message", "clear", "blank", "mode", "message", "switch", "message"]
    assert [s for _, _, s in seg] == [0, 1, 1, 1, 1, 2, 2]


def test_stage_cycling(spark):
    t = _turns(spark, ["switch", "switch 2", "switch", "switch 9", "switch 1", "hi"])
    st = [r.stage for r in H.active_stage(H.segment_sessions(t)).orderBy("turn").collect()]
    assert st == [1, 2, 3, 1, 1, 1]


def test_locked_mode_and_presets(spark):
    t = _turns(spark, ["write a poem", "mode precise", "write a poem", "mode bogus", "tell me", "mode auto",
                       "write a poem", "Models are cool"])
    presets = spark.createDataFrame(H.PRESETS, H.PRESET_SCHEMA)
    got = [(r.turn, r.mode) for r in H.attach_presets(H.segment_sessions(t), presets).orderBy("turn").collect()]
    assert got == [(0, "creative"), (2, "precise"), (4, "precise"), (6, "creative")]


def test_classify_word_boundaries(spark):
    df = spark.createDataFrame([("écode here",), ("my code",), ("c++ is",), ("c++x",), ("hello",),
                                ("translate this to french",)], "text string")
    got = [r[0] for r in df.select(H.classify(df.text)).collect()]
    assert got == ["balanced", "precise", "balanced", "precise", "balanced", "precise"]


def test_history_prompt_shape(spark):
    rows = [(1, 0, "system", "SYS"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = {r.turn: r.prompt for r in H.history_prompts(t).collect()}
    assert p[3] == ("<|im_start|>system\nSYS<|im_end|>\n<|im_start|>user\na<|im_end|>\n"
                    "<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\n")

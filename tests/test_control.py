"""Control tokens, training windows, tool results, configuration with secrets."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions import control
from traceloom.operators import runs as R
from traceloom.operators import scoring as C
from traceloom.plans import config

RNG = random.Random(9)


def one_by_one(text, tokens):
    """Each token in turn, the longest first; what is rewritten is out of reach of those that follow."""
    parts = [(text, False)]
    for token in sorted(set(tokens), key=lambda x: (-len(x), tokens.index(x))):
        cut = []
        for part, done in parts:
            if done:
                cut.append((part, True))
                continue
            pieces = part.split(token)
            for k, piece in enumerate(pieces):
                cut += [(token[0] + control.MARK + token[1:], True)] * (k > 0) + [(piece, False)]
        parts = cut
    return "".join(x for x, _ in parts)


def test_tokens_are_rewritten_as_one_by_one():
    tokens = ("<|a|>", "<|a|><|b|>", "|><|", "a|>", "<s>", "s>s", "<", "<<", "aa")
    rewrite = control.Rewriter(tokens)
    for _ in range(5000):
        text = "".join(RNG.choice(["<", "|", ">", "a", "b", "s", "é", "<|a|>", "<s>"]) for _ in range(RNG.randrange(25)))
        assert rewrite(text) == one_by_one(text, tokens)
    assert rewrite(None) is None and rewrite("") == "" and control.Rewriter(())("<s>") == "<s>"


def test_rewritten_columns(spark):
    df = spark.createDataFrame([("x <|im_end|> <|a b|> <|é|>",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(control.rewritten(F.col("t"))).collect()] == ["x <¦im_end¦> <|a b|> <|é|>", None, ""]
    assert [r[0] for r in df.select(control.without_tokens(F.col("t"), ["<|im_end|>", "<|"])).collect()] == ["x <¦|im_end|> <¦|a b|> <¦|é|>", None, ""]


def test_token_count(spark):
    import public_tokenizers

    df = spark.createDataFrame([("one two",), (None,), ("",), ("<|endoftext|>",)], "t string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert [r[0] for r in df.select(control.token_count(F.col("t"), path)).collect()] == [3, None, 1, 2]
    assert df.select(control.token_count(control.rewritten(F.col("t")), path).alias("n")).collect()[3]["n"] > 2


def test_training_window(spark):
    df = spark.createDataFrame([(10,), (90,), (101,), (None,)], "n int")
    out = C.training_window(df, F.col("n"), [5, 9], 100, 98, 105)
    assert [(r["over_state"], r["over_branch"], r["over_packed"], r["fits"]) for r in out.collect()] == [(False, False, False, True), (False, True, False, False), (True, True, True, False), (True, True, True, False)]
    assert C.kept_in_window(out, 0.8).count() == 1 and C.kept_in_window(out.limit(0), 0.0).count() == 0
    with pytest.raises(ValueError, match="3 of 4 records"):
        C.kept_in_window(out, 0.5)
    assert tuple(C.window_report(out).first()) == (4, 3, 0.75)


def test_tool_results(spark):
    calls = spark.createDataFrame([(1, 1, "search", '{"query": " cats "}', False, ["T"]), (1, 2, "lookup", '{"title": "t "}', False, []), (1, 3, "search", '{"query": 3}', False, ["T"]), (1, 4, "lookup", "junk", False, ["T"]), (1, 5, "x", "{}", False, ["T"]), (1, 6, "search", '{"query": "a"}', True, ["T"])], "run_id int, at int, name string, args_json string, exhausted boolean, titles array<string>")
    hits = spark.createDataFrame([(1, 1, 2, "B", "b"), (1, 1, 1, "A", "a"), (1, 6, 1, "A", "a")], "run_id int, at int, rank int, title string, text string")
    out = {r["at"]: (r["status"], r["result"], r["paragraphs"]) for r in R.tool_results(calls, hits, "spent").collect()}
    assert out[1] == ("ok", "[A] a\n\n[B] b", ["a", "b"])
    assert out[2] == ("not_found", "No paragraph titled 't'. Available titles: (none)", [])
    assert out[3][:2] == ("bad_args", R.BAD_ARGUMENT["search"]) and out[4][:2] == ("bad_args", R.BAD_ARGUMENT["lookup"])
    assert out[5] == ("bad_args", "unknown tool", []) and out[6] == ("budget_exhausted", "spent", [])


def test_configuration_with_secrets():
    text = "keep_threshold: 0.6\napi_keys_env: KEYS\nidle_timeout_s: 5s\nexporters:\n- name: a\n  headers: {x: inline, y: kept}\n  headers_env: HEAD\n  token_env: TOKEN\n"
    found = config.load_yaml(text, {"KEYS": "k1, k2", "HEAD": "x=env,z=1%202", "TOKEN": "t", "TRACELOOM_RANDOM_FLOOR": "0.1"})
    assert (found.keep_threshold, found.random_floor, found.idle_timeout_s, found.api_keys) == (0.6, 0.1, 5.0, ["k1", "k2"])
    assert found.exporters == [{"name": "a", "headers": {"x": "env", "y": "kept", "z": "1 2"}, "token": "t"}]
    with pytest.raises(ValueError, match=r"exporters\[0\].headers_env: \$HEAD is not set; .*unknown key nothing"):
        config.load_yaml(text + "nothing: 1\n", {"KEYS": "k", "TOKEN": "t"})
    for bad in ("[1]", "a: [", "keep_threshold: 2"):
        with pytest.raises(ValueError):
            config.load_yaml(bad, {})
    assert config.load_yaml("", {}) == config.load({}, {})

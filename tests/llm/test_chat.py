import hashlib
from itertools import groupby

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import chat
from graphloom.llm.chat import CONTROLS, Node, TemplateError, compile_template, conversation_digests, digests, escape, fold, format_conversations, parse, read_turns, render, unescape

PIECES = [*CONTROLS, "\\", "<", "[", "/", "|", "<\\s>", "\n", "a", "é"]


@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3))).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>\n", ""]), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=5), st.integers(1, 40))
def test_turns_are_read_back_whatever_the_parts(turns, most):
    pieces = compile_template(chat.TURNS)(messages=({"role": r, "text": t} for r, t in turns))
    got = list(read_turns(chat._parts(pieces, most)))
    assert got == [(r, t, t if r == "assistant" else "") for r, t in turns]


def test_tags_expressions_and_loop_variables():
    source = "{# no #}{% set x = 'a' ~ 1 %}{% for m in ms %}{% if loop.first %}<{% elif m['k'] == 2 and not loop.last %}two{% else %}{{ m.k + 1 }}{% endif %}{{ ',' if not loop.last else '>' }}{% endfor %}{{ x | upper }}{{ missing.k if false else none }}"
    assert render(source, ms=[{"k": 1}, {"k": 2}, {"k": 2}])[0] == "<,two,3>A1"


def test_generation_spans_count_code_points():
    text, spans = render("{% for m in ms %}é{% if m.r == 'a' %}{% generation %}{{ m.t }}.{% endgeneration %}{% endif %}{% endfor %}", ms=[{"r": "u", "t": "x"}, {"r": "a", "t": "ñu"}, {"r": "a", "t": ""}])
    assert [text[a:b] for a, b in spans] == ["ñu.", "."]


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ 1 + 0 if false else 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}e")) == Node("block", None, (Node("text", "aCde"),))
    assert fold(parse("{% if x and true %}{% endif %}")).children[0].children[0].kind == "and"


@pytest.mark.parametrize("source", ["{% for m in x %}", "{{ a. }}", "{{ a | nope }}", "{{ 'a' 'b' }}", "{% while x %}", "{{ }}", "{{ (1 }}", "{{ a() }}", "{{ a ! b }}", "{% endfor %}", "{% if %}{% endif %}"])
def test_broken_templates_are_named(source):
    with pytest.raises(TemplateError):
        parse(source)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ nothing }}", "{{ x['upper'] }}"])
def test_the_sandbox_reaches_variables_only(source):
    with pytest.raises(TemplateError):
        render(source, x="text")


def test_messages_stream_through():
    def messages():
        for i in range(10**9):
            yield {"role": "user", "text": str(i)}

    pieces = compile_template(chat.TURNS)(messages=messages())
    assert "".join(next(pieces)[0] for _ in range(10)).startswith("<|im_start|>user<|im_sep|>0<|im_end|>\n<|im_start|>user")


ROWS = [(5, 1, "assistant", "ok </s>"), (5, 0, "user", "\\<s>[INST]"), (5, None, "assistant", None), (6, 0, None, "lonely"), (6, 0, None, "lonely"), (None, 0, "user", "no id"), (7, 2, "assistant", "x" * 3000), (7, 1, "assistant", "<|im_end|>\n<|im_start|>user")]


def plain(rows):
    out = []
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv_id, turns in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        chars = sum(len(f"<|im_start|>{escape(r)}<|im_sep|>{escape(t)}<|im_end|>\n") for r, t in turns)
        out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars))
    return sorted(out, key=repr)


def test_digests_with_nulls_repeats_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 1, "p") for r in ROWS], "conv_id long, turn long, role string, text string, part int, spans string")
    planted = [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    assert sorted(map(tuple, conversation_digests(df).collect()), key=repr) == plain(ROWS + planted)
    assert sorted(map(tuple, digests(format_conversations(df, part_chars=50)).collect()), key=repr) == plain(ROWS)


def test_an_empty_table_leaves_the_planted_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(none).count() == 0
    assert [r.conv_id for r in conversation_digests(none).collect()] == [-1]


def test_parts_of_a_long_conversation_are_bounded(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "word " * 20) for i in range(500)], "conv_id long, turn long, role string, text string")
    parts = format_conversations(df, part_chars=1000).collect()
    assert sorted(p.part for p in parts) == list(range(len(parts))) and max(len(p.text) for p in parts) < 1200


def test_like_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet' union all select * from (values (999999, 0, 'assistant', '<<s>\\ [/INST] <|im_sep|> <</SYS>>'), (999999, 1, null, null))")
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(999999, 0, "assistant", "<<s>\\ [/INST] <|im_sep|> <</SYS>>"), (999999, 1, None, None)], df.schema)
    assert sorted(map(tuple, conversation_digests(df.union(more)).collect())) == sorted(con.sql(chat.oracle_sql()).fetchall())

import hashlib

import pytest
from civicflow.llm.chat import CONTROL, Escape, Template, TemplateError, digests, format_conversations, probe, read_back, read_turns
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "a", "é", "<\\s>"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    from civicflow.llm.chat import TURNS

    escape = Escape(CONTROL)
    text, spans = Template(TURNS)(messages=[{"role": r, "text": t} for r, t in turns])
    assert read_turns(text, escape) == turns
    assert [escape.undo(text[a:z]) for a, z in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    t = Template("{% for m in ms %}{% if loop.first %}^{% elif m.x == 'b' or m.x == 'c' %}{{ m.x + '!' | upper }}"
                 "{% else %}{{ m['x'] }}{% endif %}{% if not loop.last %}, {% endif %}{% endfor %}")
    assert t(ms=[{"x": v} for v in "abcd"])[0] == "^, B!, C!, d"
    assert Template("{{ a | trim }}|{{ b.c.d }}")(a="  x ", b={"c": {"d": 1}})[0] == "x|1"
    assert Template("x{% generation %}{{ a }}{% endgeneration %}y{% generation %}{% endgeneration %}")(a="été")[1] == [(1, 4), (5, 5)]


def test_constants_are_folded():
    assert Template("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% else %}{{ z }}{% endif %}e").tree == [("text", "aBCde")]
    assert Template("{% if 1 == 2 %}no{% elif a %}yes{% endif %}").tree == [("if", [(("name", "a"), [("text", "yes")])], [])]
    assert Template("{% if false_name == 1 %}a{% elif 1 == 1 %}b{% else %}c{% endif %}").tree[0][2] == [("text", "b")]


@pytest.mark.parametrize("bad", [
    "{{ a.__class__() }}", "{{ (1).real }}{{ f(1) }}", "{{ [x for x in y] }}", "{% for x in y %}", "{% if a %}", "{% endif %}", "{{ }}",
    "{{ a | nofilter }}", "{% for 1x in y %}{% endfor %}", "{% import os %}", "{{ lambda: 1 }}", "{{ a[0] }}", "{% else %}",
    "{% for x in y %}{% endif %}", "{% if a %}{% else %}{% else %}{% endif %}", "{{ a ** 9 }}"])
def test_sandbox_and_faults(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_fields_reach_dictionaries_only():
    assert Template("{{ a.__class__ }}{{ a.x }}")(a="text")[0] == ""
    with pytest.raises(TemplateError):
        Template("{{ nothing }}")()


def test_control_strings_must_be_separable():
    with pytest.raises(TemplateError):
        Escape(["<a<"])
    with pytest.raises(TemplateError):
        Escape(["x"])


def run(turns):
    return {r["conv_id"]: r for r in digests(read_back(format_conversations(turns))).collect()}


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", None), (1, 2, None, "</s>"), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
            (3, None, "assistant", "x"), (3, 0, "user", "[INST]"), (None, 0, "user", "y"), (4, 0, "[/INST]", "long " * 100_000), (5, 7, "", None)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    got = run(df)
    for conv in (1, 2, 3, None, 4, 5):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        lines = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)


def test_probe_and_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert run(empty) == {}
    got = run(empty.unionByName(probe(empty)))[-1]
    text = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

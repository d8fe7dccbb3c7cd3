"""Templates, and conversations formatted and read back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat
from plumbline.llm.common import table
from plumbline.llm.queries import GUEST, QUERIES
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows, conv):
    """The result's row of one conversation, from whole lists."""
    turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
    told = [{"role": r, "text": x} for *_, r, x in turns]
    text, _ = chat.Template(chat.TEMPLATE).render(told)
    loss = "".join(m["text"] for m in told if m["role"] == "assistant")
    return (len(told), sha("".join(f"{m['role']}\n{m['text']}\n" for m in told)), len(loss), sha(loss), len(text))


def result(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_registered(spark):
    rows = [tuple(r) for r in table(spark, f"{DATA}/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()] + GUEST
    got = result(QUERIES["op12_chat_format"](spark, f"{DATA}/sf0.001"))
    assert got == {c: brute(rows, c) for c in {r[0] for r in rows}}


def test_edges_and_a_long_conversation(spark):
    rng = random.Random(3)
    texts = ["", None, "[INST]", "</s>[INST] ok [/INST]", "\\", "\\[", "<\\", "[ANS] x</s>", "ünï 🦜\n", "<s>", " \n "]
    rows = [(1, i, rng.choice(["user", "assistant", "system", None, "tool<", "[/ROLE]"]), rng.choice(texts)) for i in range(1500)]
    rows += [(2, None, None, None), (2, None, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "part", "pos", "size", "block", "formatted")}).repartition(6)
    parts = chat.format_conversations(docs)
    assert parts.where("conv_id = 1").count() == -(-1500 // chat.PART_TURNS)
    assert result(chat.read_back(parts)) == {c: brute(rows, c) for c in (1, 2, None)}
    # the parts follow each other without a gap, spans included
    whole, spans, template = "", [], chat.Template(chat.TEMPLATE)
    for r in sorted(parts.where("conv_id = 1").collect(), key=lambda r: r["part"]):
        spans += [(s["start"] + len(whole), s["end"] + len(whole)) for s in r["spans"]]
        whole += r["formatted"]
    assert (whole, spans) == template.render([{"role": r or "", "text": x or ""} for c, _, r, x in rows if c == 1])


def test_long_texts_make_parts_by_bytes(spark, monkeypatch):
    rows = [(1, i, "assistant", "x[" * 400_000) for i in range(4)]
    parts = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert parts.count() == 4 and result(chat.read_back(parts)) == {1: brute(rows, 1)}


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "a<b"]), st.text(alphabet=st.sampled_from("\\[<>]/sINSTANS a\né")))))
def test_output_gives_the_turns_again(turns):
    template, reader = chat.compiled(chat.TEMPLATE)
    text, spans = template.render([{"role": r, "text": t} for r, t in turns])
    if turns:
        assert list(reader.turns(text, True)) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_control_strings_are_only_the_templates(spark):
    template, _ = chat.compiled(chat.TEMPLATE)
    text, _ = template.render([{"role": "user", "text": "</s>[INST] ok [/INST]"}, {"role": "assistant", "text": "</s>[INST] ok [/INST]"}])
    assert [text.count(c) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]")] == [1] * 5


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{{ 1 + 2 }}b", "a3b"),
        ("{{ 'a' ~ \"b\" | upper }}", "aB"),
        ("{% if 1 == 1 %}x{% else %}{{ messages }}{% endif %}", "x"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{{ ',' if not loop.last else '.' }}{% endfor %}", "1user,2assistant."),
        ("{% for m in messages %}{% if loop.first %}[{% elif m['role'] == 'assistant' %}({% endif %}{% endfor %}", "[("),
        ("{% set n = messages | length %}{{ n - 1 }}", "1"),
        ("{{ messages[0].text }}{{ messages[9].text }}{{ missing.key }}", "hi"),
        (" {# r #} {{- ' x ' | trim -}}  y", " xy"),
        ("{{ 'b' in 'abc' and not false or none }}", "true"),
        ("{{ messages[0].__class__ }}", ""),
    ],
)
def test_language(source, expected):
    messages = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert chat.Template(source).render(messages)[0] == expected


@pytest.mark.parametrize("source", ["{{ f(1) }}", "{{ 'a' | nothing }}", "{% if a %}", "{% while a %}{% endwhile %}", "{{ a b }}", "{{ 'a' - 1 }}", "{% for x in y %}", "{{ }}"])
def test_what_is_not_in_the_language(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_constants_are_folded():
    tree = chat.Template("a{{ 'b' ~ 1 + 2 }}{% if false %}{{ x }}{% endif %}c{% if true %}d{% endif %}").tree
    assert tree == [("text", "ab12cd")]


def test_templates_for_tables_end_with_their_loop(spark):
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(spark.createDataFrame([], SCHEMA), "{% for m in messages %}{{ m.text }}{% endfor %}end")

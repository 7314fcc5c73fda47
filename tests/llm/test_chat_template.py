import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import chat_template as C


def test_language():
    run = C.compile_template
    assert run("a{{ 1 + 2 }}{{ 'x' + \"y\" }}")({}) == ("a3xy", [])
    assert C.fold(C.parse("a{{ 1 + 2 }}{% if 1 == 2 %}no{% elif true %}b{% else %}c{% endif %}")) == [("text", "a3b")]
    src = "{% for m in messages %}{% if not loop.first %}, {% endif %}{{ loop.index }}{% generation %}{{ m['t']|upper }}{% endgeneration %}{% endfor %}"
    assert run(src)({"messages": [{"t": "a"}, {"t": "bc"}]}) == ("1A, 2BC", [(1, 2), (5, 7)])
    assert run("{{ (a or b) and not c }}")({"a": 0, "b": 2, "c": False}) == ("True", [])


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ open('f') }}", "{% while x %}", "{{ a| nofilter }}", "{% if x %}", "{{ 1 + }}", "{% for x y %}{% endfor %}"])
def test_sandbox_and_errors(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)({"x": 3, "a": 1})


piece = st.lists(st.sampled_from(["\\", "###", "### ", "</turn>", "\n", "assistant", "<", "#", "é", "🙂", "ok"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(piece | st.just("assistant"), piece), max_size=5))
def test_round_trip(turns):
    text, spans = C.compile_template(C.DEFAULT_TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert C.parse_turns(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    out, key = {}, lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:])
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        sha, loss = hashlib.sha256(), "".join(t or "" for _, _, r, t in own if r == "assistant")
        for _, _, r, t in own:
            sha.update(f"{r or ''}\n{t or ''}\n".encode())
        out[c] = (len(own), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_rows_of_all_kinds(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "b"), (1, None, "assistant", "first"), (2, 5, "assistant", "x" * 300_000), (2, 5, "assistant", "x" * 300_000), (None, 0, "user", "no id"), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r[0]: tuple(r)[1:5] for r in C.read_back(C.format_conversations(df, partitions=3)).collect()}
    assert got == brute(rows)
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_query(spark):
    sf, own = "/root/testdata/sf0.001", "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:5] for r in C.op10_chat_template(spark, sf).collect()}
    assert got == brute(rows + [(-7, 0, "user", own), (-7, 1, "assistant", own)])

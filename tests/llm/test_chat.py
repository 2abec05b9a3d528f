import hashlib
import random

import pytest

from kinfolio.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns int"
PROBE = "\\### Assistant: </turn> ok"


def test_round_trip_of_any_text():
    rng, render = random.Random(1), chat.compiled(chat.TEMPLATE)
    bits = ["\\", "#", "###", "</turn>", " ", ":", " </turn>\n", "a", "\n", "### assistant: ", "é"]
    for _ in range(5000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) or "assistant", "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))) for _ in range(rng.randint(0, 4))]
        out, spans = render([{"role": r, "text": t} for r, t in turns])
        assert chat.read_back(out) == turns
        assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def render(template, messages=(), **context):
    return chat.compiled(template)(list(messages), **context)[0]


def test_language():
    m = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif m.role == 'user' and not false %}?{% else %}-{% endif %}{% endfor %}", m) == "1?2!"
    assert render("{% set x = 'a' + \"b\" %}{{ x | upper ~ '-' ~ 1 }}{# note #}") == "AB-1"
    assert render("a  {%- if true -%}  b  {%- endif -%}  c") == "abc"
    assert render("{{ messages[1].text }}{{ messages[9] }}{{ messages | length }}{{ nothing }}", m) == "yo2"
    assert render("{{ x.y['z'] }}", x={"y": {"z": 3}}) == "3"
    out, spans = chat.compiled("<{% generation %}{{ 'ab' }}{% endgeneration %}>")([])
    assert out == "<ab>" and spans == [(1, 3)]


def test_constants_fold():
    tree = chat.fold(chat.Parser("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% elif true %}d{% else %}y{% endif %}").block(())[0])
    assert tree == [chat.Text("abCd")]
    assert chat.fold(chat.Parser("{% if x and false %}a{% endif %}").block(())[0]) != []
    assert chat.fold(chat.Parser("{% if false and x %}a{% endif %}").block(())[0]) == []


@pytest.mark.parametrize("bad", ["{% for x in %}", "{{ 1 + }}", "{{ x | nope }}", "{% if a %}", "{% while 1 %}", "{{ x( ) }}", "{{ 1 + 'a' }}", "{% if a %}b{% else %}c{% else %}d{% endif %}", "{{ __import__('os') }}", "{{ 1 | length }}", "{{ 5 % 0 }}", "{{ 5 % x }}"])
def test_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled(bad)([], x=0)


def test_what_is_missing_has_no_length():
    assert render("{{ missing | length }}{{ messages | length }}") == "00"


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['__class__'] }}{{ messages.append }}", x="s") == ""


def test_digests(spark):
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (1, 1, "assistant", None), (1, 0, None, "q"), (1, None, "system", "first"), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    out = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert out[-7].n_turns == 2 and out[-7].loss_chars == len(PROBE)
    assert out[-7].loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest()
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256(b"system\nfirst\n\nq\nassistant\n\n").hexdigest() and out[1].loss_chars == 0
    assert out[2].n_turns == 2 and out[None].loss_chars == 4
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0

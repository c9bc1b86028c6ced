"""The template language: parsing, folding, the sandbox, generation spans, streaming."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.llm.chat_format import CHATML, turns_of
from gridframe.llm.chat_template import MAX_REPEAT, Template, TemplateError, escape, escape_line, parse, unescape, unescape_line

CHAT = [{"role": "system", "text": "Be brief."}, {"role": "user", "text": "Hi"}, {"role": "assistant", "text": "Hello"}]


@pytest.mark.parametrize(
    "source, want",
    [
        ("{{ 1 + 2 * 3 }}", "7"), ("{{ (1 + 2) * 3 - -1 }}", "10"), ("{{ 7 // 2 }}{{ 7 % 4 }}", "33"), ("{{ 'a' ~ 1 ~ none }}", "a1None"), ("{{ 'x' if messages else 'y' }}", "x"), ("{{ messages[0].role }}", "system"), ("{{ messages[-1]['text'] }}", "Hello"),
        ("{{ messages[1:] | length }}", "2"), ("{{ nothing.at.all }}", ""), ("{{ nothing | default('d') }}", "d"), ("{% if messages[0].role == 'system' and not nothing is defined %}s{% else %}n{% endif %}", "s"), ("{% if 1 > 2 %}a{% elif 2 >= 2 %}b{% else %}c{% endif %}", "b"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role[0] }}{% if not loop.last %},{% endif %}{% endfor %}", "1s,2u,3a"), ("{% for m in [] %}x{% else %}none{% endfor %}", "none"), ("{% set x = 'q' %}{{ x | upper }}", "Q"), ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"),
        ("{# {{ not this }} #}t", "t"), ("{{ '}}' }}", "}}"), ("{{ ' a '.strip() }}{{ 'ab'.startswith('a') }}", "aTrue"), ("{{ {'k': [1, 2]}['k'] | join('-') }}", "1-2"), ("{{ 'z' in 'xyz' }}{{ 'q' not in 'xyz' }}", "TrueTrue"), ("{{ '\\n' }}", "\n"), ("{% for n in range(3) %}{{ n }}{% endfor %}", "012"),
        ("{{ 'x' is string }}{{ 3 is odd }}{{ messages[0] is mapping }}", "TrueTrueTrue"), ("{{ loop is not defined }}", "True"), ("{{ messages | length }}", "3"), ("{% for m in messages %}{{ loop.length }}{% endfor %}", "333"),
    ],
)
def test_values(source, want):
    assert Template(source).render(CHAT)[0] == want


@pytest.mark.parametrize("source", ["{{ a", "{% if x %}", "{% for x %}{% endfor %}", "{{ a | nofilter }}", "{{ nofunction(1) }}", "{% include 'x' %}", "{{ 1 2 }}", "{% endif %}", "{{ 'a }}", "{{ x is nothing }}", "{% set a.b = 1 %}", "{{ ` }}"])
def test_refused_sources(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", [f"{{{{ 'x' * {MAX_REPEAT + 1} }}}}", f"{{% for n in range({MAX_REPEAT + 1}) %}}{{% endfor %}}", "{{ '%99999999d' % 1 }}", "{{ raise_exception('no') }}", "{{ 'a'.format(1) }}", "{{ messages.clear() }}"])
def test_the_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source).render(CHAT)


def test_no_attribute_of_an_object_can_be_reached():
    for source in ("{{ ''.__class__ }}", "{{ messages.__class__ }}", "{{ messages[0].__init__ }}", "{{ messages[0]['__class__'] }}"):
        assert Template(source).render(CHAT)[0] == ""


def test_constants_are_folded():
    assert Template("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 2 * 3 }}").body == [("text", "aBc6")]
    assert Template("{% if false %}{{ x }}{% endif %}").body == []
    assert Template("{{ x and (1 == 2) }}").body == [("print", ("and", ("name", "x"), ("const", False)))]
    assert parse("{{ 1 + 2 }}")[0][1][0] == "op"  # the tree itself is not folded
    Template("{% if x %}{{ raise_exception('late') }}{% endif %}").render(CHAT)  # fails only where it is reached
    Template("{% if x %}{{ 1 / 0 }}{% endif %}").render(CHAT)


def test_spans_are_those_of_generation_blocks():
    text, spans = Template("{% for m in messages %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}").render(CHAT)
    assert [text[a:b] for a, b in spans] == ["Be brief.", "Hi", "Hello"]
    assert Template("{% generation %}{{ x }}{% endgeneration %}").render(CHAT)[1] == []


def test_streaming_templates_take_one_message_at_a_time():
    taken = []

    def messages():
        for k in range(100):
            taken.append(k)
            yield {"role": "user", "text": f"t{k}"}

    template = Template("<" + CHATML + ">")
    assert template.streaming
    parts = template.parts(messages(), 200)
    first, _ = next(parts)
    assert len(taken) < 20 and first.startswith("<")
    assert first + "".join(t for t, _ in parts) == Template("{% if messages %}" + "<" + CHATML + ">{% endif %}").render(messages())[0]
    assert not Template("{{ messages | length }}{% for m in messages %}{% endfor %}").streaming
    assert not Template("{% for m in messages %}{{ loop.revindex }}{% endfor %}").streaming


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<|\\n\nimx_stard>e é"), max_size=30))
def test_escaping_can_be_undone_and_leaves_no_mark(text):
    assert "<|" not in escape(text) and unescape(escape(text)) == text
    line = escape_line(text)
    assert "<|" not in line and "\n" not in line and unescape_line(line) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>"]), st.text(st.sampled_from("<|im_end>start\n\\ "), max_size=25)), max_size=5))
def test_turns_are_read_back(turns):
    text, spans = Template(CHATML).render([{"role": r, "text": t} for r, t in turns])
    assert [(role, unescape(raw)) for _, role, raw in turns_of(text)] == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]

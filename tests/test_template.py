"""Chat templates of public shapes against texts written by hand."""

import pytest
from pyspark.sql import functions as F

from scoreforge.functions import template as t
from scoreforge.operators import encode

TURNS = "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
WRAPPED = """{%- if messages[0]['role'] == 'system' -%}
    {%- set system = messages[0]['content'] ~ '\\n\\n' -%}
{%- else -%}
    {%- set system = '' -%}
{%- endif -%}
{{ bos_token }}
{%- for message in messages -%}
    {%- if message.role == 'user' -%}
        [INST] {{ message.content | trim }} [/INST]
    {%- elif message.role == 'assistant' -%}
        {{ ' ' + message.content + eos_token }}
    {%- endif -%}
    {%- if not loop.last -%}{{ loop.index }},{%- endif -%}
{%- endfor -%}"""
PARTS = """{% for m in messages %}
<|{{ m.role }}|>
{% for part in m.parts %}
  {% if part.type in ['audio', 'sound'] %}
<audio>
  {% elif part.text is defined and part.text %}
{{ part.text }}
  {% endif %}
{% endfor %}
{% endfor %}
{% if add_generation_prompt %}
<|assistant|>
{% endif %}"""
MESSAGES = [("system", "Be kind."), ("user", "  Hi \n"), ("assistant", "Hello"), ("user", "x|y ~ 'z'")]


def one(df, text):
    return [r.v for r in df.select(text.alias("v")).collect()]


@pytest.fixture
def chats(spark):
    return spark.createDataFrame([(MESSAGES,), (MESSAGES[1:2],), ([],), ([("user", None)],)], "m array<struct<role:string,content:string>>").coalesce(1)


def test_turns(chats):
    kind = chats.schema["m"].dataType
    hand = ["".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in m) for m in (MESSAGES, MESSAGES[1:2], [], [("user", "")])]
    assert one(chats, t.rendered(TURNS, F.col("m"), kind)) == hand
    assert one(chats, t.rendered(TURNS, F.col("m"), kind, True)) == [h + "<|im_start|>assistant\n" for h in hand]


def test_wrapped(chats):
    got = one(chats, t.rendered(WRAPPED, F.col("m"), chats.schema["m"].dataType, bos_token="<s>", eos_token="</s>"))
    assert got == ["<s>1,[INST] Hi [/INST]2, Hello</s>3,[INST] x|y ~ 'z' [/INST]", "<s>[INST] Hi [/INST]", "<s>", "<s>[INST]  [/INST]"]


def test_parts(spark):
    kind = "array<struct<role:string,parts:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([([("system", []), ("user", [("audio", None), ("text", "what?"), ("text", "")])],)], f"m {kind}")
    assert one(df, t.rendered(PARTS, F.col("m"), df.schema["m"].dataType, True)) == ["<|system|>\n<|user|>\n<audio>\nwhat?\n<|assistant|>\n"]


def test_choices_and_numbers(chats):
    kind = chats.schema["m"].dataType
    source = "{% for m in messages %}{% if loop.index0 % 2 == 0 and m.role != 'system' %}a{% elif loop.first or loop.length > 3 %}b{% else %}c{% endif %}{{ 'L' if loop.last else m.role|upper }}{{ (m.content|length) - 1 }}{% endfor %}{{ messages[-1].role }}{{ nowhere }}{{ 'n' if x is not defined else x }}"
    assert one(chats, t.rendered(source, F.col("m"), kind)) == ["bSYSTEM7bUSER5aASSISTANT4bL8usern", "aL5usern", "n", "aL-1usern"]
    for bad in ("{% macro x() %}{% endmacro %}", "{{ f(1) }}", "{% for a in b %}{% endfor %}", "{% if true %}", "{{ messages | sort }}"):
        with pytest.raises((ValueError, KeyError)):
            t.rendered(bad, F.col("m"), kind)


def test_prompt_of_a_template(spark):
    df = spark.createDataFrame([("la",)], "lyric string")
    head = "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n"
    assert one(df, encode.template_prefix(TURNS, "x")) == [head]
    assert one(df, encode.prompt(encode.template_prefix(TURNS, "x"), F.col("lyric"))) == [head + "language Chinese<asr_text>la<|file_sep|>"]
